"""IO-11, IO-13: classify the files of a directory and reject unfit ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The reader of whole files takes no more bytes than this.
READABLE_BYTES = 2**31 - 1
# Extensions and first bytes (as hex) that identify formats.
MEDIA = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "ico", "svg", "mp3", "wav", "ogg", "mp4", "avi", "mov", "mkv", "webm", "flac")
MEDIA_MAGIC = ("89504E47", "FFD8FF", "47494638", "52494646", "494433")
EXECUTABLE = (
    "exe", "dll", "bat", "cmd", "sh", "com", "msi", "scr", "pif", "application", "gadget", "msp", "hta", "cpl", "msc",
    "jar", "vbs", "vbe", "js", "jse", "ws", "wsf", "wsc", "wsh",
)
ZIP, GZIP, PARQUET, FEATHER, SQLITE, PDF = "504B0304", "1F8B", "50415231", "46454131", "53514C69746520666F726D6174203300", "255044462D"
TABULAR = ("csv", "json", "jsonl", "xml", "parquet", "gzip", "text")
HEAD_BYTES = 8192
NOT_TABULAR = "We received your file but could not find tabular data in it."


def _starts(head: Column, *magic: str) -> Column:
    out = F.lit(False)
    for m in magic:
        out = out | head.startswith(m)
    return F.coalesce(out, F.lit(False))


def file_format(ext: Column, head: Column) -> Column:
    """IO-11: the format by extension and first bytes (``head`` as hex; NULL for
    files too large to look into)."""
    text = F.lower(F.decode(F.unhex(head), "ISO-8859-1"))
    trimmed = F.ltrim(text)
    has = lambda s: F.coalesce(text.contains(s), F.lit(False))
    return (
        F.when((ext == "zip") | _starts(head, ZIP), F.when(ext.isin("xlsx", "xlsm"), "excel").when(ext == "docx", "docx").otherwise("zip"))
        .when(ext.isin("gz", "gzip") | _starts(head, GZIP), "gzip")
        .when(ext.isin("xls", "ods"), "excel")
        .when((ext == "parquet") | _starts(head, PARQUET), "parquet")
        .when((ext == "feather") | _starts(head, FEATHER), "feather")
        .when(ext.isin("sqlite", "db", "sqlite3") | _starts(head, SQLITE), "sqlite")
        .when((ext == "pdf") | _starts(head, PDF), "pdf")
        .when(ext == "docx", "docx")
        .when(ext.isin("xml", "html", "htm") | has("<table") | has("<?xml"), F.when(ext.isin("html", "htm") | has("<table"), "html").otherwise("xml"))
        .when(ext.isin("jsonl", "ndjson"), "jsonl")
        .when((ext == "json") | F.coalesce(trimmed.startswith("{") | trimmed.startswith("["), F.lit(False)), "json")
        .when(ext.isin(*MEDIA) | _starts(head, *MEDIA_MAGIC), "media")
        .when(ext.isin("csv", "tsv"), "csv")
        .when(has("\u0000"), "binary")
        .when(ext == "txt", "text")
        .otherwise(F.when(head.isNotNull(), "csv").otherwise("binary"))
    )


def classify_files(files: DataFrame) -> DataFrame:
    """IO-11 over a table (file_name, length, head)."""
    ext = F.lower(F.regexp_extract("file_name", r"\.([^./\\]+)$", 1))
    d = files.withColumn("extension", ext).withColumn("format", file_format(F.col("extension"), F.col("head")))
    tabular = F.col("format").isin(*TABULAR)
    return d.withColumns({
        "is_tabular": tabular,
        "status": F.when(tabular, "Tabular").otherwise("Non-tabular media or binary asset"),
        "message": F.when(~tabular, F.lit(NOT_TABULAR)),
    })


def catalog_files(spark: SparkSession, directory: str) -> DataFrame:
    """IO-11: one row per file below ``directory``. Of each file
    only the first bytes are kept; one of 2 GiB or more is judged by its name."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    small = every.filter(F.col("length") <= READABLE_BYTES).select("path", name.alias("file_name"), "length", F.hex(F.substring("content", 1, HEAD_BYTES)).alias("head"))
    large = every.filter(F.col("length") > READABLE_BYTES).select("path", name.alias("file_name"), "length", F.lit(None).cast("string").alias("head"))
    return classify_files(small.unionByName(large))


def accept_files(catalog: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """IO-13: ``reject_reason`` for empty and executable files, for those
    above ``max_bytes`` if it is given, and for
    content that contradicts the extension; NULL for accepted ones."""
    office = F.col("extension").isin("xlsx", "xlsm") & ~_starts(F.col("head"), ZIP)
    reason = (
        F.when(F.col("length") == 0, "empty file")
        .when(F.col("extension").isin(*EXECUTABLE), "executable")
        .when(F.lit(False) if max_bytes is None else F.col("length") > max_bytes, "too large")
        .when(office, "content does not match extension")
    )
    return catalog.withColumns({"reject_reason": reason, "accepted": reason.isNull()})
