"""IO-01..10, IO-12, IO-16: readers that give clean headers and raw cells."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.quantiles import bounded_broadcast
from tidemark.operators.cleaning import col, string_columns

# Delimiters looked for, text read as missing, and the keys under
# which a JSON object keeps its records.
DELIMITERS = (",", "\t", ";", "|")
NULL_TEXT = ("", "N/A", "NA", "None", "nan", "NaN", "null", "NULL", "n/a", "#N/A", "<NA>")
CONTAINER_KEYS = ("data", "items", "rows", "results", "records")
HEAD_LINES, HEAD_CHARS = 50, 4096


def clean_names(names: Sequence[str | None]) -> list[str]:
    """IO-12: trimmed names; blank or ``Unnamed:`` ones become ``col_<i>``;
    repeats get ``_1``, ``_2``."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        n = "" if name is None else str(name).strip()
        if not n or n.startswith("Unnamed:"):
            n = f"col_{i}"
        if n in seen:
            seen[n] += 1
            n = f"{n}_{seen[n]}"
        else:
            seen[n] = 0
        out.append(n)
    return out


def sanitize_headers(df: DataFrame) -> DataFrame:
    """IO-12."""
    return df.toDF(*clean_names(df.columns))


def null_tokens(df: DataFrame) -> DataFrame:
    """Text that stands for a missing value becomes NULL, in every text column."""
    texts = set(string_columns(df))
    return df.select([F.when(~F.trim(col(c)).isin(*NULL_TEXT), col(c)).alias(c) if c in texts else col(c) for c in df.columns])


def _head(spark: SparkSession, path: str, encoding: str) -> str:
    """The first lines of the data: what a person would look at, never more."""
    reader = spark.read.option("encoding", encoding)
    rows = reader.schema("line string").option("sep", "\u0001").option("quote", "").csv(path).limit(HEAD_LINES).collect()
    return "\n".join(r["line"] or "" for r in rows)[:HEAD_CHARS]


def detect_encoding(spark: SparkSession, path: str) -> str:
    """IO-02: UTF-8 unless some line holds bytes that are not; then Latin-1, which
    accepts every byte (so a third choice never comes up). One pass over all lines;
    give the encoding to spare it."""
    other = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if other else "UTF-8"


def detect_delimiter(sample: str) -> str:
    """IO-01: sniffed from the sample, else the most frequent delimiter that
    occurs more than twice, else a comma."""
    try:
        return csv.Sniffer().sniff(sample, delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        best = max(DELIMITERS, key=sample.count)
        return best if sample.count(best) > 2 else ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, multi_line: bool = False) -> DataFrame:
    """IO-01, IO-02, IO-09: delimited text as strings, with the
    delimiter found from the first lines and the encoding from all. ``.gz`` files are read as they are.
    ``multi_line`` accepts line breaks inside quotes, at the price of one task
    per file."""
    encoding = encoding or detect_encoding(spark, path)
    sample = _head(spark, path, encoding)
    sep = sep or detect_delimiter(sample)
    header = next(csv.reader(sample.splitlines()[:1], delimiter=sep), [])
    reader = spark.read.option("sep", sep).option("header", True).option("encoding", encoding).option("escape", '"').option("multiLine", multi_line)
    df = reader.csv(path)
    if not df.columns:
        raise ValueError(f"no columns found in {path}")
    names = header if len(header) == len(df.columns) else df.columns
    return null_tokens(df.toDF(*clean_names(names)))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """IO-05: nested structs as dotted columns; arrays stay as they are."""
    out = []

    def walk(prefix: list[str], t: T.DataType) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk([*prefix, f.name], f.dataType)
        else:
            out.append(F.col(".".join(f"`{p}`" for p in prefix)).alias(sep.join(prefix)))

    walk([], df.schema)
    return df.select(out)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """IO-03..05: a record array, a list of scalars (column ``value``), an object
    that keeps its records under a container key, or a plain object; flattened.
    Each file is one JSON document and so one task; prefer JSON Lines for bulk."""
    df = spark.read.option("multiLine", True).json(path)
    if df.columns == ["_corrupt_record"]:
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    for key in CONTAINER_KEYS:
        t = df.schema[key].dataType if key in df.columns else None
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            df = df.select(F.explode(col(key)).alias("_row")).select("_row.*")
            break
    return sanitize_headers(flatten(df))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """IO-06: one JSON object per line; splits across tasks. Give ``schema`` to
    spare the pass that infers it."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return sanitize_headers(flatten(reader.json(path)))


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """IO-07: one row per ``row_tag`` element; attributes are columns too. A
    single column is no table."""
    df = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "").load(path)
    if len(df.columns) < 2:
        raise ValueError(f"no table of <{row_tag}> rows in {path}")
    return sanitize_headers(flatten(df))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """IO-08."""
    return spark.read.parquet(path)


def _line_facts(df: DataFrame) -> DataFrame:
    text = F.col("text_content")
    return df.withColumns({
        "character_count": F.length(text),
        "word_count": F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")),
    })


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """IO-10: the non-blank lines of text files, numbered per file.

    Lines are numbered inside their file block; the line counts of the blocks (a
    small table) give each block its offset. No file passes through one task."""
    lines = spark.read.text(path).select(
        F.regexp_replace("value", r"\r$", "").alias("text_content"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
    ).filter(F.col("text_content").rlike(r"(?U)\S")).withColumn("_id", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    numbered = lines.join(bounded_broadcast(blocks), ["file", "_block"]).withColumn("line_number", F.col("_id") - F.col("_first") + F.col("_offset") + 1)
    return _line_facts(numbered.select("file", "line_number", "text_content"))


def text_lines(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """IO-10 over a text column: the non-blank lines of each text, numbered."""
    parts = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"(?U)\S"))
    rows = df.select(*keys, F.posexplode(parts).alias("_pos", "_line"))
    return _line_facts(rows.select(*keys, (F.col("_pos") + 1).alias("line_number"), F.regexp_replace("_line", r"\r$", "").alias("text_content")))


def preview(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """IO-16: the first ``n`` rows in a stated order, with the total."""
    if n < 1:
        raise ValueError("n has to be at least 1")
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.orderBy(*order).limit(n).withColumn("total_rows", total)


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table if it exists."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
