"""WARC archives: written by Spark's text writer, read back and assembled.

A record is its header lines, an empty line, the block, and two empty lines; the
writer's line separator is just that end of a record. Every capture has a request,
a response (or a revisit of an equal payload) and a metadata record, tied by
WARC-Concurrent-To. Reading gives one row per record; ``transactions`` joins them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import column, shuffles_cleaned, stage
from tidemark.session import scratch_path

REVISIT_BYTES, RECORDS_PER_FILE = 1000, 3000
#: Fixed values of the format.
_VERSION, _END = "WARC/1.1", "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def captures(pages: DataFrame, min_bytes: int = REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, nth, url, body, digest, bytes, keeper_id, keeper_nth): each page with the
    capture that holds its payload: the largest (page_id, nth) with equal bytes if the
    payload has ``min_bytes`` or more, else its own. ``nth`` tells rows of one id apart."""
    body = F.coalesce(column(body_col).cast("string"), F.lit(""))
    rows = pages.select(column(id_col).cast("long").alias("page_id"), column(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha1(F.col("body").cast("binary"))).withColumn("bytes", F.octet_length("body").cast("long"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = rows.withColumn("k", F.concat_ws("|", name("page_id"), "digest", name("url")))
    # who keeps what is found without the bodies, which then move once
    same = rows.groupBy("k").agg(F.first("page_id").alias("page_id"), F.first("digest").alias("digest"), F.first("bytes").alias("bytes"), F.count("*").alias("m"))
    earlier = W.partitionBy("page_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    same = same.withColumn("at", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    best = same.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max(F.struct("page_id", (F.col("at") + F.col("m") - 1).alias("nth"))).alias("keeper"))
    best = best.select(F.col("digest").alias("k_digest"), "keeper")
    found = same.join(best, (F.col("digest") == F.col("k_digest")) & (F.col("bytes") >= min_bytes), "left").select("k", "at", "k_digest", "keeper")
    out = rows.join(found, "k").withColumn("nth", F.col("at") + F.row_number().over(W.partitionBy("k").orderBy("k")) - 1)
    own = F.col("k_digest").isNull()
    return out.select(
        "page_id", "nth", "url", "body", "digest", "bytes",
        F.when(own, F.col("page_id")).otherwise(F.col("keeper.page_id")).alias("keeper_id"), F.when(own, F.col("nth")).otherwise(F.col("keeper.nth")).alias("keeper_nth"),
    )


def _uuid(kind: str, page: Column, nth: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("none")), nth.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column | str, record_id: Column, block: Column, content_type: str, *more: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = [
        F.lit(_VERSION), line("WARC-Type", kind), line("WARC-Record-ID", record_id), line("WARC-Date", F.lit(_DATE)),
        *more, line("Content-Type", F.lit(content_type)), line("Content-Length", F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *head), F.lit(_END), block)  # nulls in ``more`` are left out


def records(pages: DataFrame, min_bytes: int = REVISIT_BYTES, **cols: str) -> DataFrame:
    """(record): three WARC records per page, each without its final empty lines.

    The payload of a null body is empty. Line ends in a url become %0D and %0A, blanks
    and other control characters %20; a null url, like a null id, has no header.
    """
    c = captures(pages, min_bytes, **cols)
    me = (F.col("page_id"), F.col("nth"))
    own = F.col("page_id").eqNullSafe(F.col("keeper_id")) & (F.col("nth") == F.col("keeper_nth"))
    url = F.col("url")
    for pattern, code in (("\\r", "%0D"), ("\\n", "%0A"), ("[\\x00-\\x20\\x7f]", "%20")):
        url = F.regexp_replace(url, pattern, code)
    uri = F.concat(F.lit("WARC-Target-URI: "), url)
    with_id = lambda name, x: F.concat(F.lit(f"{name}: "), x)
    response = _uuid("response", *me)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    block = F.when(own, F.concat(http, F.col("body"))).otherwise(http)
    refers = F.when(~own, with_id("WARC-Refers-To", _uuid("response", F.col("keeper_id"), F.col("keeper_nth"))))
    page = with_id("page-id", F.col("page_id").cast("string"))
    out = F.array(
        _record("request", _uuid("request", *me), F.concat(F.lit("GET / HTTP/1.1"), F.lit(_END)), "application/http; msgtype=request", uri, with_id("WARC-Concurrent-To", response)),
        _record(F.when(own, F.lit("response")).otherwise(F.lit("revisit")), response, block, "application/http; msgtype=response", uri,
                with_id("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), refers, F.when(~own, F.lit(f"WARC-Profile: {_PROFILE}"))),
        _record("metadata", _uuid("metadata", *me), F.concat_ws("\r\n", page, F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string")), F.lit("")), "application/warc-fields", uri, with_id("WARC-Concurrent-To", response)),
    )
    return c.select(F.explode(out).alias("record"))


def write(pages: DataFrame, path: str, min_bytes: int = REVISIT_BYTES, records_per_file: int = RECORDS_PER_FILE, **cols: str) -> None:
    """Write gzip WARC files of at most ``records_per_file`` records into a new folder."""
    out = records(pages, min_bytes, **cols).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
    with shuffles_cleaned(pages.sparkSession):
        out.text(path)


_ROW = "record_id string, record_type string, concurrent_to string, refers_to string, url string, digest string, block binary"
_NAMES = {b"warc-record-id": 0, b"warc-type": 1, b"warc-concurrent-to": 2, b"warc-refers-to": 3, b"warc-target-uri": 4, b"warc-payload-digest": 5}


_PIECE = 1 << 18


def inflate(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file, a piece at a time. A file can have any number of
    members, one a record as the format recommends; zeros after the last are padding."""
    stream = None
    for at in range(0, len(data), _PIECE):
        rest = data[at : at + _PIECE]
        while rest:
            if stream is None:
                rest = rest.lstrip(b"\0")
                if not rest:
                    break
                stream = zlib.decompressobj(wbits=31)
            yield stream.decompress(rest)
            rest = stream.unused_data
            if stream.eof:
                stream = None
    if stream is not None:
        raise ValueError("the gzip file is cut off")


def parse(data: bytes | Iterable[bytes]) -> Iterator[list]:
    """The records of one archive, given whole or in pieces; lengths decide, so blocks may
    hold anything. No more than a record and a piece is held."""
    pieces = iter([data] if isinstance(data, bytes) else data)
    held, at, before = b"", 0, 0

    def more() -> bool:
        nonlocal held, at, before
        new = next(pieces, None)
        if new is not None:
            held, at, before = held[at:] + new, 0, before + at
        return new is not None

    def wait(size: int) -> None:
        """Until the record's first ``size`` bytes are there."""
        nonlocal held, at, before
        if len(held) - at >= size:
            return
        parts, have = [held[at:]], len(held) - at
        while have < size and (new := next(pieces, None)) is not None:
            parts.append(new)
            have += len(new)
        held, at, before = b"".join(parts), 0, before + at
        if have < size:
            raise ValueError(f"the WARC record at byte {before + at} has no length or is cut off")

    while at < len(held) or more():
        if at == len(held):
            continue
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError(f"the WARC record at byte {before + at} has no length or is cut off")
        lines = held[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {before + at}")
        row, length = [None] * 7, None
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            name, value = name.lower(), value.strip()
            if name == b"content-length":
                length = int(value)
            elif name in _NAMES:
                row[_NAMES[name]] = value.decode()
        if length is None:
            raise ValueError(f"the WARC record at byte {before + at} has no length or is cut off")
        head = end + 4 - at
        wait(head + length + 4)
        row[6] = held[at + head : at + head + length]
        at += head + length + 4
        yield row


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in a folder; a file is one task's work. All gzip
    members of a file are read, inflated a piece at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = [x.split()[0] for x in _ROW.split(", ")]
    types = [pa.string()] * 6 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = []
                for row in parse(inflate(content.as_py())):
                    rows.append(row)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return files.mapInArrow(run, _ROW)


def transactions(rows: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, page_id, url, response, request, metadata.

    Requests and metadata name their response in WARC-Concurrent-To. A capture keeps
    its row without them (null), records that name no capture here are left out, and
    of several requests or metadata records of one capture the smallest id is taken.
    """
    main = rows.where(F.col("record_type").isin("response", "revisit"))
    cut = F.expr("locate('\r\n\r\n', cast(block AS string))")
    response = F.struct(
        "record_type", "refers_to", F.substring_index("digest", ":", -1).alias("digest"), F.expr("substr(block, head + 4)").alias("payload"),
    )
    # the HTTP head is ASCII, so its length in characters is its length in bytes
    main = main.withColumn("head", cut).select(F.col("record_id").alias("capture_id"), "url", response.alias("response"))

    def side(kind: str) -> DataFrame:
        some = rows.where(F.col("record_type") == kind).groupBy("concurrent_to").agg(F.min(F.struct("record_id", F.col("block").cast("string").alias("block"))).alias(kind))
        return some.withColumnRenamed("concurrent_to", f"{kind}_of")

    out = main
    for kind in ("request", "metadata"):
        out = out.join(side(kind), F.col("capture_id") == F.col(f"{kind}_of"), "left")
    field = lambda name: F.regexp_extract("metadata.block", f"(?m)^{name}: (-?[0-9]+)\\r?$", 1)
    return out.select(
        "capture_id", F.when(field("page-id") != "", field("page-id").cast("long")).alias("page_id"),
        F.when(field("payload-bytes") != "", field("payload-bytes").cast("long")).alias("payload_bytes"), "url", "response", "request", "metadata",
    )


def round_trip(pages: DataFrame, min_bytes: int = REVISIT_BYTES, keep: Sequence[Column | str] = (), **cols: str) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back, assemble.

    ``keep`` names what is wanted of each transaction; the rest, payloads that were
    read and digested there for instance, is not written a second time.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, min_bytes, **cols)
    out = transactions(read(pages.sparkSession, path))
    return stage(out.select(*keep) if keep else out, "warc-transactions")
