"""What the training-data operators share: staged tables, Arrow helpers, words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import materialize, scratch_dir

#: A word is a run of bytes other than these six: what ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def stage(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for long chains: the written table cuts the lineage, so the
    shuffle files behind it go as soon as it is there and disk use does not add up."""
    with shuffles_cleaned(df.sparkSession):
        return materialize(df, name)


def unstage(*staged: DataFrame) -> None:
    """Takes away tables that ``stage`` wrote and that no later step reads. Files
    elsewhere than in a staged table's own folder stay."""
    for df in staged:
        spark = df.sparkSession
        path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf()
        root = path(scratch_dir(spark)).toUri().getPath()
        for at in map(path, {x.rsplit("/", 1)[0] for x in df.inputFiles()}):
            if at.getParent().toUri().getPath() == root and re.search("-[0-9a-f]{12}$", at.getName()):
                at.getFileSystem(conf).delete(at, True)


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """What is written in here takes its shuffle files away when it is done."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def small_batches(df: DataFrame) -> None:
    """From now on Python tasks of this session get at most ROWS rows at once: rows
    that hold whole texts fill much memory, outside the heap and in Python, at the
    default of 10,000."""
    conf = df.sparkSession.conf
    if int(conf.get(ARROW_ROWS, "10000")) > ROWS:
        conf.set(ARROW_ROWS, ROWS)


def column(name: str) -> Column:
    """A top-level column whatever its name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns of the
    caller can have any names. The text may be null."""
    small_batches(docs)
    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))


def arrow_rows(fn: Callable[..., pa.RecordBatch | None]):
    """A ``mapInArrow`` function that turns each non-empty batch into one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None and out.num_rows:
                yield out

    return run


def bounded(met: DataFrame, chars: int) -> DataFrame:
    """Rows (doc_id, text and more; one an id, few) with together at most ``chars``
    characters, in the order of a hash of the id. Where all are too long together no
    text takes more than an eighth of them: the rest of it is cut off, so that one
    long text leaves room for others."""
    if (met.agg(F.sum(F.length("text"))).first()[0] or 0) <= chars:
        return met
    met = met.withColumn("text", F.substring("text", 1, max(chars // 8, 1)))
    fits = met.select("doc_id", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(W.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("sum"))
    return met.join(F.broadcast(fits.where(F.col("sum") <= chars).select("doc_id")), "doc_id")


def encoded(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of each text of a batch; null is empty."""
    for x in batch.column(name).cast(pa.binary()):
        yield x.as_py() or b""
