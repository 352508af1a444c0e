"""SM-*: rate limits, quality monitoring, cleaning and de-duplication of streams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cleaning import col, is_age
from tidemark.operators.common import currency_to_double
from tidemark.session import scratch_path


def rate_limit_flags(df: DataFrame, key: str, ts: str, n: int = 10, seconds: int = 60) -> DataFrame:
    """SM-01 in batch: ``recent`` other events of the same key in the trailing
    ``seconds`` and whether they reach ``n``.

    A trailing window reaches back one bucket of that length at most, so every
    event also goes to the next bucket as context. A key with a third of all
    events is thus cut into its time buckets and never sorted in one task."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    rows = df.withColumn("_us", micros).withColumn("_b", F.floor(F.col("_us") / span))
    spread = rows.withColumn("_in", F.explode(F.array(F.col("_b"), F.col("_b") + 1)))
    w = Window.partitionBy(key, "_in").orderBy("_us").rangeBetween(-(span - 1), 0)
    counted = spread.withColumn("recent", F.count("*").over(w) - 1).filter(F.col("_in") == F.col("_b"))
    return counted.withColumn("is_limited", F.col("recent") >= n).drop("_us", "_b", "_in")


def rate_limit_windows(stream: DataFrame, key: str, ts: str, n: int = 10, window: str = "60 seconds", slide: str = "10 seconds", watermark: str = "2 minutes") -> DataFrame:
    """SM-01 on a stream: counts per sliding window. It approximates the trailing
    rule in steps of ``slide``: a burst across a step shows in the next window."""
    g = stream.withWatermark(ts, watermark).groupBy(F.window(ts, window, slide), F.col(key)).agg(F.count("*").alias("events"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "events", (F.col("events") >= n).alias("is_limited"))


def quality_monitor(df: DataFrame, ts: str, value: str, low: float, high: float, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """SM-02: rows, nulls, negatives and fence violations per window. The same
    plan runs on a stream and on a table."""
    d = df.withWatermark(ts, watermark) if df.isStreaming else df
    v = F.col(value)
    g = d.groupBy(F.window(ts, window)).agg(
        F.count("*").alias("rows"), F.count_if(v.isNull()).alias("nulls"), F.count_if(v < 0).alias("negatives"),
        F.count_if((v < low) | (v > high)).alias("fence_violations"), F.round(F.sum(v), 2).alias("total"),
    )
    return g.select(F.col("window.start").alias("start"), "rows", "nulls", "negatives", "fence_violations", "total")


@dataclass
class StreamRules:
    """Rules fixed beforehand, since a stream cannot look at all its rows."""

    numeric: Sequence[str] = ()
    non_negative: Sequence[str] = ()
    fills: dict[str, float] = field(default_factory=dict)


def clean_projection(df: DataFrame, rules: StreamRules) -> DataFrame:
    """SM-03: trim, coerce, domain rules and imputation with marks, per row."""
    def fixed(c: str) -> Column:
        t = df.schema[c].dataType.simpleString()
        out = currency_to_double(c) if c in rules.numeric else (F.regexp_replace(col(c), r"^\s+|\s+$", "") if t == "string" else col(c))
        if c in rules.non_negative:
            out = F.when(out >= 0, out)
        if is_age(c):
            out = F.when(out.between(0, 100), out)
        return out.alias(c)
    d = df.select([fixed(c) for c in df.columns])
    return d.select(
        *[F.coalesce(col(c), F.lit(rules.fills[c])).alias(c) if c in rules.fills else col(c) for c in d.columns],
        *[col(c).isNull().alias(f"_imputed_{c}") for c in rules.fills],
    )


def stream_clean(stream: DataFrame, rules: StreamRules, sink: str) -> None:
    """SM-03: run the projection over all available input into ``sink/data`` and
    write per batch how many cells were imputed to ``sink/report``. A batch that
    is replayed overwrites its own folders."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/data/batch={batch_id}")
        marks = [F.count_if(F.col(f"_imputed_{c}")).alias(c) for c in rules.fills]
        batch.agg(F.count("*").alias("rows"), *marks).write.mode("overwrite").parquet(f"{sink}/report/batch={batch_id}")

    q = clean_projection(stream, rules).writeStream.foreachBatch(write).option("checkpointLocation", f"{sink}/_checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def stream_dedupe(stream: DataFrame, keys: Sequence[str], ts: str, watermark: str) -> DataFrame:
    """SM-04: drop repeats of a key that arrive within the watermark delay."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def drain(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a streaming query over all available input and give its rows as a
    table in the shared folder. In ``update`` mode a row may appear once per
    batch; ``batch`` tells the newest."""
    out = scratch_path(stream.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.option("basePath", f"{out}/data").parquet(f"{out}/data")


def newest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows of an ``update`` run, the last one per key."""
    whole = F.struct(*[F.col(c) for c in df.columns if c != "batch"])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(whole, "batch").alias("r")).select("r.*")
