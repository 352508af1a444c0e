"""CL-17, CL-18: repeated values far outside the rest of their column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import cumulative_histogram, value_histogram, values_at_ranks
from tidemark.operators.cleaning import col, doubles
from tidemark.session import materialize

# Numbers that commonly stand for "missing".
KNOWN_SENTINELS = (999.0, 9999.0, 99999.0, -1.0, -999.0, -9999.0)


def percentile_without(hist: DataFrame, candidates: DataFrame) -> DataFrame:
    """JN-02: quartiles of a column with one value left out, for many candidate
    values at once.

    Leaving out ``cnt`` copies that start at position ``before`` only shifts
    ranks: rank r of the rest is rank r of the whole if r < before, else
    r + cnt. So every quartile is two rank lookups in one cumulative histogram
    and candidates are never paired with the other values."""
    rest = F.col("n") - F.col("cnt")
    pos = lambda p: F.lit(p) * (rest - 1)
    shift = lambda r: F.when(r < F.col("before"), r).otherwise(r + F.col("cnt")).cast("long")
    wanted = candidates.select(
        "column", "value", "cnt", "n",
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("q"), F.lit(end).alias("end"), shift(f(pos(p))).alias("rank"))
            for name, p in (("q1", 0.25), ("q3", 0.75)) for end, f in (("a", F.floor), ("z", F.ceil))
        ])).alias("w"),
    ).select("column", "value", "cnt", "n", "w.*")
    t = values_at_ranks(hist, wanted).groupBy("column", "value", "cnt", "n").agg(*[
        F.max(F.when((F.col("q") == q) & (F.col("end") == e), F.col("found"))).alias(f"{q}{e}") for q in ("q1", "q3") for e in ("a", "z")
    ])
    mix = lambda q, p: F.col(f"{q}a") + (F.col(f"{q}z") - F.col(f"{q}a")) * (pos(p) - F.floor(pos(p)))
    return t.select("column", "value", "cnt", "n", mix("q1", 0.25).alias("q1"), mix("q3", 0.75).alias("q3"))


def repeated_value_findings(df: DataFrame, cols: Sequence[str] | None = None, k: float = 3.0, min_repeats: int = 3, skip_common: bool = False) -> DataFrame:
    """CL-17, CL-18: values that occur at least ``min_repeats`` times and lie
    outside the k·IQR fence of the other values of their column. ``kind`` is
    ``sentinel`` for known placeholder numbers, else ``extreme``.

    ``skip_common`` leaves out values other than placeholders that lie within
    2.5·IQR of the whole column, whatever its size."""
    counts = materialize(value_histogram(doubles(df, cols)), "histogram")
    # Most continuous columns repeat nothing and need no further work.
    repeating = [r["column"] for r in counts.filter(F.col("cnt") >= min_repeats).select("column").distinct().collect()]
    hist = materialize(cumulative_histogram(counts.filter(F.col("column").isin(*repeating))), "histogram")
    known = F.col("value").isin(*KNOWN_SENTINELS)
    repeated = F.col("cnt") >= min_repeats
    cand = hist.filter(repeated & (F.col("n") >= 6) & (F.col("n") - F.col("cnt") >= 5))
    # Leaving out nothing gives the quartiles of the whole column.
    whole = hist.groupBy("column").agg(F.max("n").alias("n"), F.count_if(repeated).alias("candidates"))
    nothing = whole.select("column", F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("cnt"), F.col("n").alias("before"), "n")
    q = percentile_without(hist, cand.unionByName(nothing))
    limits = q.filter("value is null").join(whole, ["column", "n"]).select(
        "column", "candidates", F.col("q1").alias("w1"), F.col("q3").alias("w3")
    )
    q = q.filter("value is not null").join(F.broadcast(limits), "column")  # one row per column
    iqr_all = F.col("w3") - F.col("w1")
    in_range = F.col("value").between(F.col("w1") - 2.5 * iqr_all, F.col("w3") + 2.5 * iqr_all)
    if skip_common:
        q = q.filter(known | (iqr_all <= 0) | ~in_range)
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - k * iqr, F.col("q3") + k * iqr
    return q.filter((iqr > 0) & ((F.col("value") < low) | (F.col("value") > high))).select(
        "column", "value", F.col("cnt").alias("count"), F.when(known, "sentinel").otherwise("extreme").alias("kind"),
        F.round(low, 2).alias("lower_fence"), F.round(high, 2).alias("upper_fence"),
    )


def null_sentinels(df: DataFrame, findings: Sequence) -> DataFrame:
    """CL-17: set the found sentinels (at most six per column) to NULL."""
    by: dict[str, list[float]] = {}
    for r in findings:
        if r["kind"] == "sentinel":
            by.setdefault(r["column"], []).append(r["value"])
    return df.select([
        F.when(col(c).isNotNull() & ~col(c).cast("double").isin(*by[c]), col(c)).alias(c) if c in by else col(c) for c in df.columns
    ])
