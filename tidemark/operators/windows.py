"""WN-*: ranking, running and first/last operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranges import in_ranges, join_keys, running_sum
from tidemark.session import materialize

# Rows of a series that one task averages.
SERIES_ROWS = 50_000
# Distinct p-values of about so many share a range, and so a task.
RANGE_ROWS = 50_000


def rolling_mean(df: DataFrame, order: str, value: str, w: int, by: Sequence[str] = (), series_rows: int = SERIES_ROWS) -> DataFrame:
    """WN-01: mean over the last ``w`` rows, partial at the start. A series, with or
    without ``by``, can have any length: it is cut into pieces of at least ``w`` rows,
    and each piece starts with the last ``w - 1`` rows of the one before."""
    size = max(w, series_rows)
    rows = period_index(df, order, by).withColumnRenamed("idx", "_idx")
    piece, late = F.floor(F.col("_idx") / size), F.col("_idx") % size > size - w
    rows = rows.withColumn("_piece", F.explode(F.when(late, F.array(piece, piece + 1)).otherwise(F.array(piece))))
    win = Window.partitionBy(*[f"`{k}`" for k in by], "_piece").orderBy("_idx").rowsBetween(-(w - 1), 0)
    out = rows.withColumn("rolling_mean", F.round(F.avg(value).over(win), 2))
    return out.filter(F.col("_piece") == F.floor(F.col("_idx") / size)).drop("_idx", "_piece")


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """WN-03: the share of each row in the total, in percent. The total is a
    scalar subquery, not a window over one partition."""
    total = df.agg(F.sum(value).alias("t")).scalar()
    return df.withColumn("share_percent", F.when(total != 0, F.round(F.col(value) / total * 100, 2)).otherwise(F.lit(0.0)))


def period_index(df: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """WN-04: zero-based position of a period, counted in ranges of the order."""
    counted = running_sum(df.withColumn("_one", F.lit(1)), by, [order], "_one")
    return counted.withColumn("idx", (F.col("upto") - 1).cast("int")).drop("_one", "upto", "total")


def first_last(df: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """WN-05: first, last, highest and lowest value with their positions; an
    aggregate of structs, so no group is sorted."""
    pos, v = F.col(order), F.col(value)
    aggs = [
        F.min(F.struct(pos.alias("o"), v.alias("v"))).alias("f"), F.max(F.struct(pos.alias("o"), v.alias("v"))).alias("l"),
        F.min(F.struct((-v).alias("v"), pos.alias("o"))).alias("p"), F.min(F.struct(v.alias("v"), pos.alias("o"))).alias("t"),
    ]
    g = (df.groupBy(*by) if by else df).agg(*aggs)
    return g.select(
        *by, F.col("f.v").alias("first_value"), F.col("l.v").alias("last_value"), F.col("p.o").alias("peak_at"),
        (-F.col("p.v")).alias("peak_value"), F.col("t.o").alias("trough_at"), F.col("t.v").alias("trough_value"),
    )


def bh_adjust(df: DataFrame, p: str, by: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """WN-06: Benjamini-Hochberg adjusted p-values within each ``by`` group.

    Rows with a null key are a group; a null p-value has none adjusted.
    p * m / rank, then the running minimum from the largest p, at most 1. Equal
    p-values share the highest rank, so only distinct ones are ranked, in ranges of the
    order of all groups and their values: a range has about ``range_rows`` values, of many
    small groups or of a piece of a large one, and hands its count and minimum on."""
    by = list(by)
    rows = df.filter(F.col(p).isNotNull())
    distinct = materialize(rows.groupBy(*by, F.col(p).alias("_p")).agg(F.count("*").alias("_cnt")), "p-values")
    distinct = in_ranges(distinct, by, ["_p"], max(1, -(-distinct.count() // range_rows))).withColumnRenamed("_part", "_at")
    totals = distinct.groupBy(*by, "_at").agg(F.sum("_cnt").alias("_c"))
    g = Window.partitionBy(*by)
    earlier = Window.unboundedPreceding, -1
    totals = totals.select(*by, "_at", F.coalesce(F.sum("_c").over(g.orderBy("_at").rowsBetween(*earlier)), F.lit(0)).alias("_before"), F.sum("_c").over(g).alias("_m"))
    inside = Window.partitionBy(*by, "_at")
    ranked = join_keys(distinct, totals, [*by, "_at"]).withColumn(
        "_rank", F.col("_before") + F.sum("_cnt").over(inside.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_q", F.col("_p") * F.col("_m") / F.col("_rank"))
    ranked = ranked.withColumn("_least", F.min("_q").over(inside.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)))
    ranked = materialize(ranked.select(*by, "_at", "_p", "_q", "_least"), "p-ranks")
    # the smallest ratio among all larger p-values in other ranges
    low = ranked.groupBy(*by, "_at").agg(F.min("_q").alias("_qmin"))
    low = low.select(*by, "_at", F.min("_qmin").over(g.orderBy(F.desc("_at")).rowsBetween(*earlier)).alias("_later"))
    adjusted = join_keys(ranked, low, [*by, "_at"]).select(*by, "_p", F.least(F.lit(1.0), "_later", "_least").alias("p_adj"))
    back = adjusted.withColumnRenamed("_p", p)
    return join_keys(rows, back, [*by, p]).unionByName(df.filter(F.col(p).isNull()).withColumn("p_adj", F.lit(None).cast("double")))


def latest_per_key(df: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """WN-07: the newest row per key, ties to the smallest ``tie``; an aggregate,
    so a key with many rows is reduced before the shuffle."""
    newest = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(F.col(order).alias("o"), (-F.col(tie)).alias("t"))
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(newest, rank).alias("r")).select("r.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """WN-09: keep the first row of each key."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*names).agg(F.min_by(whole, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order_cols)])).alias("r")).select("r.*")


def top_k(df: DataFrame, by: Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    """WN-08: the ``k`` best rows per group. Spark limits each group per task
    before the shuffle, so hot groups stay small."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def page(df: DataFrame, order: Sequence[str | Column], skip: int, limit: int) -> DataFrame:
    """SO-04: one page of an ordered table."""
    return df.orderBy(*order).offset(skip).limit(limit)


def top_groups(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """SO-05: the most frequent groups."""
    names = [F.col(f"`{c}`") for c in cols]
    return df.groupBy(*names).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *names).limit(n)
