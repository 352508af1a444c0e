"""Running sums and carried values over an order, however many rows a group has.

Rows are dealt to parts that follow each other in the order; a group with most of the
rows, or a value range that holds most of them, lies in many parts. Inside a part a
window runs as usual; what comes before it is one number a part, summed over parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

_PART = "_part"


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, null keys with null keys; the keys come once."""
    renamed = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"_r{i}"))
    out = left.join(renamed, on, how)
    if how in ("full", "right"):
        # a key of an unmatched right row stands on the right only
        out = out.withColumns({k: F.coalesce(F.col(f"`{k}`"), F.col(f"_r{i}")) for i, k in enumerate(keys)})
    return out.drop(*[f"_r{i}" for i in range(len(keys))])


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_part``, as a written table: the parts of a group follow each other
    in ``order``. Spark picks the borders from a sample, so only the size of parts
    depends on it. Without ``ranges`` there are as many as shuffles have partitions."""
    keys = [F.col(f"`{k}`") for k in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    return materialize(dealt.withColumn(_PART, F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], weight: str, ranges: int | None = None) -> DataFrame:
    """Adds ``upto``, the sum of ``weight`` up to and with each row, and ``total``."""
    by = list(by)
    rows = in_ranges(df, by, order, ranges)
    group = Window.partitionBy(*[f"`{k}`" for k in by])
    parts = rows.groupBy(*[f"`{k}`" for k in by], _PART).agg(F.sum(weight).alias("_sum"))
    parts = parts.withColumns({
        "_before": F.coalesce(F.sum("_sum").over(group.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("_sum").over(group),
    }).drop("_sum")
    inside = Window.partitionBy(*[f"`{k}`" for k in by], _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = join_keys(rows.withColumn("_here", F.sum(weight).over(inside)), parts, [*by, _PART])
    return out.withColumn("upto", F.col("_before") + F.col("_here")).drop("_before", "_here", _PART)


def carry(df: DataFrame, by: Sequence[str], order: Sequence[str], known: str, ranges: int | None = None) -> DataFrame:
    """Adds ``below`` and ``above``: the last value of ``known`` at or before each row and
    the first at or after it, nulls left out. ``known`` must not fall along ``order``."""
    by = list(by)
    rows = in_ranges(df, by, order, ranges)
    group = Window.partitionBy(*[f"`{k}`" for k in by])
    earlier = Window.unboundedPreceding, -1
    parts = rows.groupBy(*[f"`{k}`" for k in by], _PART).agg(F.max(known).alias("_max"), F.min(known).alias("_min"))
    parts = parts.withColumns({
        "_from_below": F.max("_max").over(group.orderBy(_PART).rowsBetween(*earlier)), "_from_above": F.min("_min").over(group.orderBy(F.desc(_PART)).rowsBetween(*earlier)),
    }).drop("_max", "_min")
    inside, upto = Window.partitionBy(*[f"`{k}`" for k in by], _PART), (Window.unboundedPreceding, 0)
    # both frames end at the row: one that reaches from the row to the end is summed up anew for each
    rows = rows.withColumns({
        "_below": F.last(known, ignorenulls=True).over(inside.orderBy(*order).rowsBetween(*upto)),
        "_above": F.last(known, ignorenulls=True).over(inside.orderBy(*[F.desc_nulls_last(o) for o in order]).rowsBetween(*upto)),
    })
    out = join_keys(rows, parts, [*by, _PART])
    return out.withColumns({"below": F.coalesce("_below", "_from_below"), "above": F.coalesce("_above", "_from_above")}).drop("_below", "_above", "_from_below", "_from_above", _PART)
