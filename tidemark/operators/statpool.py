"""TX-09: the pool of statistics a table's numbers can be checked against."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dataset import as_double, is_numeric, is_temporal
from tidemark.functions.quantiles import quantile_columns
from tidemark.operators.cleaning import col
from tidemark.operators.common import long_rows
from tidemark.operators.profiling import value_counts
from tidemark.operators.trend import period_means

FENCES = ("1.5", "3.0")


def _named(pairs) -> object:
    return long_rows([F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in pairs]).alias("s")


def stat_pool(df: DataFrame) -> DataFrame:
    """(metric, value): column statistics, missing shares, outlier counts at both
    fences, value counts and shares, group statistics of every label, and dates with the growth between the first and last month."""
    nums = [c for c in df.columns if is_numeric(df, c)]
    dates = [c for c in df.columns if is_temporal(df, c)]
    labels = [c for c in df.columns if c not in nums and c not in dates]
    parts = [_numeric_part(df, nums)]
    if labels:
        counts = value_counts(df, labels)
        rows = df.agg(F.count("*").alias("n")).scalar()
        name = F.concat(F.col("column"), F.lit("="), F.col("value"))
        parts.append(counts.select(F.explode(F.array(
            F.struct(F.concat(name, F.lit(".count")).alias("metric"), F.col("n").cast("double").alias("value")),
            F.struct(F.concat(name, F.lit(".percent")).alias("metric"), (F.col("n") / rows * 100).alias("value")),
        )).alias("s")).select("s.*"))
        parts += [_group_part(df, c, nums) for c in labels if nums]
    parts += [_date_part(df, c, nums) for c in dates]
    return reduce(DataFrame.unionByName, parts)


def _numeric_part(df: DataFrame, nums: list[str]) -> DataFrame:
    pairs = [("rows", F.col("rows")), ("columns", F.lit(len(df.columns)))]
    if not nums:
        return df.agg(F.count("*").alias("rows")).select(_named(pairs)).select("s.*")
    q = {r["column"]: r for r in quantile_columns(df, nums, {"q25": 0.25, "median": 0.5, "q75": 0.75}).collect()}
    nums = [c for c in nums if c in q]
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(nums):
        v, a, b = as_double(c), q[c]["q25"], q[c]["q75"]
        aggs += [F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"), F.sum(v).alias(f"sum{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), F.count(v).alias(f"n{i}")]
        aggs += [F.count_if((v < a - float(k) * (b - a)) | (v > b + float(k) * (b - a))).alias(f"o{k[0]}_{i}") for k in FENCES]
    rows = F.col("rows")
    for i, c in enumerate(nums):
        r = q[c]
        pairs += [(f"{c}.{s}", F.col(f"{s}{i}")) for s in ("mean", "std", "sum", "min", "max")]
        pairs += [(f"{c}.{s}", F.lit(r[s])) for s in ("q25", "median", "q75")] + [(f"{c}.iqr", F.lit(r["q75"] - r["q25"]))]
        missing = rows - F.col(f"n{i}")
        pairs += [(f"{c}.missing", missing), (f"{c}.missing_percent", missing / rows * 100)]
        for k in FENCES:
            o = F.col(f"o{k[0]}_{i}")
            pairs += [(f"{c}.outliers_{k}", o), (f"{c}.outliers_{k}_percent", o / rows * 100)]
    for k in FENCES:
        for i, j in combinations(range(len(nums)), 2):
            both = F.col(f"o{k[0]}_{i}") + F.col(f"o{k[0]}_{j}")
            name = f"outliers_{k}.{nums[i]}+{nums[j]}"
            pairs += [(name, both), (f"{name}_percent", both / rows * 100)]
    return df.agg(*aggs).select(_named(pairs)).select("s.*")


def _group_part(df: DataFrame, label: str, nums: list[str]) -> DataFrame:
    rows = df.filter(col(label).isNotNull())
    med = quantile_columns(rows, nums, {"median": 0.5}, by=[label]).select(col(label).alias("label"), "column", "median")
    g = rows.groupBy(col(label).alias("label")).agg(*[x for i, c in enumerate(nums) for x in (F.count(as_double(c)).alias(f"n{i}"), F.avg(as_double(c)).alias(f"m{i}"))])
    long = g.select("label", long_rows([
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").cast("double").alias("n"), F.col(f"m{i}").alias("mean")) for i, c in enumerate(nums)
    ]).alias("s")).select("label", "s.*").filter("n > 0").join(med, ["label", "column"])
    name = F.concat(F.lit(f"{label}="), F.col("label"), F.lit("."), F.col("column"), F.lit("."))
    return long.select(F.explode(F.array(*[
        F.struct(F.concat(name, F.lit(s)).alias("metric"), F.col(s).alias("value")) for s in ("n", "mean", "median")
    ])).alias("s")).select("s.*")


def _date_part(df: DataFrame, date: str, nums: list[str]) -> DataFrame:
    d = df.filter(col(date).isNotNull()).select(col(date).cast("timestamp").alias("ds"), *[as_double(c).alias(c) for c in nums])
    # Distinct dates by a grouping; months and years then come from those.
    days = d.groupBy("ds").agg(F.lit(1).alias("one"))
    months = days.groupBy(F.date_trunc("month", "ds").alias("m")).agg(F.count("*").alias("n"))
    out = [months.agg(F.sum("n").alias("d"), F.count("*").alias("m"), F.count_distinct(F.year("m")).alias("y")).select(
        _named([(f"{date}.dates", F.col("d")), (f"{date}.months", F.col("m")), (f"{date}.years", F.col("y"))])
    ).select("s.*")]
    for c in nums:
        p = period_means(d.filter(F.col(c).isNotNull()).select("ds", F.col(c).alias("y")), "month")
        first, last = F.col("a"), F.col("z")
        out.append(p.agg(F.count("*").alias("n"), F.min_by("y", "period").alias("a"), F.max_by("y", "period").alias("z")).filter("n >= 2").select(
            _named([(f"{date}.{c}.periods", F.col("n")), (f"{date}.{c}.growth_percent", (last - first) / F.abs(first) * 100)])
        ).select("s.*"))
    return reduce(DataFrame.unionByName, out)


def rounded_forms(pool: DataFrame) -> DataFrame:
    """Each value rounded to 4, 3, 2, 1 and 0 places, as texts quote it."""
    return pool.select("metric", F.explode(F.array_distinct(F.array(*[F.round("value", k) for k in (4, 3, 2, 1, 0)]))).alias("value"))
