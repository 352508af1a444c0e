"""JN-03..08: joins of claims, numbers, jobs and views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dataset import Dataset
from tidemark.functions.ranges import carry, join_keys

ABS_TOLERANCE = 0.05
REL_TOLERANCE = 0.02


def within(value: Column, reference: Column, tol: float) -> Column:
    """Whether ``value`` is within ``tol`` of ``reference``, relative or absolute."""
    diff = F.abs(value - reference)
    return (diff / F.greatest(F.lit(1e-9), F.abs(reference)) <= tol) | (diff <= tol)


def join_claims(claims: DataFrame, metrics: DataFrame, tol: float = 0.05) -> DataFrame:
    """JN-03: claims whose (source_id, metric_key) exists, with the registered
    value and whether the claimed one is within tolerance. ``metrics`` has one
    value per key."""
    return claims.join(metrics.select("source_id", "metric_key", F.col("value").alias("expected")), ["source_id", "metric_key"]).withColumn(
        "is_match", within(F.col("value"), F.col("expected"), tol)
    )


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def nearest_values(nums: DataFrame, pool: DataFrame, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """(by..., number, lower, upper): the closest pool values at or below and above each
    distinct number. Null keys are a group; numbers and pool values that are null, NaN or
    infinite are left out.

    Both sides are made distinct first, so a value that fills a third of the rows is one
    row here. In one order of both, the last pool value is carried along, across ranges
    of the order: no pairs are built, and a range that holds most numbers is split."""
    by = list(by)
    n = nums.select(*by, F.col("number").cast("double").alias("_x"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_known")).filter(finite(F.col("_x"))).distinct()
    p = pool.select(*by, F.col("value").cast("double").alias("_x"), F.lit(0).alias("_side"), F.col("value").cast("double").alias("_known")).filter(finite(F.col("_x"))).distinct()
    both = carry(n.unionByName(p), by, ["_x", "_side"], "_known", ranges).filter("_side = 1")
    # an equal pool value stands before the number
    upper = F.when(F.col("below") == F.col("_x"), F.col("below")).otherwise(F.col("above"))
    return both.select(*by, F.col("_x").alias("number"), F.col("below").alias("lower"), upper.alias("upper"))


def tolerates(number: Column, candidate: Column, rel: float = REL_TOLERANCE, abs_: float = ABS_TOLERANCE) -> Column:
    diff = F.abs(number - candidate)
    return F.coalesce(((F.abs(candidate) > 0) & (diff / F.abs(candidate) <= rel)) | (diff <= abs_), F.lit(False))


def classify_numbers(
    nums: DataFrame, pool: DataFrame, by: Sequence[str] = (), rel: float = REL_TOLERANCE, abs_: float = ABS_TOLERANCE
) -> DataFrame:
    """JN-04: each distinct ``number`` with ``result`` match, rounding or
    unverifiable, and the pool value it was matched to. Null numbers are left out; NaN
    and infinity are unverifiable, and such pool values match nothing.

    The tolerance grows with the pool value, so if any pool value fits, the
    nearest one below or above does: two candidates decide."""
    by = list(by)
    distinct = nums.select(*by, F.col("number").cast("double").alias("number")).filter("number is not null").distinct()
    n = F.col("number")
    forms = F.array_distinct(F.array(n, F.round(n, 2), F.round(n, 1), truncated(n)))
    values = pool.select(*by, F.col("value").cast("double").alias("value")).filter(finite(F.col("value"))).distinct()
    exact = join_keys(distinct.filter(finite(n)).withColumn("value", F.explode(forms)), values, [*by, "value"]).select(*by, "number").distinct().withColumn("is_exact", F.lit(True))
    lo, hi = F.col("lower"), F.col("upper")
    lo_ok, hi_ok = tolerates(n, lo, rel, abs_), tolerates(n, hi, rel, abs_)
    closer = F.when(lo_ok & hi_ok, F.when(n - lo <= hi - n, lo).otherwise(hi)).when(lo_ok, lo).when(hi_ok, hi)
    exact_hit = F.coalesce(F.col("is_exact"), F.lit(False))
    near = join_keys(distinct, nearest_values(distinct, pool, by), [*by, "number"], "left")
    return join_keys(near, exact, [*by, "number"], "left").select(
        *by, "number",
        F.when(exact_hit, "match").when(lo_ok | hi_ok, "rounding").otherwise("unverifiable").alias("result"),
        F.when(exact_hit, n).otherwise(F.round(closer, 4)).alias("recomputed"),
    )


def truncated(x: Column) -> Column:
    """Without its decimals; a number too large to have any stays as it is."""
    return F.when(F.abs(x) < 2.0**52, F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")).otherwise(x)


def match_numbers(nums: DataFrame, pool: DataFrame, rel: float = REL_TOLERANCE, abs_: float = ABS_TOLERANCE) -> DataFrame:
    """JN-04: rows of ``nums`` that match the pool."""
    ok = classify_numbers(nums, pool, (), rel, abs_).filter("result <> 'unverifiable'").select("number", "result")
    return nums.join(ok, "number")


def unmatched(nums: DataFrame, pool: DataFrame, rel: float = REL_TOLERANCE, abs_: float = ABS_TOLERANCE) -> DataFrame:
    """JN-05: rows of ``nums`` without a match, by a left anti join."""
    ok = classify_numbers(nums, pool, (), rel, abs_).filter("result <> 'unverifiable'").select("number")
    return nums.join(ok, "number", "left_anti")


def found_signals(planted: DataFrame, insights: DataFrame, keys: list[str]) -> DataFrame:
    """JN-06: planted findings that some insight covers, by a left semi join."""
    return planted.join(insights, keys, "left_semi")


def label_jobs(jobs: DataFrame, datasets: DataFrame) -> DataFrame:
    """JN-07: jobs with the name of their dataset, ``Dataset`` if unknown."""
    names = datasets.select(F.col("id").alias("dataset_id"), F.col("filename").alias("dataset_name"))
    return jobs.join(names, "dataset_id", "left").withColumn("dataset_name", F.coalesce("dataset_name", F.lit("Dataset")))


def compare_views(ds: Dataset, sql: str, max_rows: int | None = None) -> DataFrame:
    """JN-08: a statement that joins ``data_clean`` and ``data_observed``."""
    from tidemark.operators.sqlview import query_sql

    return query_sql(ds, sql, max_rows)
