"""IN-17, IN-18: chart-ready points, box statistics and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dataset import as_double
from tidemark.functions.quantiles import exact_quantiles

TOP_BARS = 8


def segment_points(stats: DataFrame) -> DataFrame:
    """IN-17: a bar per segment; the error is the standard error of its mean."""
    return stats.select(
        F.lit("bar").alias("chart_type"), F.col("segment").alias("label"), F.col("mean").alias("value"),
        F.round(F.col("std") / F.sqrt("count"), 4).alias("error"),
    )


def matrix_points(matrix: DataFrame) -> DataFrame:
    """IN-17: a heat-map cell per column pair; cells without r count as 0."""
    return matrix.select(F.lit("heatmap").alias("chart_type"), F.col("column_x").alias("x"), F.col("column_y").alias("y"), F.coalesce("correlation", F.lit(0.0)).alias("value"))


def timeline_points(line: DataFrame) -> DataFrame:
    """IN-17: a point per period with its rolling mean."""
    return line.select(F.lit("line").alias("chart_type"), F.col("period").alias("x"), F.col("value").alias("y"), F.col("rolling_avg").alias("rolling"))


def imputation_points(stats: DataFrame, k: int = TOP_BARS) -> DataFrame:
    """IN-17: the ``k`` highest imputation rates in percent."""
    rate = F.round(F.col("imputation_rate") * 100, 1)
    return stats.select(F.lit("bar").alias("chart_type"), F.col("column").alias("label"), rate.alias("value")).filter("value > 0").orderBy(F.desc("value"), "label").limit(k)


def chart_points(kind: str, result: DataFrame) -> DataFrame:
    """IN-17: points of one chart kind."""
    return {"segment": segment_points, "correlation": matrix_points, "trend": timeline_points, "imputation": imputation_points}[kind](result)


def box_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """IN-18: five-number summary over the full columns."""
    q = exact_quantiles(df, cols, [0.0, 0.25, 0.5, 0.75, 1.0])
    names = {0.0: "min", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "max"}
    return q.groupBy("column").agg(*[F.max(F.when(F.col("p") == F.lit(p), F.col("value"))).alias(n) for p, n in names.items()])


def histogram(df: DataFrame, column: str, bins: int = 15) -> DataFrame:
    """IN-18: counts in ``bins`` equal ranges from the smallest to the largest
    value; the last range is closed. Empty ranges have no row."""
    v = as_double(column)
    edge = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    lo, hi = edge["lo"], edge["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, count bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((v - lo) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return df.filter(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("count")).select(
        "bin", F.round(lo + F.col("bin") * width, 6).alias("bin_start"), F.round(lo + (F.col("bin") + 1) * width, 6).alias("bin_end"), "count"
    )
