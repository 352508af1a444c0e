"""AN-15..19: a metric over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.dataset import Dataset, as_dataset, as_double, is_numeric, is_temporal
from tidemark.functions.dates import parse_date
from tidemark.functions.tails import corr_pvalue
from tidemark.operators.common import ToolResult, currency_to_double
from tidemark.session import pin

STABLE_WITHIN_PERCENT = 5.0
FREQUENCIES = {"M": "month", "ME": "month", "W": "week", "D": "day"}


def trend_points(ds: Dataset | DataFrame, date: str, value: str) -> DataFrame:
    """Observed (ds, y) rows."""
    ds = as_dataset(ds)
    when = F.col(f"`{date}`") if is_temporal(ds.df, date) else parse_date(date)
    y = as_double(value) if is_numeric(ds.df, value) else currency_to_double(value)
    return ds.df.filter(~ds.mask(date) & ~ds.mask(value)).select(
        when.cast("timestamp").alias("ds"), y.alias("y")
    ).filter("ds is not null and y is not null")


def period_end(ds: Column, unit: str) -> Column:
    """The label of a period: month end, the Sunday that ends a week, the day."""
    if unit == "month":
        return F.last_day(ds)
    if unit == "week":
        return F.date_add(F.date_trunc("week", ds).cast("date"), 6)
    return F.to_date(ds)


def auto_unit(points: DataFrame) -> tuple[int, str | None]:
    """AN-15: the number of points, and monthly beyond 180 days, weekly beyond
    30, else daily. No unit when there are fewer than 3 points."""
    row = points.agg(F.count("*").alias("n"), F.floor(F.timestamp_diff("SECOND", F.min("ds"), F.max("ds")) / 86400).alias("span")).first()
    if row["n"] < 3:
        return row["n"], None
    return row["n"], "month" if row["span"] > 180 else ("week" if row["span"] > 30 else "day")


def period_means(points: DataFrame, unit: str) -> DataFrame:
    """AN-15: mean per exact timestamp, then the mean of those means per period.
    Periods without data do not occur."""
    exact = points.groupBy("ds").agg(F.avg("y").alias("y"))
    return exact.groupBy(period_end(F.col("ds"), unit).alias("period")).agg(F.avg("y").alias("y"))


def timeline(periods: DataFrame) -> DataFrame:
    """AN-19: periods in order with their index and a rolling mean over
    max(2, min(5, n // 3)) periods, partial at the start. There is one row per
    calendar period, so one window over them stays small."""
    whole = Window.partitionBy(F.lit(0))
    ordered = whole.orderBy("period")
    size = F.greatest(F.lit(2), F.least(F.lit(5), F.floor(F.col("n_periods") / 3))).cast("int")
    recent = F.reverse(F.collect_list("y").over(ordered.rowsBetween(-4, 0)))
    return periods.withColumns({
        "idx": F.row_number().over(ordered) - 1, "n_periods": F.count("*").over(whole), "_recent": recent,
    }).withColumn("_last", F.slice("_recent", 1, size)).select(
        "period", "idx", "y", F.round("y", 2).alias("value"),
        F.round(F.aggregate("_last", F.lit(0.0), lambda a, x: a + x) / F.size("_last"), 2).alias("rolling_avg"), "n_periods",
    )


def trend_summary(line: DataFrame) -> DataFrame:
    """AN-16..18: OLS over the period index, change from the first to the last
    period, direction, peak and trough (first occurrence)."""
    neg = F.struct((-F.col("y")).alias("neg"), F.col("idx"), F.col("period"))
    pos = F.struct(F.col("y").alias("v"), F.col("idx"), F.col("period"))
    t = line.agg(
        F.count("*").alias("n_periods"), F.regr_slope("y", "idx").alias("slope"), F.corr("y", "idx").alias("r"),
        F.var_pop("y").alias("var"), F.min_by("y", "idx").alias("start"), F.max_by("y", "idx").alias("end"),
        F.min(neg).alias("peak"), F.min(pos).alias("trough"),
    )
    tested = (F.col("n_periods") >= 3) & (F.col("var") > 0)
    r = F.when(tested, F.col("r"))
    pct = F.when(F.col("start") != 0, F.round((F.col("end") - F.col("start")) / F.abs("start") * 100, 2)).otherwise(F.lit(0.0))
    return t.select(
        "n_periods", F.round("slope", 4).alias("linear_slope"),
        F.coalesce(F.round(r, 4), F.lit(0.0)).alias("standardized_slope"), r.alias("_r"),
        F.round("start", 2).alias("start_value"), F.round("end", 2).alias("end_value"),
        pct.alias("percentage_change"),
        F.when(pct <= -STABLE_WITHIN_PERCENT, "downward").when(pct >= STABLE_WITHIN_PERCENT, "upward").otherwise("stable").alias("overall_trend"),
        F.col("peak.period").alias("peak_period"), F.round(-F.col("peak.neg"), 2).alias("peak_value"),
        F.col("trough.period").alias("trough_period"), F.round("trough.v", 2).alias("trough_value"),
    )


def with_trend_p(summary: DataFrame) -> DataFrame:
    """AN-16: two-sided p of the slope (the same test as that of r)."""
    return summary.withColumn("p_value", corr_pvalue(F.col("_r"), F.col("n_periods"))).drop("_r")


def trend(ds: Dataset | DataFrame, date: str, value: str, freq: str = "auto") -> ToolResult:
    """The trend tool: ``timeline`` table and a one-row summary."""
    ds = as_dataset(ds)
    for c in (date, value):
        if c not in ds.columns:
            raise ValueError(f"Column '{c}' not found. Available: {ds.columns}")
    points = trend_points(ds, date, value)
    n_points, unit = auto_unit(points)
    params = {"date": date, "value": value, "unit": unit}
    if unit is None:
        return ToolResult("trend_analysis", "skipped", "Fewer than 3 valid non-imputed date/value pairs found for trend analysis.", params=params)
    if freq != "auto":
        unit = FREQUENCIES[freq.upper()]
    line = pin(timeline(period_means(points, unit)), "timeline")
    total, used = F.lit(ds.df.count()), F.lit(n_points)
    summary = with_trend_p(trend_summary(line)).select(
        F.lit(date).alias("date_column"), F.lit(value).alias("value_column"), "*",
        total.alias("total_records"), used.alias("n_used"), (total - used).alias("n_excluded"),
    )
    return ToolResult("trend_analysis", "success", summary=summary, tables={"timeline": line}, params={**params, "unit": unit})
