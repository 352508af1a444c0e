"""AN-04, AN-05, AN-07: fence and z-score outliers over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.dataset import Dataset, as_dataset
from tidemark.functions.quantiles import quantile_columns
from tidemark.operators.common import ToolResult, any_of, long_rows, numeric_frame, usable
from tidemark.session import pin

SAMPLE_VALUES = 10


def _observed_values(ds: Dataset, cols: list[tuple[str, Column]]) -> DataFrame:
    return ds.df.select(
        *[usable(ds, c, v).alias(f"v{i}") for i, (c, v) in enumerate(cols)],
        *[ds.mask(c).alias(f"m{i}") for i, (c, _) in enumerate(cols)],
    )


def iqr_limits(ds: Dataset | DataFrame, columns: Sequence[str] | None = None, k: float = 3.0) -> DataFrame:
    """AN-04: quartiles and the k·IQR fence per column. The fence is rounded to
    4 places before it is compared; columns with fewer than 4 values drop out."""
    ds = as_dataset(ds)
    return _iqr_limits(ds, numeric_frame(ds, columns, 0.6), k)


def _iqr_limits(ds: Dataset, cols: list[tuple[str, Column]], k: float) -> DataFrame:
    base = ds.df.select(*[usable(ds, c, v).alias(c) for c, v in cols])
    q = quantile_columns(base, [c for c, _ in cols], {"q25": 0.25, "q75": 0.75}).filter("n >= 4")
    iqr = F.col("q75") - F.col("q25")
    return q.select(
        "column",
        F.round(F.col("q25") - k * iqr, 4).alias("lower_bound"), F.round(F.col("q75") + k * iqr, 4).alias("upper_bound"),
        F.round("q25", 4).alias("q25"), F.round("q75", 4).alias("q75"),
    )


def _z_limits(ds: Dataset, cols: list[tuple[str, Column]], k: float) -> DataFrame:
    base = _observed_values(ds, cols)
    wide = base.agg(*[
        x for i in range(len(cols))
        for x in (F.avg(f"v{i}").alias(f"a{i}"), F.stddev_samp(f"v{i}").alias(f"s{i}"), F.count(f"v{i}").alias(f"n{i}"))
    ])
    long = wide.select(long_rows([
        F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"n{i}").alias("n"))
        for i, (c, _) in enumerate(cols)
    ]).alias("s")).select("s.*").filter("n >= 4 and std > 0")
    return long.select("column", "mean", "std", F.lit(float(k)).alias("z_threshold"))


def _flags(ds: Dataset, cols: list[tuple[str, Column]], limits: dict[str, object], method: str) -> list[tuple[int, str, Column]]:
    out = []
    for i, (c, _) in enumerate(cols):
        lim = limits.get(c)
        if lim is None:
            continue
        v = F.col(f"v{i}")
        if method == "iqr":
            flag = (v < lim["lower_bound"]) | (v > lim["upper_bound"])
        else:
            flag = F.abs((v - lim["mean"]) / lim["std"]) > lim["z_threshold"]
        out.append((i, c, F.coalesce(flag, F.lit(False))))
    return out


def outliers(ds: Dataset | DataFrame, method: str = "iqr", columns: Sequence[str] | None = None, threshold: float = 3.0, key: Sequence[str] | None = None) -> ToolResult:
    """The outlier tool; ``key`` names rows in the forest's result. Limits are one small row per column; the counts of all
    columns and the row-level union (AN-07) then come from one scan."""
    ds = as_dataset(ds)
    method = method.lower().replace("z-score", "zscore").replace("isolationforest", "isolation_forest")
    if method == "isolation_forest":
        from tidemark.operators.forest import isolation_forest

        return isolation_forest(ds, columns, key)
    if method not in ("iqr", "zscore"):
        raise ValueError(f"Unsupported outlier detection method '{method}'. Use 'iqr', 'zscore', or 'isolation_forest'.")
    cols = numeric_frame(ds, columns, 0.6)
    if not cols:
        return ToolResult("detect_outliers", "skipped", "No numeric columns available for outlier detection.")
    limit_table = _iqr_limits(ds, cols, threshold) if method == "iqr" else _z_limits(ds, cols, threshold)
    rows = limit_table.collect()  # at most one row per column
    limits = {r["column"]: r for r in rows}
    spark = ds.df.sparkSession
    base = _observed_values(ds, cols)
    flags = _flags(ds, cols, limits, method)
    wide = pin(base.agg(
        F.count("*").alias("total"),
        F.count_if(any_of([F.col(f"m{i}") for i in range(len(cols))])).alias("imputed_rows"),
        F.count_if(any_of([f for _, _, f in flags])).alias("anomalous"),
        *[F.count_if(f).alias(f"o{i}") for i, _, f in flags],
        *[F.count(f"v{i}").alias(f"u{i}") for i, _, _ in flags],
        *[F.count_if(f"m{i}").alias(f"x{i}") for i, _, _ in flags],
    ), "outliers")
    pct = lambda num, den: F.coalesce(F.round(F.try_divide(num, den) * 100, 2), F.lit(0.0))
    n_used = F.col("total") - F.col("imputed_rows")
    summary = wide.select(
        F.lit(method).alias("method"), F.col("total").alias("total_records"), n_used.alias("n_used"),
        F.col("imputed_rows").alias("n_excluded"), F.col("anomalous").alias("anomaly_count"),
        pct(F.col("anomalous"), n_used).alias("anomaly_rate_percent"),
        sum([F.when(F.col(f"o{i}") > 0, 1).otherwise(0) for i, _, _ in flags], F.lit(0)).alias("columns_with_outliers"),
    )
    tables: dict[str, DataFrame] = {}
    if flags:
        counts = wide.select(long_rows([
            F.struct(
                F.lit(c).alias("column"), F.col(f"o{i}").alias("outlier_count"),
                pct(F.col(f"o{i}"), F.col(f"u{i}")).alias("outlier_percentage"),
                F.col(f"u{i}").alias("n_used"), F.col(f"x{i}").alias("n_excluded"),
            ) for i, c, _ in flags
        ]).alias("s")).select("s.*")
        small = spark.createDataFrame(rows, limit_table.schema)
        tables["column_outliers"] = counts.join(F.broadcast(small), "column")
        flagged = base.select(F.explode(F.array_compact(F.array(*[
            F.when(f, F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("value"))) for i, c, f in flags
        ]))).alias("o")).select("o.*")
        w = Window.partitionBy("column").orderBy("value")
        tables["samples"] = flagged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= SAMPLE_VALUES)
    return ToolResult("detect_outliers", "success", summary=summary, tables=tables, params={"method": method, "threshold": threshold})


def rank_outlier_columns(column_outliers: DataFrame) -> DataFrame:
    """SO-03: columns that have outliers, most first."""
    return column_outliers.filter("outlier_count > 0").orderBy(F.desc("outlier_count"), "column").select(
        "column", F.col("outlier_count").alias("count"), F.col("outlier_percentage").alias("percentage")
    )
