"""IO-14, IO-15: keep cleaned tables and find them again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.dataset import Dataset, as_dataset
from tidemark.plans.clean import CleaningOptions, clean
from tidemark.sources.readers import table_or_none

REPORTS = ("findings", "imputation", "log")


def write_clean(ds: Dataset, path: str) -> str:
    """IO-14: the rows with their ``_imputed_*`` marks as Parquet, and the report
    tables and scores beside them."""
    ds.df.write.mode("overwrite").parquet(f"{path}/data")
    for name in REPORTS:
        if name in ds.report:
            ds.report[name].write.mode("overwrite").parquet(f"{path}/{name}")
    facts = [(k, float(v)) for k, v in ds.report.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    spark = ds.df.sparkSession
    spark.createDataFrame(facts, "metric string, value double").write.mode("overwrite").parquet(f"{path}/scores")
    return path


def read_clean(spark: SparkSession, path: str) -> Dataset | None:
    """A cleaned table written before, with its marks; None if there is none."""
    df = table_or_none(spark, f"{path}/data")
    if df is None:
        return None
    ds = as_dataset(df)
    for name in REPORTS:
        t = table_or_none(spark, f"{path}/{name}")
        if t is not None:
            ds.report[name] = t
    scores = table_or_none(spark, f"{path}/scores")
    if scores is not None:
        ds.report.update({r["metric"]: r["value"] for r in scores.collect()})
    return ds


def load_or_clean(
    spark: SparkSession, name: str, store: str, raw: Callable[[], DataFrame] | None = None, options: CleaningOptions | None = None
) -> Dataset:
    """IO-15: the cleaned copy below ``store`` if there is one; else the raw
    table, registered under ``name`` or given by ``raw``, cleaned and kept."""
    found = read_clean(spark, f"{store}/{name}")
    if found is not None:
        return found
    if raw is not None:
        source = raw()
    elif spark.catalog.tableExists(name):
        source = spark.table(name)
    else:
        raise ValueError(f"Dataset '{name}' could not be found.")
    write_clean(clean(source, options), f"{store}/{name}")
    return read_clean(spark, f"{store}/{name}")
