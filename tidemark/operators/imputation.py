"""CL-19..24: roles, imputation with marks, and the two quality scores."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dataset import MASK_PREFIX, Dataset, as_double, is_numeric, is_string, is_temporal
from tidemark.functions.quantiles import quantile_columns
from tidemark.operators.cleaning import col, column_facts, numeric_columns
from tidemark.operators.common import long_rows

# Names that mark identifiers and dates.
ID_NAMES = ("id", "uuid", "key", "code", "guid", "pk")
ID_ENDS = ("_id", "_uuid", "_key", "_code", "_pk", "_guid")
ID_STARTS = ("id_", "uuid_", "key_")
NOT_DATES = ("tenure", "duration", "count", "num", "experience")
DATE_WORDS = ("date", "time", "year", "month", "day", "period", "dob", "timestamp")
CODE_LIKE = r"[A-Za-z]+[-_]?\d+|\d+[-_]?[A-Za-z]+"
STRATEGIES = ("auto", "mean", "median", "mode", "constant", "drop")


def is_id_name(name: str) -> bool:
    low = name.strip().lower()
    return low in ID_NAMES or low.endswith(ID_ENDS) or low.startswith(ID_STARTS)


def role_facts(df: DataFrame) -> DataFrame:
    """(column, non_null, distinct_values, code_like, max_value): text columns
    are counted per value first, so no column needs a distinct of its own.
    ``code_like`` looks at all values, not at the first rows."""
    texts = [c for c in df.columns if is_string(df, c)]
    nums = numeric_columns(df)
    schema = "column string, non_null bigint, distinct_values bigint, code_like boolean, max_value double"
    out = df.sparkSession.createDataFrame([], schema)
    if texts:
        cells = df.select(long_rows([F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in texts]).alias("s")).select("s.*")
        per = cells.filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
        out = out.unionByName(per.groupBy("column").agg(
            F.sum("n").alias("non_null"), F.count("*").alias("distinct_values"),
            F.max(F.col("value").rlike(CODE_LIKE)).alias("code_like"), F.lit(None).cast("double").alias("max_value"),
        ))
    if nums:
        wide = df.agg(*[x for i, c in enumerate(nums) for x in (F.count(col(c)).alias(f"k{i}"), F.max(as_double(c)).alias(f"m{i}"))])
        out = out.unionByName(wide.select(long_rows([
            F.struct(
                F.lit(c).alias("column"), F.col(f"k{i}").alias("non_null"), F.lit(None).cast("long").alias("distinct_values"),
                F.lit(False).alias("code_like"), F.col(f"m{i}").alias("max_value"),
            ) for i, c in enumerate(nums)
        ]).alias("s")).select("s.*"))
    return out


# One of the date words between underscores, and none of the others anywhere.
DATE_NAME = re.compile(rf"(?s)(?!.*(?:{'|'.join(NOT_DATES)}))(?:.*_)?(?:{'|'.join(DATE_WORDS)})(?:_.*)?$")
# Numbers below this in a column of years are lengths of time.
FIRST_YEAR = 1000


def is_date_name(name: str, numeric: bool, max_value: float | None) -> bool:
    low = name.strip().lower()
    spans = numeric and max_value is not None and max_value < FIRST_YEAR and f"_{low}_".find("_year_") >= 0
    return DATE_NAME.match(low) is not None and not spans


def classify_roles(df: DataFrame) -> dict[str, str]:
    """CL-19: identifier, date, categorical or measure per column."""
    facts = {r["column"]: r for r in role_facts(df).collect()}
    roles = {}
    for c in df.columns:
        f = facts.get(c)
        unique = (
            f is not None and f["distinct_values"] is not None and f["non_null"] > 20
            and f["distinct_values"] / f["non_null"] > 0.90 and f["code_like"]
        )
        if is_id_name(c) or unique:
            roles[c] = "identifier"
        elif is_temporal(df, c) or is_date_name(c, is_numeric(df, c), f["max_value"] if f else None):
            roles[c] = "date"
        elif not is_numeric(df, c):
            roles[c] = "categorical"
        else:
            roles[c] = "measure"
    return roles


def measure_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, missing, mean, skew, median). Skewness is bias-corrected; the
    median is exact."""
    base = df.select([as_double(c).alias(f"v{i}") for i, c in enumerate(cols)])
    wide = base.agg(F.count("*").alias("n"), *[
        x for i in range(len(cols))
        for x in (F.count(f"v{i}").alias(f"k{i}"), F.avg(f"v{i}").alias(f"a{i}"), F.skewness(f"v{i}").alias(f"s{i}"))
    ])
    def skew(i: int) -> Column:
        k = F.col(f"k{i}")
        return F.when((k > 2) & ~F.isnan(f"s{i}"), F.col(f"s{i}") * F.sqrt(k * (k - 1.0)) / (k - 2))
    long = wide.select(long_rows([
        F.struct(
            F.lit(c).alias("column"), F.col("n").alias("rows"), (F.col("n") - F.col(f"k{i}")).alias("missing"), F.col(f"a{i}").alias("mean"),
            F.coalesce(skew(i), F.lit(0.0)).alias("skew"),
        ) for i, c in enumerate(cols)
    ]).alias("s")).select("s.*")
    medians = quantile_columns(df, list(cols), {"median": 0.5}).select("column", "median")
    return long.join(medians, "column", "left")


def fill_value(strategy: str) -> Column:
    """CL-20: the fill of a measure from its statistics. AUTO takes the median
    of skewed columns (|skew| > 1), else the mean; CONSTANT is 0; every other
    strategy is the median; a column without values gets 0."""
    if strategy == "constant":
        return F.lit(0.0)
    if strategy == "mean":
        v = F.col("mean")
    elif strategy == "auto":
        v = F.when(F.abs("skew") > 1, F.col("median")).otherwise(F.col("mean"))
    else:
        v = F.col("median")
    return F.coalesce(v, F.lit(0.0))


def imputation_stats(df: DataFrame, roles: dict[str, str], strategy: str = "auto") -> DataFrame:
    """CL-22: one row per column: missing, imputed, rate, strategy, skip reason
    and fill value."""
    reasons = {"identifier": "identifier_column", "date": "date_column", "categorical": "categorical_segment"}
    skipped = [c for c in df.columns if roles[c] != "measure"]
    measures = [c for c in df.columns if roles[c] == "measure"]
    parts = []
    if skipped:
        facts = column_facts(df.select([col(c) for c in skipped]))
        reason = F.create_map(*[F.lit(x) for c in skipped for x in (c, reasons[roles[c]])])
        parts.append(facts.select(
            "column", F.col("null_count").alias("missing_count"), F.lit(0).cast("long").alias("imputed_count"), F.lit(0.0).alias("imputation_rate"),
            F.lit("none").alias("strategy"), F.element_at(reason, F.col("column")).alias("skip_reason"), F.lit(None).cast("double").alias("fill_value"),
        ))
    if measures:
        s = measure_stats(df, measures)
        parts.append(s.select(
            "column", F.col("missing").alias("missing_count"), F.col("missing").alias("imputed_count"),
            F.round(F.col("missing") / F.greatest(F.col("rows"), F.lit(1)), 4).alias("imputation_rate"),
            F.lit(strategy).alias("strategy"), F.lit(None).cast("string").alias("skip_reason"),
            F.when(F.col("missing") > 0, fill_value(strategy)).alias("fill_value"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def imputed_mask(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CL-21: add ``_imputed_<c>`` for cells that are missing before filling."""
    return df.select("*", *[as_double(c).isNull().alias(MASK_PREFIX + c) for c in cols])


def impute(df: DataFrame, stats: Sequence) -> Dataset:
    """CL-20, CL-21: fill the measures that miss values, in one projection."""
    fills = {r["column"]: r["fill_value"] for r in stats if r["fill_value"] is not None and r["imputed_count"] > 0}
    marked = imputed_mask(df, list(fills))
    out = marked.select([
        F.coalesce(as_double(c), F.lit(float(fills[c]))).alias(c) if c in fills else col(c) for c in marked.columns
    ])
    return Dataset(out, list(fills))


def repeated_rows(df: DataFrame) -> DataFrame:
    """CL-23: how many rows repeat another one, told by 128 bits of a hash over all cells
    and which of them are null: 16 bytes a row are shuffled, not the rows."""
    cells = [x for c in df.columns for x in (col(c), col(c).isNull())]
    return df.select(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit(1), *cells).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))


def quality_raw(df: DataFrame, findings: DataFrame) -> DataFrame:
    """CL-23: the score of the raw table. ``findings`` is (column, kind, count)
    with kind ``invalid`` or ``sentinel``.

    100 - (0.7 missing % + duplicate % + 3.5 invalid % + 2.5 sentinel % +
    12 per column of which more than 30 % of rows are defective)."""
    cols = len(df.columns)
    f = findings.groupBy("column").agg(
        F.sum(F.when(F.col("kind") == "invalid", F.col("count")).otherwise(0)).alias("inv"),
        F.sum(F.when(F.col("kind") == "sentinel", F.col("count")).otherwise(0)).alias("sen"),
    )
    per = column_facts(df).join(F.broadcast(f), "column", "left").na.fill(0, ["inv", "sen"])  # one row per column
    t = per.agg(
        F.max("rows").alias("rows"), F.sum("null_count").alias("missing"), F.sum("inv").alias("invalid_count"), F.sum("sen").alias("sentinel_count"),
        F.count_if(F.try_divide(F.col("null_count") + F.col("inv") + F.col("sen"), F.col("rows")) > 0.30).alias("defective_columns"),
    )
    dups = repeated_rows(df).scalar()
    cells = F.col("rows") * cols
    percent = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)) * 100  # noqa: E731  an empty table has no faults
    t = t.withColumn("duplicate_rows", dups)
    score = 100 - (
        percent(0.7 * F.col("missing"), cells) + percent(F.col("duplicate_rows"), F.col("rows"))
        + percent(3.5 * F.col("invalid_count"), cells) + percent(2.5 * F.col("sentinel_count"), cells) + 12.0 * F.col("defective_columns")
    )
    return t.select(
        "rows", F.col("missing").alias("missing_cells"), "duplicate_rows", "invalid_count", "sentinel_count", "defective_columns",
        F.greatest(F.lit(0.0), F.round(score, 1)).alias("quality_raw"),
    )


def quality_clean(ds: Dataset, raw_cells: int) -> DataFrame:
    """CL-24: 100 - (0.4 remaining missing % + 0.3 imputed share of raw cells %)."""
    cols = ds.columns
    wide = ds.df.agg(
        F.count("*").alias("rows"),
        sum([F.count("*") - F.count(col(c)) for c in cols], F.lit(0)).alias("missing"),
        sum([F.count_if(ds.mask(c)) for c in ds.mask_cols], F.lit(0)).alias("imputed"),
    )
    miss = F.coalesce(F.try_divide(F.col("missing"), F.col("rows") * len(cols)), F.lit(0.0)) * 100
    share = F.col("imputed") / F.lit(max(raw_cells, 1)) * 100
    return wide.select(
        F.col("missing").alias("remaining_missing"), F.col("imputed").alias("imputed_cells"),
        F.greatest(F.lit(0.0), F.round(100 - (0.4 * miss + 0.3 * share), 1)).alias("quality_clean"),
    )
