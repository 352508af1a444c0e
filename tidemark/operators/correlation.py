"""AN-01..03: pairwise Pearson correlation on observed cells."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dataset import Dataset, as_dataset
from tidemark.functions.gram import pair_moments
from tidemark.functions.tails import corr_pvalue
from tidemark.operators.common import ToolResult, any_of, long_rows, numeric_frame, usable

# Up to this many pairs are built-in aggregates of one scan; more are matrix products
# of whole batches, also in one scan.
AGGREGATED_PAIRS = 300
# A deviation this small beside the largest value is rounding.
FLAT = 1e-14


def strength(r: Column) -> Column:
    """AN-02: the label of |r| and its direction."""
    a = F.abs(r)
    word = F.when(a >= 0.7, "very strong").when(a >= 0.5, "strong").when(a >= 0.3, "moderate").otherwise("weak")
    return F.concat_ws(" ", word, F.when(r > 0, "positive").otherwise("negative"))


def correlation_pairs(ds: Dataset | DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """AN-01: one row per column pair, pairwise deletion of missing and imputed
    cells, r rounded to 4 places. All pairs come from one scan, whatever their number."""
    ds = as_dataset(ds)
    cols = numeric_frame(ds, columns, 0.6, coerce=False)
    if len(cols) < 2:
        cols = numeric_frame(ds, columns, 0.6)
    return _pairs(ds, cols)


def _pairs(ds: Dataset, cols: list[tuple[str, Column]]) -> DataFrame:
    base = ds.df.select(*[usable(ds, c, v).alias(f"v{i}") for i, (c, v) in enumerate(cols)])
    pairs = list(combinations(range(len(cols)), 2))
    if len(pairs) > AGGREGATED_PAIRS:
        return _many_pairs(base, [c for c, _ in cols])
    # covariance over deviations, as ``corr`` raises where a column is constant; a deviation
    # below the rounding of the largest value is one
    both = {(i, j): F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull() for i, j in pairs}
    wide = base.agg(
        F.count("*").alias("n_total"),
        *[F.max(F.when(F.abs(f"v{i}") < math.inf, F.abs(f"v{i}"))).alias(f"m{i}") for i in range(len(cols))],
        *[x for (i, j), on in both.items() for x in (
            F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}"), F.stddev_pop(F.when(on, F.col(f"v{i}"))).alias(f"x{i}_{j}"),
            F.stddev_pop(F.when(on, F.col(f"v{j}"))).alias(f"y{i}_{j}"), F.count_if(on).alias(f"n{i}_{j}"),
        )],
    )

    def r(i: int, j: int) -> Column:
        x, y = F.col(f"x{i}_{j}"), F.col(f"y{i}_{j}")
        varies = (x > F.col(f"m{i}") * FLAT) & (y > F.col(f"m{j}") * FLAT)
        out = F.when(varies & (F.col(f"n{i}_{j}") >= 2), F.try_divide(F.try_divide(F.col(f"c{i}_{j}"), x), y))
        return F.when(out.isNotNull() & ~F.isnan(out), F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), out)), 4))

    return wide.select("n_total", long_rows([
        F.struct(
            F.lit(cols[i][0]).alias("column_x"), F.lit(cols[j][0]).alias("column_y"),
            r(i, j).alias("correlation"), F.col(f"n{i}_{j}").alias("n_used"),
        ) for i, j in pairs
    ]).alias("p")).select("p.*", (F.col("n_total") - F.col("p.n_used")).alias("n_excluded"))


def _many_pairs(base: DataFrame, names: list[str]) -> DataFrame:
    """The same rows from sums of matrix products. The count of all rows reads no
    column of a columnar table."""
    label = F.array(*[F.lit(n) for n in names])
    total = base.agg(F.count("*").alias("n")).scalar()
    return pair_moments(base).select(
        F.get(label, F.col("i")).alias("column_x"), F.get(label, F.col("j")).alias("column_y"),
        F.round("corr", 4).alias("correlation"), F.col("n").alias("n_used"), (total - F.col("n")).alias("n_excluded"),
    )


def with_strength(pairs: DataFrame, threshold: float = 0.4) -> DataFrame:
    """AN-02: add |r|, the label and whether the pair passes ``threshold``."""
    r = F.col("correlation")
    return pairs.filter(r.isNotNull()).select(
        "*", F.abs(r).alias("abs_correlation"), strength(r).alias("strength"), (F.abs(r) >= threshold).alias("is_strong")
    )


def with_p_value(pairs: DataFrame) -> DataFrame:
    """AN-03: attach the two-sided p-value of every r."""
    return pairs.withColumn("p_value", corr_pvalue(F.col("correlation"), F.col("n_used")))


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    """AN-01: the symmetric matrix in long form, with 1.0 on the diagonal."""
    upper = pairs.select("column_x", "column_y", "correlation")
    lower = pairs.select(F.col("column_y").alias("column_x"), F.col("column_x").alias("column_y"), "correlation")
    names = pairs.select(F.explode(F.array("column_x", "column_y")).alias("column_x")).distinct()
    diagonal = names.select("column_x", F.col("column_x").alias("column_y"), F.lit(1.0).alias("correlation"))
    return upper.unionByName(lower).unionByName(diagonal)


def top_pair(pairs: DataFrame) -> DataFrame:
    """SO-02: the pair with the largest |r|."""
    return pairs.filter("correlation is not null").orderBy(F.abs("correlation").desc(), "column_x", "column_y").limit(1)


def correlation(ds: Dataset | DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.4) -> ToolResult:
    """The correlation tool: pairs with labels and p-values, and a summary."""
    ds = as_dataset(ds)
    cols = numeric_frame(ds, columns, 0.6, coerce=False)
    if len(cols) < 2:
        cols = numeric_frame(ds, columns, 0.6)
    if len(cols) < 2:
        return ToolResult("run_correlation", "skipped", "Fewer than 2 numeric columns found to calculate correlation.")
    pairs = with_p_value(with_strength(_pairs(ds, cols), threshold))
    rows = ds.df.agg(
        F.count("*").alias("total_records"),
        F.count_if(any_of([ds.mask(c) for c, _ in cols])).alias("n_excluded"),
    ).select("total_records", (F.col("total_records") - F.col("n_excluded")).alias("n_used"), "n_excluded")
    return ToolResult(
        "run_correlation", "success", summary=rows, tables={"pairs": pairs},
        params={"columns": [c for c, _ in cols], "threshold": threshold},
    )
