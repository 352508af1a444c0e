"""Pairwise moments of any number of columns from one scan.

Each task sums masked products of whole Arrow batches and emits one row per column:
its moments with every other column. These are merged by the rule for two samples
(counts, means, centred sums), so large offsets do not eat digits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one matrix product: bounds the memory of a task beside its p x p sums.
BLOCK_ROWS = 8192
PARTS = ("n", "mx", "my", "xx", "yy", "xy", "bad")
# A centred sum this small beside the squares it came from is rounding of a constant.
ROUNDING = 1e-13
_SCHEMA = "i int, " + ", ".join(f"{p} array<double>" for p in PARTS)


def _moments(x: np.ndarray) -> np.ndarray:
    """PARTS x p x p of one block; missing cells are NaN. ``mx`` is the mean of column
    i over the rows that have both, ``my`` that of column j."""
    here = ~np.isnan(x)
    finite = np.isfinite(x)
    first = np.where(finite.any(axis=0), x[finite.argmax(axis=0), np.arange(x.shape[1])], 0.0)
    first = np.where(np.isfinite(first), first, 0.0)
    d = np.where(finite, x - first, 0.0)
    m, w = here.astype("float64"), (here & ~finite).astype("float64")
    n = m.T @ m
    sx, raw, xy = d.T @ m, (d * d).T @ m, d.T @ d
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, sx / n, 0.0)
    xx = raw - sx * mean
    xx = np.where(xx > ROUNDING * raw, xx, 0.0)
    return np.stack([n, mean + first[:, None], (mean + first[:, None]).T, xx, xx.T, xy - sx * mean.T, w.T @ m + m.T @ w])


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of two samples together."""
    na, nb = a[0], b[0]
    n = na + nb
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(n > 0, nb / n, 0.0)
    dx, dy = np.where(na > 0, b[1] - a[1], 0.0), np.where(na > 0, b[2] - a[2], 0.0)
    dx, dy = np.where(nb > 0, dx, 0.0), np.where(nb > 0, dy, 0.0)
    both = na * share
    return np.stack([
        n, np.where(na > 0, a[1] + dx * share, b[1]), np.where(na > 0, a[2] + dy * share, b[2]),
        a[3] + b[3] + dx * dx * both, a[4] + b[4] + dy * dy * both, a[5] + b[5] + dx * dy * both, a[6] + b[6],
    ])


def _rows(ids: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(ids, pa.int32())] + [pa.array([list(s[k]) for s in sums], pa.list_(pa.float64())) for k in range(len(PARTS))]
    return pa.RecordBatch.from_arrays(arrays, ["i", *PARTS])


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        cells = [c.to_numpy(zero_copy_only=False).astype("float64") for c in b.columns]
        for start in range(0, b.num_rows, BLOCK_ROWS):
            one = _moments(np.column_stack([c[start:start + BLOCK_ROWS] for c in cells]))
            total = one if total is None else _merge(total, one)
    if total is not None:
        for i in range(total.shape[1]):
            yield _rows([i], [total[:, i, :]])


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by column: one sum is open at a time."""
    at, total = None, None
    for b in batches:
        ids = b.column("i").to_pylist()
        cells = [b.column(p) for p in PARTS]
        for r, i in enumerate(ids):
            one = np.stack([c[r].values.to_numpy(zero_copy_only=False) for c in cells])
            if i != at:
                if at is not None:
                    yield _rows([at], [total])
                at, total = i, one
            else:
                total = _merge(total, one)
    if at is not None:
        yield _rows([at], [total])


def pair_moments(values: DataFrame) -> DataFrame:
    """(i, j, n, corr) of every pair i < j of the double columns of ``values``, by
    position. NULL and NaN cells leave a pair; corr is NULL for fewer than two rows, a
    constant column, or an infinite cell among the pair's rows.

    A task holds seven p x p sums (56 MB for 1,000 columns). Tasks are as many as run
    at once, or twice that, so what is merged does not grow with the rows."""
    spark = values.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, 1)
    p = len(values.columns)
    parts = values.coalesce(tasks).mapInArrow(_sum_rows, _SCHEMA)
    merged = parts.repartition("i").sortWithinPartitions("i").mapInArrow(_merge_rows, _SCHEMA)
    pairs = merged.select("i", F.posexplode(F.arrays_zip(*PARTS)).alias("j", "s")).where("j > i").select("i", "j", "s.*")
    # the whole mean is known here: sums at the size of its rounding are constants
    flat = (F.col("xx") <= F.col("n") * F.col("mx") * F.col("mx") * 1e-28) | (F.col("yy") <= F.col("n") * F.col("my") * F.col("my") * 1e-28)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))))
    ok = (F.col("n") >= 2) & (F.col("xx") > 0) & (F.col("yy") > 0) & ~flat & (F.col("bad") == 0)
    found = pairs.select("i", "j", F.col("n").cast("long").alias("n"), F.when(ok, r).alias("corr"))
    # a table without rows has no sums: its pairs have none either
    grid = spark.range(p).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(p)))).where(f"j > i and j < {p}")
    return grid.join(found, ["i", "j"], "left").select("i", "j", F.coalesce("n", F.lit(0)).alias("n"), "corr")
