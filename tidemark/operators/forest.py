"""AN-06: isolation forest. Trees are grown on small random subsets, one group
per tree; every row is then scored in Arrow batches against the shipped trees."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dataset import Dataset, as_dataset
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators.common import ToolResult, numeric_frame

TREES = 100
SUBSET = 256
CONTAMINATION = 0.05
SEED = 42


def _mean_path(n: float) -> float:
    """Average depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator) -> list[list[float]]:
    """Nodes as [feature, cut, left, right, path]; feature -1 marks a leaf."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list[float]] = []
    todo = [(x, 0, -1, 0)]
    while todo:
        part, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        spread = part.max(axis=0) - part.min(axis=0)
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(part) <= 1 or len(usable) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + _mean_path(len(part))])
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        nodes.append([f, cut, -1, -1, 0.0])
        left = part[:, f] <= cut
        todo.append((part[~left], depth + 1, me, 1))
        todo.append((part[left], depth + 1, me, 0))
    return nodes


def _copies(batches: Iterator[pd.DataFrame], names: Sequence[str], keep: float) -> Iterator[pd.DataFrame]:
    """Of a vector met ``c`` times, the number of its copies that are drawn: binomial,
    by a generator seeded with the vector's hash. Vectors come here only with one
    copy drawn at least, so they are few."""
    for pdf in batches:
        drawn = []
        for h, c in zip(pdf["h"], pdf["c"]):
            rng = np.random.default_rng(int(h) % 2**63)
            m = 1 if keep < 1 and c * keep < 1e-3 else int(rng.binomial(c, keep))
            while m == 0:
                m = int(rng.binomial(c, keep))
            drawn.append(m)
        out = pdf.loc[np.repeat(pdf.index.to_numpy(), drawn), ["h", *names]]
        yield out.assign(copy=np.concatenate([np.arange(m) for m in drawn]) if drawn else np.empty(0, "int64"))


def _draw(rows: DataFrame, key: Sequence[str], names: Sequence[str], n: int, trees: int, seed: int) -> DataFrame:
    """(tree, u, values): about 1.5 * SUBSET rows a tree, chosen by hashes alone, so
    the same rows are drawn however the table is cut.

    With a key each row is drawn by the key's hash, without a shuffle. Without one,
    equal vectors are counted and drawn as often as chance would draw their copies."""
    share = min(1.0, 1.5 * SUBSET / n)
    keep = min(1.0, share * trees)
    unit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 52)) / float(1 << 52)
    if key:
        met = rows.withColumn("h", F.xxhash64(F.lit(seed), *key)).filter(unit(F.col("h"), F.lit(-1)) < keep)
        copies = met.select("h", F.lit(0).cast("long").alias("copy"), *names)
    else:
        met = rows.groupBy(*names).agg(F.count("*").alias("c")).withColumn("h", F.xxhash64(F.lit(seed), *names))
        if keep < 1.0:  # the chance that no copy is drawn
            met = met.filter(unit(F.col("h"), F.lit(-1)) >= F.exp(F.col("c") * math.log1p(-keep)))
        fields = "h long, " + ", ".join(f"{v} double" for v in names) + ", copy long"
        copies = met.mapInPandas(lambda batches: _copies(batches, names, keep), fields)
    each = copies.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("u", unit(F.col("h"), F.col("copy"), F.col("tree")))
    return each.filter(F.col("u") < share / keep).select("tree", "u", *names)


def isolation_scores(ds: Dataset | DataFrame, columns: Sequence[str] | None = None, trees: int = TREES, seed: int = SEED,
                     key: Sequence[str] | None = None) -> DataFrame | None:
    """Rows with complete numeric cells and their anomaly ``score`` in (0, 1): the
    columns of ``key``, the numeric columns by name (less those of the key), the score
    (``score_`` where a column has that name). None when fewer than 10 rows are complete.

    Scores depend on the rows only, not on their order or partitions. A key should
    tell rows apart: rows with equal keys are drawn together, null keys too."""
    ds = as_dataset(ds)
    cols = numeric_frame(ds, columns, 0.6)
    if not cols:
        return None
    key = list(key or [])
    names = [f"v{i}" for i in range(len(cols))]
    keys = [f"k{i}" for i in range(len(key))]
    rows = ds.df.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(keys, key)], *[v.alias(n) for n, (_, v) in zip(names, cols)]).dropna(subset=names)
    n = rows.count()
    if n < 10:
        return None
    picks = _draw(rows, keys, names, n, trees, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        part = pdf.sort_values(["u", *names])[names].to_numpy()[:SUBSET]
        nodes = _grow(part, np.random.default_rng(seed + tree))
        return pd.DataFrame({"tree": [tree], "size": [len(part)], "nodes": [json.dumps(nodes)]})

    # Bounded: `trees` rows of at most 2 * SUBSET nodes each.
    grown = picks.groupBy("tree").applyInPandas(grow, "tree int, size int, nodes string").collect()
    forest = [np.array(json.loads(r["nodes"]), dtype="float64") for r in sorted(grown, key=lambda r: r["tree"])]
    norm = _mean_path(float(max(r["size"] for r in grown))) or 1.0
    shared = ds.df.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy()
            at_row = np.arange(len(x))
            total = np.zeros(len(x))
            for nodes in shared.value:
                pos = np.zeros(len(x), dtype="int64")
                active = nodes[pos, 0] >= 0
                while active.any():
                    f = np.where(active, nodes[pos, 0], 0).astype("int64")
                    left = x[at_row, f] <= nodes[pos, 1]
                    step = np.where(left, nodes[pos, 2], nodes[pos, 3]).astype("int64")
                    pos = np.where(active, step, pos)
                    active = nodes[pos, 0] >= 0
                total += nodes[pos, 4]
            yield pdf.assign(score=np.power(2.0, -total / len(shared.value) / norm))

    named = {c: v for v, (c, _) in zip(names, cols) if c not in key}
    fields = [*[f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys], *[f"{n} double" for n in names], "score double"]
    scored = rows.mapInPandas(score, ", ".join(fields))
    last = "score"
    while last in key or last in named:
        last += "_"
    return scored.select(*[F.col(k).alias(c) for k, c in zip(keys, key)], *[F.col(v).alias(c) for c, v in named.items()], F.col("score").alias(last))


def isolation_forest(ds: Dataset | DataFrame, columns: Sequence[str] | None = None, key: Sequence[str] | None = None) -> ToolResult:
    """Rows whose score is above the 95 % quantile are anomalous. The table ``scores``
    holds key, values, score and ``is_anomaly``."""
    from tidemark.session import materialize

    ds = as_dataset(ds)
    scores = isolation_scores(ds, columns, key=key)
    if scores is None:
        return ToolResult("detect_outliers", "skipped", "Fewer than 10 complete rows for an isolation forest.")
    scores = materialize(scores, "forest-scores")
    score = F.col(f"`{scores.columns[-1]}`")
    cut = exact_quantiles(scores.select(score.alias("score")), ["score"], [1 - CONTAMINATION]).first()["value"]
    total = ds.df.agg(F.count("*").alias("n")).scalar()
    summary = scores.agg(
        F.count("*").alias("n_used"), F.count_if(score > cut).alias("anomaly_count"),
    ).select(
        F.lit("isolation_forest").alias("method"), total.alias("total_records"), "n_used",
        (total - F.col("n_used")).alias("n_excluded"), "anomaly_count",
        F.round(F.col("anomaly_count") / F.col("n_used") * 100, 2).alias("anomaly_rate_percent"),
    )
    return ToolResult(
        "detect_outliers", "success", summary=summary,
        tables={"scores": scores.withColumn("is_anomaly", score > cut)}, params={"method": "isolation_forest"},
    )
