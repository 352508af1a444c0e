"""Hard negatives by threshold joins over integer vectors.

Rows are dealt to blocks of bounded size. A block's index takes dimensions by falling
energy and leaves out, for each row, the last ones, where the norm of what remains can
no longer reach the threshold. A join adds up partial scores over the indexed
dimensions, drops what the remaining norms cannot lift to the anchor's threshold, and
scores the rest in full. Thresholds start high and are lowered, anchor by anchor, until
its window is full or its lower end is reached; a full window raises the threshold for
the rows that follow. The blocks' best rows are merged.

Two joins run over the table: one fills each anchor's positives, one the windows below
its positives' scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import column, stage

#: Rows and anchors that meet in one task; rows and anchors that meet at once there.
ROWS, ANCHORS, _ROWS, _ANCHORS = 16_384, 65_536, 8192, 256
#: Where thresholds stop on their way from the top of a window to its lower end.
_STOPS = (0.75, 0.625, 0.5, 0.25, 0.0)
_CUTS = (0.0, 0.125, 0.25, 0.5, 1.0)
_LAST = int(np.iinfo(np.int64).max)


class Index:
    """Rows of whole numbers, indexed by dimensions of falling energy."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(-(x * x).sum(axis=0), kind="stable")
        self.cuts = sorted({round(c * x.shape[1]) for c in _CUTS})
        self.tails = self._tails(x)
        self.largest = self.tails[:, 0].max(initial=0.0)

    def _tails(self, x: np.ndarray) -> np.ndarray:
        """The norm of each row from each cut on."""
        y = x[:, self.order]
        return np.stack([np.sqrt((y[:, c:] * y[:, c:]).sum(axis=1)) for c in self.cuts], axis=1)

    def join(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of all pairs whose score is at least the query's ``least``."""
        tails = self._tails(q)
        if tails[:, 0].max(initial=0.0) * self.largest >= 2.0**53:
            return self._join_large(q, least)
        # what rounding of the norms can hide; scores themselves are exact
        slack = 0.5 + 1e-9 * tails[:, 0] * self.largest
        need = least - slack
        live, acc = np.arange(len(self.x)), np.zeros((len(q), len(self.x)))
        found = []

        def keep(rows: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
            return sums + tails[:, k, None] * self.tails[rows, k][None, :] >= need[:, None]

        for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            indexed = self.tails[live, k] * tails[:, k].max() >= need.min()
            if not indexed.all():  # the rest of these rows is not in the index
                left = live[~indexed]
                i, r = np.nonzero(keep(left, acc[:, ~indexed], k))
                found.append((i, left[r]))
                live, acc = live[indexed], acc[:, indexed]
            dims = self.order[a:b]
            acc = acc + q[:, dims] @ self.x[np.ix_(live, dims)].T
            some = keep(live, acc, k + 1).any(axis=0)
            live, acc = live[some], acc[:, some]
        i, r = np.nonzero(acc >= need[:, None])
        found.append((i, live[r]))
        i, r = (np.concatenate(c) for c in zip(*found))
        score = np.einsum("ad,ad->a", q[i], self.x[r])
        ok = score >= least[i]
        return i[ok], r[ok], score[ok]

    def _join_large(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same in whole numbers of any size, where doubles would round."""
        whole = lambda a: np.array([[int(v) for v in row] for row in a], object).reshape(a.shape)
        score = whole(q) @ whole(self.x).T
        i, r = np.nonzero(score >= least[:, None])
        return i, r, score[i, r]


def best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each ``i`` are: larger scores first, ties by the smaller id."""
    order = np.lexsort((ids, -score, i))
    at = i[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    return order[nth < k]


def fill(index: Index, ids: np.ndarray, q: np.ndarray, accepts, low: np.ndarray, high: np.ndarray, k: int, full: np.ndarray):
    """(query, row, score): enough rows for the k best of each query with a score from
    ``low`` to ``high`` that ``accepts(query, row)`` takes. ``full`` is the score of the
    k-th best row that a query already has (-inf: fewer)."""
    reach = np.linalg.norm(q, axis=1) * index.largest + 1
    floor = np.nextafter(low.astype(float), -np.inf)  # ends are longs, thresholds doubles
    top, end = np.minimum(high, reach), np.maximum(floor, -reach)
    todo = np.flatnonzero((low <= high) & (top >= end))
    got, before = [], np.full(len(q), np.inf)
    for stop in _STOPS:
        if not len(todo):
            break
        least = np.where(stop > 0, end[todo] + stop * (top[todo] - end[todo]), floor[todo])
        least = np.maximum(least, full[todo])
        i, r, score = index.join(q[todo], least)
        i = todo[i]
        new = (score < before[i]) & (score <= high[i]) & (score >= low[i])
        i, r, score = i[new], r[new], score[new]
        ok = accepts(i, r)
        got.append((i[ok], r[ok], score[ok]))
        i, r, score = (np.concatenate(c) for c in zip(*got))
        kept = best(i, ids[r], score, k)
        got = [(i[kept], r[kept], score[kept])]
        before[todo] = least
        # full, or nothing below can be among the best
        done = (np.bincount(got[0][0], minlength=len(q))[todo] >= k) | (full[todo] >= least) | (least <= floor[todo])
        todo = todo[~done]
    return got[0] if got else (np.empty(0, int),) * 3


def _search(k: int, same: bool):
    """Cogrouped: each query's k best rows of one block, of its own label or of others."""
    schema = {"anchor": np.int64, "mark": np.int64, "low": np.int64, "high": np.int64, "vec_id": np.int64, "score": np.int64}

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            rows = rows.sort_values(["vec_id", "mark"], kind="stable")
            x, label, ids, mark = np.stack(rows["v"]).astype(float), rows["label"].to_numpy(), rows["vec_id"].to_numpy(), rows["mark"].to_numpy()
            parts = [(slice(a, a + _ROWS), Index(x[a : a + _ROWS])) for a in range(0, len(x), _ROWS)]
            for a in range(0, len(asked), _ANCHORS):
                some = asked.iloc[a : a + _ANCHORS]
                q, own, who, which = np.stack(some["v"]).astype(float), some["label"].to_numpy(), some["anchor"].to_numpy(), some["mark"].to_numpy()
                low, high = some["low"].to_numpy(), some["high"].to_numpy()
                full = np.full(len(q), -np.inf)
                held = (np.empty(0, int), np.empty(0, int), np.empty(0))
                for at, index in parts:
                    def accepts(i, r, at=at):
                        if not same:
                            return label[at][r] != own[i]
                        return (label[at][r] == own[i]) & ((ids[at][r] != who[i]) | (mark[at][r] != which[i]))

                    i, r, score = fill(index, ids[at], q, accepts, low, high, k, full)
                    i, r, score = (np.concatenate(c) for c in zip(held, (i, r + at.start, score)))
                    kept = best(i, ids[r], score, k)
                    held = i, r, score = i[kept], r[kept], score[kept]
                    n = np.bincount(i, minlength=len(q))
                    last = np.searchsorted(i, np.arange(len(q)), "right") - 1
                    full = np.where(n >= k, score[np.maximum(last, 0)].astype(float) if len(score) else -np.inf, -np.inf)
                # beyond a long there is no score to return but the nearest
                exact = np.array([min(max(int(s), -_LAST - 1), _LAST) for s in score], np.int64)
                out.append(pd.DataFrame(dict(zip(schema, (who[i], which[i], low[i], high[i], ids[r], exact)))))
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, t) for c, t in schema.items()})

    return run


_FOUND = "anchor long, mark long, low long, high long, vec_id long, score long"


def _joined(rows: DataFrame, asked: DataFrame, k: int, same: bool, per: list[str]) -> DataFrame:
    """The k best rows of each query over all blocks, with ``nth`` from 1."""
    blocks, groups = max(1, -(-rows.count() // ROWS)), max(1, -(-asked.count() // ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "mark"), F.lit(blocks)).cast("int")).withColumn("part", every(groups))
    right = asked.withColumn("part", F.pmod(F.xxhash64("anchor", "mark"), F.lit(groups)).cast("int")).withColumn("block", every(blocks))
    by = ["block", "part", "dim"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_search(k, same), _FOUND)
    order = W.partitionBy(*per).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become ``floor(scale * x)``; a score is the inner product of those.
    ``is_anchor`` is a condition on ``vec_id``. An anchor's positives are the first rows
    of its label, by larger scores, ties by the smaller id; a positive's negatives are
    the first rows of other labels whose score is between ``low`` and ``high`` percent of
    the positive's, both included. Where there are fewer, all are returned; an anchor
    without positives, or a positive without negatives, gives no rows.

    Rows with a null label, a null vector, or a null or non-finite component take no
    part. A null id comes after all others and is no anchor. Rows equal in id, label and
    vector are one row; of rows with one id and different content each is an anchor and
    a candidate of its own. Labels are whole numbers, others are compared by a hash. Vectors meet only those of their own length. Vectors of any
    length are taken whole; scores past 2^53 are computed in whole numbers. A score past a
    long becomes the nearest long, from which its window follows.
    """
    x = lambda v: v.cast("double") * F.lit(float(scale))
    whole = lambda v: F.when(F.abs(x(v)) < 2.0**52, F.floor(x(v)).cast("double")).otherwise(x(v))
    fine = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(x(v)) < float("inf")))
    label = column(label_col).cast("long") if dict(vectors.dtypes)[label_col] in ("tinyint", "smallint", "int", "bigint") else F.when(column(label_col).isNotNull(), F.xxhash64(column(label_col)))
    rows = vectors.select(column(id_col).cast("long").alias("vec_id"), label.alias("label"), column(vector_col).alias("e")).where(F.col("label").isNotNull() & F.col("e").isNotNull() & fine)
    rows = rows.select("vec_id", "label", F.transform("e", whole).alias("v")).distinct()
    rows = rows.select(F.coalesce("vec_id", F.lit(_LAST)).alias("vec_id"), F.xxhash64("label", "v").alias("mark"), "label", "v", F.size("v").alias("dim"), is_anchor.alias("asks"))
    rows = stage(rows, "negatives-rows")
    anchors = stage(rows.where("asks").withColumnRenamed("vec_id", "anchor").drop("asks"), "negatives-anchors")
    rows, ends = rows.drop("asks"), {"low": F.lit(-_LAST), "high": F.lit(_LAST)}
    near = _joined(rows, anchors.withColumns(ends), positives, True, ["anchor", "mark"])
    near = stage(near.select("anchor", "mark", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    share = lambda p: F.col("positive_score").cast("decimal(20,0)") * p / 100
    ends = {"low": F.ceil(share(low)).cast("long"), "high": F.floor(share(high)).cast("long")}
    # positives of one score have the same window
    windows = near.select("anchor", "mark", "positive_score").distinct().withColumns(ends)
    per = ["anchor", "mark", "low", "high"]
    asked = anchors.join(windows.where("low <= high").select(*per).distinct(), ["anchor", "mark"])
    found = _joined(rows, asked, negatives, False, per).select(*per, F.col("vec_id").alias("negative_id"), F.col("nth").alias("rank"), F.col("score").alias("negative_score"))
    known = lambda c: F.when(F.col(c) != _LAST, F.col(c)).alias(c)
    return near.withColumns(ends).join(found, per).select(
        F.col("anchor").alias("anchor_id"), known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score",
    )
