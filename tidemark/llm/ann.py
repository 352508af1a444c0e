"""Approximate nearest neighbours by cosine on robust-pruned directed graphs.

Equal vectors are one node. Nodes are dealt to shards of bounded size by a hash;
each shard builds its own graph in one task: greedy searches from the shard's
middle propose neighbours, and relaxed pruning keeps an edge only if no kept one
leads clearly nearer to its end, so that few edges point in many directions. A
query walks every shard's graph with a beam; the shards' best answers, measured in
double precision on the original vectors, are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import column, stage

SHARD, DEGREE, BEAM, ALPHA, SEARCH_BEAM, QUERY_BLOCK = 8192, 32, 64, 1.2, 128, 4096
_BATCH = 512


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit rows as 32-bit floats, for walking; scores do not use them."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In double precision over the last axis, summed in the same order for any shape."""
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) of the ``beam`` nearest nodes found for each query, nearest
    first; -1 where there are fewer. Distances are 1 - cosine; all queries walk at once."""
    n = len(q)
    nodes = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    nodes[:, 0], dist[:, 0] = start, 1 - q @ x[start]
    seen = np.zeros((n, len(x)), bool)
    seen[:, start] = True
    while True:
        todo = ~done & (nodes >= 0)
        rows = np.flatnonzero(todo.any(axis=1))
        if not len(rows):
            return nodes, dist
        pick = todo[rows].argmax(axis=1)
        done[rows, pick] = True
        near = edges[nodes[rows, pick]]
        ok = (near >= 0) & ~seen[rows[:, None], near]
        seen[rows[:, None], near] |= near >= 0
        d = np.where(ok, 1 - np.einsum("ard,ad->ar", x[near], q[rows]), np.inf)
        all_d = np.concatenate([dist[rows], d], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        take = lambda a: np.take_along_axis(a, order, axis=1)
        dist[rows] = take(all_d)
        nodes[rows] = take(np.concatenate([nodes[rows], np.where(ok, near, -1)], axis=1))
        done[rows] = take(np.concatenate([done[rows], np.zeros(ok.shape, bool)], axis=1))


def _prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The kept neighbours of each node of ``own`` among its candidates (-1: none)."""
    cand = np.where(cand == own[:, None], -1, cand)
    d = np.where(cand >= 0, 1 - np.einsum("bcd,bd->bc", x[cand], x[own]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, axis=1), np.take_along_axis(d, order, axis=1)
    v = x[cand]
    between = 1 - v @ v.transpose(0, 2, 1)
    alive = np.isfinite(d)
    rows = np.arange(len(own))
    out = np.full((len(own), degree), -1, np.int64)
    for k in range(degree):
        any_left = alive.any(axis=1)
        if not any_left.any():
            break
        pick = alive.argmax(axis=1)
        out[any_left, k] = cand[rows, pick][any_left]
        # distances are squared lengths up to a factor, hence alpha squared
        alive &= alpha * alpha * between[rows, pick] > d
        alive[rows, pick] = False
    return out


def _add_back(x: np.ndarray, edges: np.ndarray, src: np.ndarray, dst: np.ndarray, degree: int, alpha: float) -> None:
    """Edges dst -> src; a node with more than ``degree`` is pruned again. Where very
    many point at one node they are looked at nearest first, some at a time."""
    order = np.lexsort((1 - np.einsum("ad,ad->a", x[src], x[dst]), dst))
    src, dst = src[order], dst[order]
    _, first, count = np.unique(dst, return_index=True, return_counts=True)
    wide = 2 * degree
    slot = np.arange(len(dst)) - np.repeat(first, count)
    for turn in range(int(slot.max(initial=0)) // wide + 1):
        now = slot // wide == turn
        own, at_own = np.unique(dst[now], return_inverse=True)
        new = np.full((len(own), wide), -1, np.int64)
        new[at_own, slot[now] % wide] = src[now]
        for at in range(0, len(own), _BATCH):
            o, extra = own[at : at + _BATCH], new[at : at + _BATCH]
            held = edges[o]
            extra = np.where((extra[:, :, None] == held[:, None, :]).any(axis=2), -1, extra)
            edges[o] = _prune(x, o, np.concatenate([held, extra], axis=1), degree, alpha)


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """(neighbours of each row or -1, the node to start from) for unit rows."""
    n = len(x)
    start = int((x @ x.mean(axis=0)).argmax())
    edges = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != start]
    for a in (1.0, alpha):
        at, size = 0, 1 if a == 1.0 else _BATCH
        while at < len(order):
            own = order[at : at + size]
            found, _ = beam_search(x, edges, start, x[own], beam)
            edges[own] = _prune(x, own, np.concatenate([found, edges[own]], axis=1) if a > 1 else found, degree, a)
            src, k = np.nonzero(edges[own] >= 0)
            _add_back(x, edges, own[src], edges[own][src, k], degree, a)
            at += size
            size = min(2 * size, _BATCH)
    return edges, start


def _build(degree: int, beam: int, alpha: float):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rep", kind="stable")
        edges, start = build_graph(_unit(np.stack(g["v"]).astype(np.float64)), degree, beam, alpha)
        return pd.DataFrame({"shard": g["shard"], "dim": g["dim"], "node": np.arange(len(g)), "rep": g["rep"], "v": g["v"], "edges": list(edges.astype(np.int32)), "start": np.int32(start)})

    return run


def _search(k: int, beam: int):
    names = ["q", "rep", "score"]

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if graph.empty or asked.empty:
            return pd.DataFrame({"q": np.empty(0, np.int64), "rep": np.empty(0, np.int64), "score": np.empty(0)})
        graph = graph.sort_values("node")
        exact, q = np.stack(graph["v"]).astype(np.float64), np.stack(asked["v"]).astype(np.float64)
        x, edges, rep, ids = _unit(exact), np.stack(graph["edges"]), graph["rep"].to_numpy(), asked["q"].to_numpy()
        out = []
        for at in range(0, len(q), _BATCH):
            part = q[at : at + _BATCH]
            found, _ = beam_search(x, edges, int(graph["start"].iloc[0]), _unit(part), beam)
            score = np.where(found >= 0, cosine(exact[found], part[:, None, :]), -np.inf)
            order = np.lexsort((rep[found], -score), axis=1)[:, :k]
            found, score = np.take_along_axis(found, order, axis=1), np.take_along_axis(score, order, axis=1)
            r, c = np.nonzero(np.isfinite(score))
            out.append(pd.DataFrame(dict(zip(names, (ids[at : at + _BATCH][r], rep[found[r, c]], score[r, c])))))
        return pd.concat(out)

    return run


def usable(v: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA,
            search_beam: int = SEARCH_BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row, its
    own excepted; ``is_query`` is a condition on ``vec_id``.

    Nearest is the largest cosine in double precision, ties go to the smaller id, and a
    query with fewer candidates gets all. Vectors that are null, zero, or hold a null or
    non-finite component take no part, nor do null ids. Rows equal in id and vector are
    one row; of rows with one id and different vectors, each is a candidate and each a
    query. Vectors meet only those of their own length. An empty table gives no rows.
    """
    rows = vectors.select(column(id_col).cast("long").alias("vec_id"), column(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).distinct()
    rows = stage(rows, "ann-rows")
    # of equal vectors only the k + 1 smallest ids can be among anyone's k nearest
    same = W.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).withColumn("rep", F.first("vec_id").over(same))
    members = stage(members, "ann-members")
    nodes = members.where("nth = 1").select("rep", "v", F.size("v").alias("dim"))
    asked = rows.where(is_query)
    classes = asked.select("v").distinct().join(members.where("nth = 1").select("v", "rep"), "v").select(F.col("rep").alias("q"), "v", F.size("v").alias("dim"))
    classes = stage(classes, "ann-queries")
    n, nq = nodes.count(), classes.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-nq // QUERY_BLOCK))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("rep", "v"), F.lit(shards)).cast("int"))
    graph = dealt.groupBy("shard", "dim").applyInPandas(_build(degree, beam, alpha), "shard int, dim int, node int, rep long, v array<double>, edges array<int>, start int")
    graph = stage(graph, "ann-graph")
    # each block of queries meets each shard: both sides carry the pair's name
    at_blocks = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    at_shards = classes.withColumn("block", F.pmod(F.xxhash64("q", "v"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    by = ["shard", "dim", "block"]
    found = at_blocks.groupBy(*by).cogroup(at_shards.groupBy(*by)).applyInPandas(_search(k + 1, search_beam), "q long, rep long, score double")
    best = W.partitionBy("q").orderBy(F.desc("score"), "rep")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    # classes are named by their smallest id, which rows with several vectors can share
    ids = members.select("rep", "vec_id").distinct()
    top = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1)
    answers = found.join(ids, "rep").groupBy("q").agg(top.alias("near"))
    who = asked.join(members.where("nth = 1").select("v", F.col("rep").alias("q")), "v").select("vec_id", "q").distinct()
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = who.withColumnRenamed("vec_id", "query_id").join(answers, "q").select("query_id", F.posexplode(own))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.far")).alias("score"))
