"""Mix sources to target weights by pivotal dependent rounding, in SQL functions only.

Each document has an expected number of copies, its source's target over its
source's size. The whole part is certain. The fractional parts meet in pairs: of
two, words' worth of probability moves from one to the other, in a random
direction, until one of them is 0 or 1. Expected copies stay as they were and so
does the expected number of words, so that a source's words differ from its target
by less than one document. Buckets of about 64 documents run this as a fold over
a small array; each leaves at most one fractional document, and those meet in the
next level of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, column, stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST, FAN_IN, SEED = 1.5, 2.0, 64, 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target: the share of all words dealt to sources by
    weight, none above ``most`` times its size.

    With a level L, a source gets min(weight * L, its limit). Ordered by limit over
    weight, the sources at their limit come first, so L is the first level that the
    sources still open can take. The ordered sums run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_need = W.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_need.rowsBetween(W.unboundedPreceding, -1)
    rest = by_need.rowsBetween(W.currentRow, W.unboundedFollowing)
    open_level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", open_level)
    # the first source whose limit lies above the level that it and all later ones can have
    holds = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    per = per.withColumn("final", F.first(holds, ignorenulls=True).over(by_need.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.coalesce(F.col("final") * F.col("weight"), F.col("limit")), F.col("limit"))
    return per.select("source", "source_size", "n_docs", F.greatest(target, F.lit(0.0)).alias("target"))


def _uniform(*parts: Column) -> Column:
    """In [0, 1): the same for the same parts, on any cluster."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / F.lit(float(1 << 30))


_ITEM = "struct<doc_id:bigint,nth:bigint,size:bigint,p:double>"


def _meet(acc: Column, b: Column, level: int, seed: int) -> Column:
    """One step of the fold: the open item of ``acc`` meets ``b``."""
    a = acc["open"]
    # words that can move: into a until it is 1 or b is 0; into b until it is 1 or a is 0
    up = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])
    down = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))
    draw = _uniform(F.lit(seed), F.lit(level), a["doc_id"], a["nth"], b["doc_id"], b["nth"])
    moved = F.when(draw * (up + down) < down, up).otherwise(-down)

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["nth"].alias("nth"), x["size"].alias("size"), p.alias("p"))

    def snapped(p: Column) -> Column:
        return F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)

    pa, pb = snapped(a["p"] + moved / a["size"]), snapped(b["p"] - moved / b["size"])
    x, y = with_p(a, pa), with_p(b, pb)
    x_open, y_open = (pa > 0) & (pa < 1), (pb > 0) & (pb < 1)
    met = F.struct(
        F.when(x_open, x).when(y_open, y).alias("open"),
        F.concat(acc["done"], F.when(x_open, F.array(y)).when(y_open, F.array(x)).otherwise(F.array(x, y))).alias("done"),
    )
    alone = F.struct(b.alias("open"), acc["done"].alias("done"))
    return F.when(a.isNull(), alone).otherwise(met)


def _round_bucket(items: DataFrame, level: int, seed: int) -> DataFrame:
    """Per bucket: the decided items and at most one that is still open."""
    groups = items.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(F.struct("doc_id", "nth", "size", "p"))).alias("items"))
    start = F.struct(F.lit(None).cast(_ITEM).alias("open"), F.array().cast(f"array<{_ITEM}>").alias("done"))
    return groups.select("source", "bucket", F.aggregate("items", start, lambda acc, b: _meet(acc, b, level, seed)).alias("r"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, nth, size, source_size, target, copies, taken.

    ``size`` is the number of words (null text: 0), ``copies`` how often the mix takes
    the document, ``taken`` size times copies. Documents without words are never
    taken. A null source is a source. Rows with equal id, source and size are told
    apart by ``nth`` (from 0); null ids are ids like any other. An empty table gives
    an empty result. The draws depend on ids and the seed only, so reruns agree.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(source_col).alias("source"), n_words(column(text_col)).alias("size"))
    # counted first: a row that is there a million times does not become one task
    sizes = stage(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")).select("doc_id", "source", "size", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("nth")), "mix-sizes")
    goal = stage(targets(sizes, weights, share, most), "mix-targets")
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    g = goal.select(F.col("source").alias("g_source"), "rate", F.greatest(F.ceil(F.col("n_docs") / FAN_IN), F.lit(1)).alias("buckets"))
    whole = F.floor(F.col("rate") + 1e-9)
    dealt = sizes.join(g, F.col("source").eqNullSafe(F.col("g_source")))
    items = dealt.where("size > 0").select(
        "source", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "nth"), F.col("buckets")).alias("bucket"), "doc_id", "nth", "size", F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p"),
    ).where("p > 1e-9")
    most_buckets = g.agg(F.max("buckets")).first()[0] or 1
    decided, level = [], 0
    while True:
        out = stage(_round_bucket(items, level, seed), f"mix-level{level}")
        decided.append(out.select("source", F.inline("r.done")))
        left = out.where("r.open IS NOT NULL").select("source", F.floor(F.col("bucket") / FAN_IN).alias("bucket"), "r.open.*")
        level += 1
        if most_buckets <= 1:
            break
        most_buckets = -(-most_buckets // FAN_IN)
        items = left
    last = left.withColumn("p", (_uniform(F.lit(seed), F.lit(-1), F.col("doc_id"), F.col("nth")) < F.col("p")).cast("double"))
    extra = last.select("source", "doc_id", "nth", "size", "p")
    for d in decided:
        extra = extra.unionByName(d)
    extra = extra.where("p > 0.5").select(F.col("doc_id").alias("x_doc"), F.col("source").alias("x_source"), F.col("nth").alias("x_nth"), F.col("size").alias("x_size"), F.lit(1).alias("one"))
    same = F.col("doc_id").eqNullSafe(F.col("x_doc")) & F.col("source").eqNullSafe(F.col("x_source")) & (F.col("nth") == F.col("x_nth")) & (F.col("size") == F.col("x_size"))
    full = goal.select(F.col("source").alias("t_source"), "source_size", "target", F.floor(F.col("rate") + 1e-9).alias("whole"))
    out = sizes.join(full, F.col("source").eqNullSafe(F.col("t_source"))).join(extra, same, "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(F.col("one"), F.lit(0))).otherwise(0).cast("long")
    return out.select("doc_id", "source", "nth", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as often as the mix takes them, all columns unchanged."""
    names = docs.columns
    keyed = docs.select(
        F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("doc"),
        column(id_col).cast("long").alias("k_doc"), column(source_col).alias("k_source"), n_words(column(text_col)).alias("k_size"), column(text_col).alias("k_text"),
    )
    nth = F.row_number().over(W.partitionBy("k_doc", "k_source", "k_size").orderBy("k_text")) - 1
    keyed = keyed.withColumn("k_nth", nth)
    m = mixed.where("copies > 0").select("doc_id", "source", "nth", "size", "copies")
    same = (F.col("k_doc").eqNullSafe(F.col("doc_id")) & F.col("k_source").eqNullSafe(F.col("source")) & (F.col("k_size") == F.col("size")) & (F.col("k_nth") == F.col("nth")))
    out = keyed.join(m, same).select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(names)])
