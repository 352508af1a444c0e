"""Prefix trie of conversations by van Emde Boas recursion.

A conversation is a sequence of turns; a node stands for a distinct prefix. The trie is
cut at half its depth, both halves again, and so on until one turn is left:

- blocks of 2, 4, 8 ... turns get names from the names of their halves;
- prefixes get names from the top cut downwards: the cut at half depth first, then the
  cuts of the upper trie and of the lower forests below it together, as both only need
  the names of cuts above them. Equal prefixes have equal names whatever conversation
  they stand in, so each cut merges what its sequences share;
- totals go up in the reverse order: at a cut, the totals of each lower tree are summed
  by the prefix it hangs from and grafted onto that prefix and what is above it inside
  the upper half.

With N turns and a depth of D that is log2(D) steps up and down, each a few joins on
(conversation, place) with at most N / 2 rows: neither a long conversation nor a first
turn that many share gathers in one task, and no node walks all its ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import column, stage

_ROOT = "X'" + "00" * 16 + "'"
#: Rows of one conversation that meet its facts in one place; member ids in one piece of text.
_CHUNK, _IDS = 4096, 4096


def _name(*parts: Column) -> Column:
    """128 bits of the SHA-256 of the parts one after the other."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, i, key, size): each turn with its place from 0, a 128-bit key of role and
    text, and the UTF-8 bytes of its text.

    Turns are ordered by ``turn_col``, null first, turns of equal number by their key. A
    null role or text is empty. Rows without an id belong to no conversation and are left
    out; repeated rows are turns of their own; a text of any length is read once, here.
    """
    role, text = (F.coalesce(column(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = _name(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(column(id_col).cast("long").alias("conv_id"), column(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    rows = rows.where("conv_id is not null").withColumn("any", F.monotonically_increasing_id())
    # ranges of the order, so that one long conversation lies in many parts
    order = [F.col("turn").asc_nulls_first(), "key", "any"]
    dealt = stage(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "trie-turns")
    parts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    here = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order)) - 1
    return dealt.withColumn("here", here).join(parts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("here")).alias("i"), "key", "size")


def lengths(t: DataFrame) -> DataFrame:
    """(conv_id, n): the turns of each conversation."""
    return t.groupBy("conv_id").agg(F.count("*").alias("n"))


def with_heads(t: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of rebuilt conversations: the first ``head`` turns (at most
    ``most``) of conversation ``base`` (all if it has fewer, none if there is none), then
    the conversation's own turns after its first ``head``. Both are columns over
    ``conv_id``. A conversation can end up without turns; its length is 0 then."""
    n = lengths(t)
    info = n.select("conv_id", "n", base.alias("base"), head.cast("long").alias("head"))
    of_base = n.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    info = info.join(of_base, "base", "left").withColumn("lent", F.least("head", F.coalesce("n_base", F.lit(0))))
    info = stage(info, "trie-heads")
    chunk = F.floor(F.col("i") / _CHUNK)
    facts = info.select("conv_id", "head", "lent", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _CHUNK))).alias("chunk"))
    own = t.withColumn("chunk", chunk).join(facts, ["conv_id", "chunk"]).where("i >= head").select("conv_id", (F.col("i") - F.col("head") + F.col("lent")).alias("i"), "key", "size")
    heads = t.where(F.col("i") < most).withColumnRenamed("conv_id", "base").join(info.where("lent > 0").select("conv_id", "base", "head"), "base").where("i < head")
    rebuilt = own.unionByName(heads.select("conv_id", "i", "key", "size"))
    return rebuilt, info.select("conv_id", (F.col("lent") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("n"))


def _named_prefixes(t: DataFrame, convs: DataFrame, levels: int) -> DataFrame:
    """(conv_id, d, name) of every prefix, the empty one included."""
    blocks = [t.select("conv_id", "i", F.col("key").alias("h"))]
    half = lambda k: F.max(F.when(F.col("i") % 2 == k, F.col("h")))
    for _ in range(levels):
        whole = blocks[-1].groupBy("conv_id", F.shiftright("i", 1).alias("at")).agg(F.count("*").alias("m"), half(0).alias("a"), half(1).alias("b"))
        blocks.append(stage(whole.where("m = 2").select("conv_id", F.col("at").alias("i"), _name(F.col("a"), F.col("b")).alias("h")), "trie-blocks"))
    named = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.expr(_ROOT).alias("name"))
    for j in reversed(range(levels + 1)):
        # an even block starts where a cut above has been named and ends at a cut of this level
        below = blocks[j].where(F.col("i") % 2 == 0).select("conv_id", F.shiftleft("i", j).alias("d"), "h")
        cut = named.join(below, ["conv_id", "d"]).select("conv_id", (F.col("d") + 2**j).alias("d"), _name(F.col("name"), F.col("h")).alias("name"))
        named = named.unionByName(stage(cut, "trie-names"))
    return named


def _grafted(own: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """(d, name, leaves, saved): parts of each node's total over its subtree, to be
    summed. ``own`` has a row per node, ``paths`` one per conversation and prefix."""
    parts = own.select("conv_id", "d", "name", "parent", "leaves", "saved")
    for j in range(levels):
        size, half = 2 ** (j + 1), 2**j
        lower = parts.where(F.col("d") % size == (half + 1) % size).groupBy("parent", "d")
        lower = lower.agg(F.min("conv_id").alias("conv_id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        # the cut lies one above; any conversation through it knows the nodes from there up
        lower = lower.select("conv_id", F.shiftright(F.col("d") - 2, j + 1).alias("block"), "leaves", "saved")
        upper = paths.where(F.shiftright(F.col("d") - 1, j) % 2 == 0).withColumn("block", F.shiftright(F.col("d") - 1, j + 1))
        new = upper.join(lower, ["conv_id", "block"]).select("conv_id", "d", "name", "parent", "leaves", "saved")
        parts = parts.unionByName(stage(new, "trie-grafts"))
    return parts.select("d", "name", "leaves", "saved")


def _hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, comma-joined; pieces come in order of node and id."""
    at, state = None, None

    def done(keys, digests):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), pa.array(digests, pa.string())], ["d", "name", "ends"])

    for b in batches:
        keys, digests = [], []
        for d, name, ids in zip(*(b.column(c).to_pylist() for c in ("d", "name", "ids"))):
            if (d, name) != at:
                if at is not None:
                    keys.append(at)
                    digests.append(state.hexdigest())
                at, state = (d, name), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if keys:
            yield done(keys, digests)
    if at is not None:
        yield done([at], [state.hexdigest()])


def _members(ends: DataFrame) -> DataFrame:
    """(d, name, ends) from (d, name, conv_id). A hash has to read its text in order, so
    the ids of a node are joined in many places, and one task reads the pieces."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("d", "name", F.floor(F.col("conv_id") / _IDS).alias("piece")).agg(ids.alias("ids"))
    return pieces.repartition("d", "name").sortWithinPartitions("d", "name", "piece").mapInArrow(_hash_members, "d long, name binary, ends string")


def build(t: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of turns (conv_id, i, key, size); ``convs`` has every
    conversation with its length, also those without turns.

    Columns: ``conv_id`` (smallest member: conversations that start with the node's
    turns), ``depth``, ``parent_conv_id`` (the parent's conv_id, null at the root),
    ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of the subtree, its top
    included), ``saved_tokens`` (over the subtree, bytes of a node's last text times its
    members but one), ``ends_sha256`` (hash of the decimal ids of the conversations that
    end here, ascending, comma-joined). No conversations, no rows; conversations without
    turns are members of the root alone.
    """
    t, convs = stage(t, "trie-rebuilt"), stage(convs, "trie-convs")
    deepest = convs.agg(F.max("n")).first()[0] or 0
    levels = max(deepest - 1, 0).bit_length()
    named = _named_prefixes(t, convs, levels)
    above = named.select("conv_id", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    steps = t.select("conv_id", (F.col("i") + 1).alias("d"), "size")
    paths = stage(steps.join(named, ["conv_id", "d"]).join(above, ["conv_id", "d"]), "trie-paths")

    nodes = paths.groupBy("d", "name").agg(F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("size").alias("size"))
    nodes = stage(nodes, "trie-nodes")
    children = nodes.groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, ["d", "name"], "left").fillna(0, ["n_children"])
    own = own.withColumns({"leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")})
    own = stage(own, "trie-own")

    ends = paths.select("conv_id", F.col("d").alias("n"), "name").join(convs, ["conv_id", "n"]).select(F.col("n").alias("d"), "name", "conv_id")
    ends = ends.unionByName(convs.where("n = 0").select(F.lit(0).cast("long").alias("d"), F.expr(_ROOT).alias("name"), "conv_id"))
    # what is known of a node comes from three places and meets in one sum
    facts = own.select("d", "name", "conv_id", "parent", "n_convs", "n_children")
    totals = facts.unionByName(_grafted(own, paths, levels), True).unionByName(_members(ends), True).groupBy("d", "name").agg(
        *[F.max(c).alias(c) for c in ("conv_id", "parent", "n_convs", "n_children", "ends")], F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
    )
    totals = stage(totals, "trie-totals")
    top = totals.where("d = 1").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root_ends = totals.where("d = 0").agg(F.max("ends").alias("ends"))
    # three tables of one row each
    root = root.withColumns({c: top.select(c).scalar() for c in ("n_children", "leaves", "saved")} | {"ends": root_ends.scalar()})
    root = root.select(
        F.lit(0).cast("long").alias("d"), F.expr(_ROOT).alias("name"), "conv_id", F.lit(None).cast("binary").alias("parent"), "n_convs", "n_children", "ends",
        F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).cast("long").alias("leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved"),
    )
    every = totals.where("d > 0").unionByName(root)
    parents = every.where("n_children > 0").select((F.col("d") + 1).alias("d"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    here = every.join(parents, ["d", "parent"], "left")
    return here.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
