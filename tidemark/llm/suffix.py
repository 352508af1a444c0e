"""Exact removal of repeated byte strings by a depth-limited radix sort.

Every string of ``length`` bytes is a window, the start of a suffix that is only
ordered as deep as the window goes; equal windows are the groups that such a sort
leaves together. Sorting each suffix by itself would move every byte many times,
so windows that overlap travel together: the 32 bytes inside a window with the
smallest hash are its anchor, found from the window's bytes alone, and the run of
neighbouring windows with one anchor is a context of about 285 bytes.

The digits, most significant first:

1. the hash of the anchor's bytes. Only anchors met at least twice go on;
2. the hash of the whole context. Contexts met twice hold repeated windows only;
   a context alone with its anchor holds none;
3. the hash of each window, for the few contexts that share an anchor with other
   contexts. Groups run inside a task; overfull ones are counted as single rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from tidemark.llm.common import arrow_rows, column, encoded, small_batches, stage, texts

LENGTH, ANCHOR, GROUP, CHUNK = 200, 32, 4096, 1 << 18
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position, built by doubling."""
    one = data.astype(np.uint64) + np.uint64(1)
    cur, have = one, 1
    for step, bit in enumerate(bin(size)[3:]):
        m = _MIX[step % 4]
        cur = cur[: len(cur) - have] * m + (cur[have:] ^ (cur[have:] >> np.uint64(29)))
        have *= 2
        if bit == "1":
            n = len(data) - have
            cur = cur[:n] * m + one[have : have + n]
            have += 1
        cur ^= cur >> np.uint64(31)
    cur = cur * _MIX[1]
    return cur ^ (cur >> np.uint64(32))


def _window_min(v: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while 2 * have <= size:
        v = np.minimum(v[: len(v) - have], v[have:])
        have *= 2
    rest = size - have
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def contexts_of(parts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR):
    """(part, start, windows, anchor hash, context hash) of each context of the parts."""
    raw = b"".join(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    if len(raw) < length:
        return None
    h = rolling(np.frombuffer(raw, np.uint8), anchor)
    place = np.uint64((1 << 22) - 1)
    smallest = _window_min((h & ~place) | np.arange(len(h), dtype=np.uint64), length - anchor + 1) & place
    part = np.repeat(np.arange(len(parts)), sizes)[: len(smallest)]
    ok = np.flatnonzero(np.arange(len(smallest)) + length <= ends[part])
    if not len(ok):
        return None
    at, part = smallest[ok].astype(np.int64), part[ok]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])]))
    windows = np.diff(np.append(first, len(ok)))
    begin, part = ok[first], part[first]
    digest = xxhash.xxh3_64_intdigest
    context = np.array([digest(raw[b:e]) for b, e in zip(begin.tolist(), (begin + windows + length - 1).tolist())], np.uint64)
    return part, begin - (ends - sizes)[part], windows, h[at[first]].view(np.int64), context.view(np.int64)


def _anchor_batches(length: int, anchor: int):
    def flush(keys, shifts, parts):
        if (found := contexts_of(parts, length, anchor)) is None:
            return None
        part, start, windows, kg, ctx = found
        ids, tags = np.array([k[0] for k in keys], np.int64)[part], np.array([k[1] for k in keys], np.int64)[part]
        start = start + np.array(shifts, np.int64)[part]
        return pa.RecordBatch.from_arrays([pa.array(kg), pa.array(ctx), pa.array(ids), pa.array(tags), pa.array((start << 32) | (windows << 16))], ["kg", "ctx", "id", "tag", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, shifts, parts, total = [], [], [], 0
            for k, text in zip(zip(b.column("id").to_pylist(), b.column("tag").to_pylist()), encoded(b)):
                # a long text is cut into runs of window starts; no window is lost
                for shift in range(0, max(len(text) - length + 1, 0), CHUNK):
                    keys.append(k)
                    shifts.append(shift)
                    parts.append(text[shift : shift + CHUNK + length - 1])
                    total += len(parts[-1])
                    if total >= CHUNK:
                        if (out := flush(keys, shifts, parts)) is not None:
                            yield out
                        keys, shifts, parts, total = [], [], [], 0
            if parts and (out := flush(keys, shifts, parts)) is not None:
                yield out

    return run


def _window_hashes(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, window index in it, hash) of every window of the bodies."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    h = rolling(np.frombuffer(b"".join(bodies), np.uint8), length)
    counts = sizes - length + 1
    body = np.repeat(np.arange(len(bodies)), counts)
    index = np.arange(len(body)) - np.repeat(np.cumsum(counts) - counts, counts)
    return body, index, h[(np.cumsum(sizes) - sizes)[body] + index]


def _runs(body: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], (body[1:] != body[:-1]) | (index[1:] != index[:-1] + 1)]))
    return body[first], index[first], np.diff(np.append(first, len(body)))


def _resolve(length: int):
    """Runs of repeated windows in the contexts that were met once; rows come sorted
    by anchor, each anchor's contexts whole."""

    def solve(kg, ctx, c, bodies) -> pa.RecordBatch | None:
        body, index, h = _window_hashes(bodies, length)
        _, at = np.unique(h, return_inverse=True)
        times = np.bincount(at, weights=np.minimum(c, 2)[body])
        hit = (times[at] > 1) & (c[body] == 1)
        if not hit.any():
            return None
        body, low, n = _runs(body[hit], index[hit])
        return pa.RecordBatch.from_arrays([pa.array(kg[body]), pa.array(ctx[body]), pa.array(low.astype(np.int32)), pa.array(n.astype(np.int32))], ["kg", "ctx", "low", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kg, ctx, c, bodies = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), []
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                p = b.slice(at, 2000)
                kg, ctx, c = (np.concatenate([x, p.column(name).to_numpy()]) for x, name in ((kg, "kg"), (ctx, "ctx"), (c, "c")))
                bodies += p.column("body").to_pylist()
                whole = int(np.searchsorted(kg, kg[-1]))  # the last anchor may go on
                if whole and (out := solve(kg[:whole], ctx[:whole], c[:whole], bodies[:whole])) is not None:
                    yield out
                kg, ctx, c, bodies = kg[whole:], ctx[whole:], c[whole:], bodies[whole:]
        if bodies and (out := solve(kg, ctx, c, bodies)) is not None:
            yield out

    return run


def _single_windows(length: int):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        body, index, h = _window_hashes(b.column("body").to_pylist(), length)
        pick = pa.array(body)
        return pa.RecordBatch.from_arrays([*(b.column(x).take(pick) for x in ("kg", "ctx", "c")), pa.array(index.astype(np.int32)), pa.array(h.view(np.int64))], ["kg", "ctx", "c", "low", "h"])

    return run


def _keys(id_col: str, text_col: str) -> list[Column]:
    """A row is found again by its id and a 64-bit hash of its text, so that rows that share
    an id are told apart; rows equal in both have equal spans. Null ids use the text."""
    text = column(text_col).cast("string")
    return [
        F.coalesce(column(id_col).cast("long"), F.xxhash64(text)).alias("id"),
        F.xxhash64(F.lit(1), text).alias("tag"),
    ]


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, spans): per document with any, the byte ranges [a, b, a, b, ...] that
    strings of ``length`` bytes found at least twice cover; ranges may overlap."""
    small_batches(docs)
    keyed = docs.select(*_keys(id_col, text_col), column(text_col).cast("string").alias("text"))
    found = stage(keyed.mapInArrow(_anchor_batches(length, anchor), "kg long, ctx long, id long, tag long, at long"), "suffix-anchors")
    twice = found.groupBy("kg").agg(F.count("*").alias("m")).where("m > 1").select("kg")
    alive = stage(found.join(twice, "kg"), "suffix-digit1")
    contexts = alive.groupBy("kg", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("id", "tag", "at")).alias("rep"))
    contexts = stage(contexts, "suffix-digit2")
    mixed = contexts.groupBy("kg").agg(F.count("*").alias("m")).where("m > 1")
    open_ = contexts.join(mixed, "kg").select("kg", "ctx", "c", "m", F.col("rep.id").alias("id"), F.col("rep.tag").alias("tag"), *_at("rep.at"))
    body = F.expr(f"substr(cast(text AS binary), cast(start + 1 AS int), cast(windows + {length - 1} AS int))")
    bodies = stage(keyed.join(open_, ["id", "tag"]).select("kg", "ctx", "c", "m", body.alias("body")), "suffix-contexts")
    small = bodies.where(F.col("m") <= group).select("kg", "ctx", "c", "body").repartition("kg").sortWithinPartitions("kg")
    runs = small.mapInArrow(_resolve(length), "kg long, ctx long, low int, n int")
    single = bodies.where(F.col("m") > group).mapInArrow(arrow_rows(_single_windows(length)), "kg long, ctx long, c long, low int, h long")
    again = single.groupBy("kg", "h").agg(F.sum("c").alias("t")).where("t > 1").select("kg", "h")
    runs = runs.union(single.where("c = 1").join(again, ["kg", "h"]).select("kg", "ctx", "low", F.lit(1).alias("n")))
    whole = contexts.where("c > 1").select("kg", "ctx", F.lit(0).alias("low"), F.lit(None).cast("int").alias("n"))
    runs = stage(whole.union(runs), "suffix-runs")
    hit = alive.join(runs, ["kg", "ctx"]).select("id", "tag", *_at("at"), "low", "n")
    a = F.col("start") + F.col("low")
    span = hit.select("id", "tag", F.struct(a.alias("a"), (a + F.coalesce("n", "windows") + (length - 1)).alias("b")).alias("s"))
    return span.groupBy("id", "tag").agg(F.sort_array(F.collect_set("s")).alias("s")).select("id", "tag", F.flatten(F.transform("s", lambda s: F.array(s["a"], s["b"]))).alias("spans"))


def _at(name: str) -> list[Column]:
    at = F.col(name)
    return [
        F.shiftright(at, 32).alias("start"),
        F.shiftright(at, 16).bitwiseAND(F.lit(0xFFFF)).alias("windows"),
    ]


def merged(spans) -> list[tuple[int, int]]:
    """Maximal ranges of a flat list of sorted ranges."""
    out: list[tuple[int, int]] = []
    for a, b in zip(spans[::2], spans[1::2]):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _cut(text: str | None, spans) -> tuple[int, list[int], bytes]:
    raw = (text or "").encode()
    flat, kept, at = [], [], 0
    for a, b in merged([] if spans is None else [int(x) for x in spans]):
        flat += [a, b]
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return len(raw), flat, b"".join(kept)


@F.pandas_udf(StructType([StructField("n_bytes", LongType()), StructField("spans", ArrayType(LongType())), StructField("kept", BinaryType())]))
def _cut_texts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, spans in parts:
        yield pd.DataFrame([_cut(t, s) for t, s in zip(text, spans)], columns=["n_bytes", "spans", "kept"])


def remaining_text(raw: bytes, spans: list[int]) -> str:
    """What is left of a text as characters: one goes only if all its bytes go."""
    kept, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        while a < b and raw[a] & 0xC0 == 0x80:  # the rest of a character whose start stays
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:  # a start whose rest stays
            b -= 1
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept).decode()


@F.pandas_udf(StringType())
def _cut_characters(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, spans in parts:
        yield pd.Series([t if s is None else remaining_text(t.encode(), [int(x) for r in merged(s) for x in r]) for t, s in zip(text, spans)], dtype=object)


def _joined(docs: DataFrame, length: int, anchor: int, group: int, id_col: str, text_col: str) -> DataFrame:
    """The documents as one struct column, beside the text and its spans or null."""
    spans = repeated_spans(docs, length, anchor, group, id_col, text_col)
    whole = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("doc")
    return docs.select(whole, column(text_col).cast("string").alias("text"), *_keys(id_col, text_col)).join(spans, ["id", "tag"], "left")


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (maximal removed byte ranges
    [a, b, ...], ends exclusive) and kept, the remaining bytes.

    All copies of a repeated string go, the first included. Null texts are empty:
    nothing is removed and ``kept`` has no bytes; so have texts shorter than ``length``
    no spans. Repeated rows, and rows that share an id, each get a row; null ids stay
    null. An empty table gives no rows.
    """
    if not 1 <= anchor < length < 1 << 15:
        raise ValueError("the anchor has to be shorter than the string, the string than 32,768 bytes")
    rows = texts(docs, id_col, text_col)
    out = _joined(rows, length, anchor, group, "doc_id", "text").select(F.col("doc.c0").alias("doc_id"), _cut_texts.asNondeterministic()("text", "spans").alias("r"))
    return out.select("doc_id", "r.*")


def strip_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the text that repeats cut out, other columns unchanged. A
    character goes only if all its bytes go; null texts stay null."""
    rows = _joined(docs, length, anchor, group, id_col, text_col).select("doc", _cut_characters.asNondeterministic()("text", "spans").alias("left"))
    return rows.select(*[F.col("left").alias(c) if c == text_col else F.col(f"doc.c{i}").alias(c) for i, c in enumerate(docs.columns)])
