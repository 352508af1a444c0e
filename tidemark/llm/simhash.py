"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into three segments. Of two fingerprints that differ
in at most two bits, some segment agrees exactly while the next one (in a circle)
differs in at most one bit. A pair of segments gives keys: the exact segment
beside the index of a Golay codeword near the other. The [23,12,7] code is
perfect: every 23-bit word lies within 3 bits of one codeword. A word at distance
3 also takes the five codewords at distance 4; then words one bit apart always
share an index. Fingerprints that share a key are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, column, encoded, stage, texts
from tidemark.llm.components import components, local_forest

SEED, SHINGLE, MAX_BITS = 42, 3, 2
#: Above this many fingerprints under one key, ``_centres`` finds the links instead.
BUCKET = 256
_PAIRS = 500_000
_LOWER = bytes(range(256)).lower()
_SEGMENTS = [(0, 22), (22, 21), (43, 21)]
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the XXH64 bits of all word shingles, A-Z lower-cased, as a signed long."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(s), seed) for s in zip(*(words[k:] for k in range(size)))]
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 300:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _octet_bits() for k in range(8)])
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@lru_cache(1)
def _octet_bits() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, k1, k2) per row; null texts and texts without words have fingerprint
    0. k1 and k2 are 96 bits of hash over id and text, to find the row again."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, size, seed) for t in encoded(b)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64()), b.column("k1"), b.column("k2")], ["doc_id", "fp", "k1", "k2"])

    rows = texts(docs, id_col, text_col)
    return rows.select("*", *_row_keys(F.col("doc_id"), F.col("text"))).mapInArrow(arrow_rows(run), "doc_id long, fp long, k1 long, k2 int")


def _row_keys(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(doc_id, text).alias("k1"), F.hash(doc_id, text).alias("k2")]


def _remainder(x: np.ndarray) -> np.ndarray:
    """Of 23-bit polynomials divided by the generator: 11 bits, 0 for codewords."""
    x = x.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        x ^= np.where((x >> bit) & 1, _GENERATOR << (bit - 11), 0)
    return x


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error to the nearest codeword, its weight, the errors of weight 4."""
    nearest, weight = np.zeros(2048, np.int64), np.zeros(2048, np.int64)
    for w in range(4):
        e = np.array([sum(1 << i for i in c) for c in combinations(range(23), w)], np.int64)
        nearest[_remainder(e)], weight[_remainder(e)] = e, w
    four = np.array([sum(1 << i for i in c) for c in combinations(range(23), 4)], np.int64)
    s = _remainder(four)
    order = np.argsort(s, kind="stable")
    far = np.zeros((2048, 5), np.int64)
    far[weight == 3] = four[order][weight[s[order]] == 3].reshape(-1, 5)
    return nearest, weight, far


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index of a nearby codeword) so that words one bit apart share an index."""
    nearest, weight, far = _golay()
    s = _remainder(words)
    rows, deep = np.arange(len(words)), np.flatnonzero(weight[s] == 3)
    code = (words[deep, None] ^ far[s[deep]]).ravel()
    return np.concatenate([rows, np.repeat(deep, 5)]), np.concatenate([words ^ nearest[s], code]) >> 11


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint, a long of 2 + 22 + 12 bits."""
    u = fps.view(np.uint64)
    parts = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in _SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        r, index = golay_indices(parts[(k + 1) % 3])
        rows.append(r)
        keys.append((k << 34) | (parts[k][r] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _key_batch(b: pa.RecordBatch) -> pa.RecordBatch:
    fps = b.column("fp").to_numpy()
    rows, keys = keys_of(fps)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits


def _same_key(key: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    at = at[at < len(key) - step]
    return at[key[at] == key[at + step]]


def _link(max_bits: int):
    """Star edges of a task's buckets; rows come sorted by key, each bucket whole."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        a, b, step = np.empty(0, np.int64), np.empty(0, np.int64), 1
        at = np.arange(max(len(key) - 1, 0))
        while len(at := _same_key(key, at, step)):
            near = at[_near(fp[at], fp[at + step], max_bits)]
            a, b = np.concatenate([a, fp[near]]), np.concatenate([b, fp[near + step]])
            if len(a) > _PAIRS:  # a forest says as much in fewer edges
                a, b = local_forest(a, b)
            step += 1
        if not len(a):
            return None
        a, b = local_forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            key = np.concatenate([key, b.column("key").to_numpy()])
            fp = np.concatenate([fp, b.column("fp").to_numpy()])
            whole = np.searchsorted(key, key[-1]) if len(key) else 0  # the last bucket may go on
            if (out := links(key[:whole], fp[:whole])) is not None:
                yield out
            key, fp = key[whole:], fp[whole:]
        if (out := links(key, fp)) is not None:
            yield out

    return run


def _centres(dense: DataFrame, max_bits: int) -> DataFrame:
    """Links among fingerprints in overfull buckets without comparing pairs: two
    fingerprints at most two bits apart have a common neighbour at one bit or less
    (at one bit apart, one of them), and all that share one are at most two apart.
    So a group has 65 members at most; each is tied to its smallest."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = b.column("fp").to_numpy()
        bits = np.arange(64, dtype=np.uint64)
        flips = np.uint64(1) << bits
        if max_bits == 2:
            flips, bits = np.concatenate([np.zeros(1, np.uint64), flips]), np.zeros(65, np.uint64)
        near = (fps.view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64)
        # at one bit only direct neighbours link: a pair is named by its smaller and the bit
        centre = near if max_bits == 2 else np.minimum(near, fps[:, None])
        bit = np.tile(bits.astype(np.int32), len(fps))
        return pa.RecordBatch.from_arrays([pa.array(centre.ravel()), pa.array(bit), pa.array(np.repeat(fps, len(flips)))], ["centre", "bit", "fp"])

    at = dense.mapInArrow(arrow_rows(run), "centre long, bit int, fp long")
    low = at.groupBy("centre", "bit").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    return at.join(low, ["centre", "bit"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED, bucket: int = BUCKET,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed long), component (the smallest
    fingerprint reachable over links), component_id (the smallest doc_id there).

    Equal texts meet as one fingerprint before anything is compared. Null and empty
    texts, and texts of white space, share fingerprint 0. A text of fewer words than
    a shingle is one shingle. Repeated rows stay rows. Null ids never become a
    component_id, unless a component has no other: then it is null. An empty table
    gives an empty result.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("the segments find links of at most 2 bits")
    fps = stage(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    keys = distinct.select("fp").mapInArrow(arrow_rows(_key_batch), "key long, fp long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stage(keys.join(shared, "key").select("key", "fp", "n"), "simhash-buckets")
    edges = met.where(F.col("n") <= bucket).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link(max_bits), "a long, b long")
    if max_bits:
        edges = edges.union(_centres(met.where(F.col("n") > bucket).select("fp").distinct(), max_bits))
    root = components(edges)
    classes = distinct.join(root, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("component"))
    classes = stage(classes, "simhash-classes")
    lows = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    of = classes.join(lows, "component").select(F.col("fp").alias("k"), "component", "component_id")
    return fps.join(of, F.col("fp") == F.col("k"), "left").select("doc_id", "fp", "component", "component_id", "k1", "k2")


def keep_one(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns unchanged, less near copies: of each component the
    row with the smallest id stays (null ids last), of rows with equal ids the one
    with the smallest hash, of equal rows one."""
    found = near_duplicates(docs, size, max_bits, id_col=id_col, text_col=text_col)
    best = found.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "k1", "k2")).alias("b")).select("b.k1", "b.k2")
    whole = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("doc")
    keyed = docs.select(whole, *_row_keys(column(id_col).cast("long"), column(text_col).cast("string")))
    kept = keyed.join(best, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(docs.columns)])
