"""Best-fit packing of token sequences, hierarchically.

Each input partition tokenizes its documents and packs them best-fit, largest
first. Bins that are nearly full are final. The others become items themselves:
nodes of a tree with fan-in 8 gather them from several partitions and pack again,
level by level, until one node is left or no node can take more.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from operator import add
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage, texts

CAPACITY, SLACK, FAN_IN, NODE_ITEMS = 4096, 8, 8, 1_000_000
#: Cached words per worker; a cache only, the ids do not depend on it.
CACHED_WORDS, CACHED_LENGTH = 800_000, 64
#: Words that go to the merges at once.
MERGED = 250
#: Letters and then ASCII marks without an apostrophe, which would join a contraction.
_PLAIN = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]*)")


def _certain(letters: str) -> bool:
    """Whether Python's case and classes are the vocabulary's beyond doubt."""
    return max(letters) < "\u0530" and "\u0130" not in letters and "\u03a3" not in letters and letters.isalpha() and is_normalized("NFC", letters)


class WordTokenizer:
    """Token ids of whole texts for a vocabulary that lower-cases and drops white space:
    the ids of a text are those of its words in order, so a frequent word is encoded
    once and looked up once for many texts. A word of letters and closing marks is the
    letters' ids and the marks' ids; letters in any case share theirs and go to the
    merges alone, many at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._whole, self._letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._letters.normalizer = normalizers.Sequence([])
        self._letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, mark = self._letters.get_vocab(), self._letters.model.end_of_word_suffix
        #: Which ids end a word, where the vocabulary says so.
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)
        self._last[[i for t, i in vocabulary.items() if mark and t.endswith(mark)]] = True
        self._ids: dict[str, bytes] = {"": b""}
        self._parts: dict[str, bytes] = {"": b""}

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null has none."""
        if not len(texts):
            return []
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._ids) > CACHED_WORDS:
            self._ids = {"": b""}
        if len(self._parts) > CACHED_WORDS:
            self._parts = {"": b""}
        ids = self._ids
        found = list(map(ids.get, names))
        new = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(new, self._encode([names[i] for i in new])):
            found[i] = x
            if len(names[i]) <= CACHED_LENGTH:
                ids[names[i]] = x
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        # each word's ids, copied from where its name has them
        flat, at = np.frombuffer(b"".join(found), "<u4"), words.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        out = flat[np.repeat((np.cumsum(sizes) - sizes)[at] - ends + n, n) + np.arange(n.sum())]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *pc.list_value_length(split).to_pylist()])].tolist()
        return [out[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word; those of letters and of marks are kept."""
        letters, marks, rest, match = [], [], [], _PLAIN.fullmatch
        for w in words:
            x, y = None, ""
            if len(w) <= CACHED_LENGTH:
                if w.isascii() and w.isalpha():
                    x = w.lower()
                elif (m := match(w)) and (m[1].isascii() or _certain(m[1])):
                    x, y = m[1].lower(), m[2]
            if x is None:
                rest.append(w)
            letters.append(x)
            marks.append(y)
        parts = self._parts
        self._merge([x for x in dict.fromkeys(letters) if x is not None and x not in parts])
        new = [y for y in set(marks) if y not in parts]
        encoded = self._whole.encode_batch_fast(new + rest, add_special_tokens=False)
        other = [array("I", e.ids).tobytes() for e in encoded]
        parts.update(zip(new, other))
        others = iter(other[len(new):])
        return [next(others) if x is None else parts[x] + parts[y] if y else parts[x] for x, y in zip(letters, marks)]

    def _merge(self, letters: list[str]) -> None:
        """Add the letters to the known parts."""
        for at in range(0, len(letters), MERGED):
            some = letters[at : at + MERGED]
            text = " ".join(some)
            ids = np.array(self._letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._last[ids]) + 1
            if len(ends) != len(some):  # the ids do not tell where words end
                word = self._letters.encode(text, add_special_tokens=False).word_ids
                ends = np.searchsorted(np.array(word, np.int64), np.arange(len(some)), side="right")
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            self._parts.update((w, raw[a:b]) for w, a, b in zip(some, [0, *ends], ends))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, and each bin's fill: largest first, each into the
    open bin that it leaves the least room in."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r is set if a bin has room r
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = free >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            r, k = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = k, fill[k]
        fill[k] += size
        if r > size:
            room[r - size].append(k)
            free |= 1 << (r - size)
    return bins, offsets, np.array(fill, np.int64)


_PIECE = "doc_id long, piece int, start long, length long, digest long, ids array<int>, bin long, offset long, fill long"


def _pack_partition(path: str, end_id: int, capacity: int, digest, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        doc_id, piece, start, length, mark, kept = [], [], [], [], [], []
        for b in (x.slice(at, 1000) for x in batches for at in range(0, x.num_rows, 1000)):
            ids_of = encode(b.column("text"))
            for d, ids in zip(b.column("doc_id").to_pylist(), ids_of):
                ids += end
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    doc_id.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    mark.append(digest(part) if digest else None)
                    kept.append(np.frombuffer(part, "<i4") if keep_ids else None)
        if not doc_id:
            return
        bins, offsets, fill = best_fit(np.array(length, np.int64), capacity)
        bin_id = bins + (TaskContext.get().partitionId() << 32)
        cols = [pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(mark, pa.int64()),
                pa.array(kept, pa.list_(pa.int32())), pa.array(bin_id), pa.array(offsets), pa.array(fill[bins])]
        whole = pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _PIECE.split(", ")])
        for at in range(0, whole.num_rows, 10_000):
            yield whole.slice(at, 10_000)

    return run


def _pack_node(level: int, capacity: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        bins, offsets, fill = best_fit(items["fill"].to_numpy(), capacity)
        into = bins + ((level << 56) | (int(items["node"].iloc[0]) << 32))
        return pd.DataFrame({"node": items["node"], "bin": items["bin"], "into": into, "at": offsets, "into_fill": fill[bins]})

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, slack: int = SLACK,
         digest: Callable[[bytes], int] | None = None, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, digest, ids, sequence_id, offset.

    A document is its token ids and ``end_id``; only one longer than ``capacity`` is
    cut. ``digest`` maps a piece's ids (little-endian unsigned 32-bit) to a long;
    ``keep_ids`` adds the ids themselves. Null and empty texts are the end id alone.
    Each of several equal rows is packed; ids may be null. Sequences have no gaps. A
    bin with at most ``slack`` free places is final. An empty table gives no rows.
    """
    rows = texts(docs, id_col, text_col).mapInArrow(_pack_partition(tokenizer_path, end_id, capacity, digest, keep_ids), _PIECE)
    pieces = stage(rows, "pieces")
    open_bin = F.col("fill") < capacity - slack
    # a bin's first item stands for it
    items = pieces.where(open_bin & (F.col("offset") == 0)).select("bin", "fill", F.shiftright("bin", 32).alias("part"))
    left, parts = items.agg(F.count("*"), F.coalesce(F.max("part"), F.lit(0))).first()
    # which bin, and where in it, each open bin of the first level has come to
    place = items.select(F.col("bin").alias("first"), F.col("bin").alias("into"), F.lit(0).cast("long").alias("at"))
    nodes, level = parts + 1, 0
    while left > 1:
        fewer = max(-(-nodes // FAN_IN), -(-left // NODE_ITEMS))
        if level and fewer >= nodes:
            break
        nodes, level = fewer, level + 1
        node = F.pmod(F.floor(F.col("part") / FAN_IN), F.lit(nodes)) if level == 1 else F.pmod(F.floor(F.col("node") / FAN_IN), F.lit(nodes))
        dealt = items.select("bin", "fill", node.cast("long").alias("node"))
        moved = stage(dealt.groupBy("node").applyInPandas(_pack_node(level, capacity), "node long, bin long, into long, at long, into_fill long"), f"pack-level{level}")
        step = moved.select(F.col("bin").alias("k"), F.col("into").alias("to"), F.col("at").alias("by"))
        place = stage(place.join(step, F.col("into") == F.col("k"), "left").select("first", F.coalesce("to", "into").alias("into"), (F.col("at") + F.coalesce("by", F.lit(0))).alias("at")), f"pack-places{level}")
        items = moved.where((F.col("at") == 0) & (F.col("into_fill") < capacity - slack)).select(F.col("into").alias("bin"), F.col("into_fill").alias("fill"), "node")
        left = items.count()
        if nodes == 1:
            break
    out = pieces.join(place.withColumnRenamed("at", "by"), F.col("bin") == F.col("first"), "left")
    return out.select("doc_id", "piece", "start", "length", "digest", "ids", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
