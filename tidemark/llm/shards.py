"""Words as 64-bit keys in NumPy, and messages of packed arrays between shards of keys.

A text's words are found and hashed by whole arrays, and what a task has counted goes to
the shard that owns a range of keys as a few rows of packed numbers, so that no word or
pair of words is a row of its own in a shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task turns into words at once, if no single text has more.
CHUNK = 6_000_000
#: A message to shard ``at`` from shard ``of``, with packed arrays.
MESSAGE = "at int, kind int, of int, a binary, b binary, c binary, d binary"
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Keys of what stands before a text's first word and after its last one.
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_HASHED = 64  # bytes of a word that are hashed by arrays; longer words are hashed one by one


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers, in place and one to one."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair(v, w):
    """The key of two words in a row, from theirs."""
    return v * ODD + w


def pieces(batches: Iterator[pa.RecordBatch], name: str = "text") -> Iterator[pa.Table]:
    """The rows of ``batches`` in tables of about CHUNK bytes of text."""
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + CHUNK - size, "right")))
            held.append(b.slice(at, to - at))
            size += ends[to - 1] - start
            at = to
            if at < b.num_rows or size >= CHUNK:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Words:
    """The words of a column of texts, as in WORD: ``key``, ``start`` and ``size`` in
    ``raw``; ``count`` and ``symbols`` (characters and an end a word) of each text."""

    def __init__(self, column: pa.ChunkedArray):
        column = pa.chunked_array([c.cast(pa.large_binary()) for c in column.chunks], pa.large_binary())
        texts = pc.fill_null(column, b"").combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks or [pa.array([], pa.large_binary())])
        at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        n = int(at[-1] - at[0])
        self.raw = np.zeros(n + _HASHED + 8, np.uint8)
        if n:
            self.raw[:n] = np.frombuffer(texts.buffers()[2], np.uint8, n, int(at[0]))
        at = at - at[0]
        body = self.raw[:n]
        word = (body != 32) & ((body - np.uint8(9)) > 4)
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        edge = at[:-1][at[:-1] < n]  # a text begins a word and ends the one before
        begin[edge] = word[edge]
        edge = edge[edge > 0] - 1
        end[edge] = word[edge]
        self.start = np.flatnonzero(begin)
        self.size = np.flatnonzero(end) + 1 - self.start
        self.count = np.diff(np.searchsorted(self.start, at))
        self.at, self.word = at, word

    @cached_property
    def symbols(self) -> np.ndarray:
        body = self.raw[: len(self.word)]
        chars = np.flatnonzero(self.word & ((body & 0xC0) != 0x80))
        return np.diff(np.searchsorted(chars, self.at)) + self.count

    def _eight(self) -> np.ndarray:
        """The eight bytes from each place on."""
        return np.ndarray(len(self.word) + _HASHED, "<u8", self.raw, 0, (1,))

    def letters(self, own: np.ndarray) -> np.ndarray:
        """The first eight bytes of those words, as numbers in the words' order."""
        return (self._eight()[self.start[own]] & _MASK[np.minimum(self.size[own], 8)]).byteswap()

    @cached_property
    def key(self) -> np.ndarray:
        start, size, body, eight = self.start, self.size, self.raw[: len(self.word)], self._eight()
        key = eight[start] & _MASK[np.minimum(size, 8)]
        key ^= size.astype(np.uint64) * ODD
        mixed(key)
        left, done = np.flatnonzero(size > 8), 8
        while len(left) and done < _HASHED:
            more = eight[start[left] + done] & _MASK[np.minimum(size[left] - done, 8)]
            key[left] = mixed(more ^ key[left] * ODD)
            done += 8
            left = left[size[left] > done]
        for i in left:
            key[i] = int.from_bytes(hashlib.blake2b(body[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
        return key

    def before(self) -> np.ndarray:
        """The key of what stands before each word."""
        v = np.empty_like(self.key)
        v[1:] = self.key[:-1]
        v[(np.cumsum(self.count) - self.count)[self.count > 0]] = START
        return v

    def last(self) -> np.ndarray:
        """The key of the last word of each text that has one."""
        return self.key[np.cumsum(self.count)[self.count > 0] - 1]


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where equal numbers begin in ``ordered``."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])


def added(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from each place of ``at`` to the next."""
    return np.add.reduceat(values, at) if len(at) else values[:0]


def cut_out(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Those pieces of ``raw``, each with a line end."""
    ends = np.cumsum(size + 1)
    out = raw[np.repeat(start - ends + size + 1, size + 1) + np.arange(ends[-1] if len(ends) else 0)]
    out[ends - 1] = 10
    return out


def shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Of ``shards`` ranges of all keys the one that has each key."""
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def borders(ordered: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin in ordered ones, and where the last ones end."""
    least = np.array([-((-j << 32) // shards) << 32 for j in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(ordered, least), [len(ordered)]])


def table_of(keys: np.ndarray, values: np.ndarray) -> tuple:
    """Values by key, for ``look_up``; arrays alone, so that any worker can read it."""
    by = np.argsort(keys)
    bits = max(len(keys).bit_length() + 1, 4)
    first = np.searchsorted(keys[by], np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
    return np.append(keys[by], np.uint64((1 << 64) - 1)), np.append(values[by], 0.0), first, bits


def look_up(table: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``keys`` a table has, and their values or 0. Keys are found by their first
    bits, then one by one, as they are spread evenly."""
    have_keys, values, first, bits = table
    at = first[keys >> np.uint64(64 - bits)]
    have = have_keys[at]
    left = np.flatnonzero(have < keys)
    while len(left):  # at most as often as keys share their first bits
        at[left] += 1
        more = have_keys[at[left]]
        have[left] = more
        left = left[more < keys[left]]
    hit = (have == keys) & (at < len(have_keys) - 1)
    return hit, np.where(hit, values[at], 0.0)


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def packed(x: np.ndarray) -> bytes:
    """Bytes that compress well: of bytes their zstd form, of keys steps from one to the next,
    of numbers all first bytes, then all second ones, and so on, so that equal ones stand together."""
    if x.dtype == np.uint8:
        return len(x).to_bytes(8, "little") + pa.compress(x.tobytes(), "zstd", asbytes=True)
    if x.dtype == np.uint64:
        x = np.diff(x, prepend=np.uint64(0))
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpacked(x: pa.Buffer | bytes, kind) -> np.ndarray:
    """What ``packed`` had."""
    kind = np.dtype(kind)
    if not len(x):
        return np.empty(0, kind)
    if kind == np.uint8:
        size = int.from_bytes(memoryview(x)[:8], "little")
        return np.frombuffer(pa.decompress(memoryview(x)[8:], size, "zstd"), np.uint8) if size else np.empty(0, kind)
    out = np.frombuffer(x, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind)[:, 0]
    return np.cumsum(out, dtype=kind) if kind == np.uint64 else out


def sent(rows: list[tuple], ddl: str = MESSAGE) -> pa.Table:
    """``rows`` of whole numbers, arrays and nothing as a table of that schema."""
    schema = schema_of(ddl)
    cells = zip(*rows) if rows else [()] * len(schema)
    return pa.table([pa.array([packed(x) if isinstance(x, np.ndarray) else x for x in cell], f.type) for cell, f in zip(cells, schema)], schema)


def received(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    """The rows of a table, packed arrays as buffers."""
    columns = {f.name: (table.column(f.name), pa.types.is_binary(f.type)) for f in table.schema}
    for i in range(table.num_rows):
        yield {name: (c[i].as_buffer() if c[i].is_valid else b"") if binary else c[i].as_py() for name, (c, binary) in columns.items()}


def by_rows(fn: Callable[[dict], Iterator[list[tuple]]], ddl: str = MESSAGE):
    """A ``mapInArrow`` function: ``fn`` gives lists of rows for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in received(b):
                for rows in fn(x):
                    yield from sent(rows, ddl).to_batches()

    return run


def by_pieces(fn: Callable[[pa.Table], list[tuple]], ddl: str = MESSAGE):
    """A ``mapInArrow`` function: ``fn`` gives rows for each piece of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces(batches):
            yield from sent(fn(t), ddl).to_batches()

    return run


def by_shards(fn: Callable[[list[dict]], list[tuple]], ddl: str = MESSAGE):
    """An ``applyInArrow`` function: ``fn`` gets all rows sent to a shard, in order."""

    def run(table: pa.Table) -> pa.Table:
        return sent(fn(sorted(received(table), key=lambda x: (x["kind"], x["of"]))), ddl)

    return run
