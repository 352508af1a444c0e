"""Masked pseudo-likelihood: every word predicted from the words on both sides.

A word is an id: one of the corpus' most frequent words, or else a shape (length and
kind of characters). The network adds up a vector for each of the neighbours, one
table per relative position, and a tanh layer predicts the word in the middle in two
steps: its class (words of like frequency), then the word within the class. A word
beyond the vocabulary takes a third step, P(word | shape): its discounted count in
the corpus, and what the discounts leave shared out by its spelling, a model of byte
triples. This table has a row per distinct word and grows with the input: its most
frequent words are broadcast, documents meet the others by a join. As a neighbour such a word is one of BESIDE rows, by its hash.
Word counts run over all documents. Training is data-parallel: in each round every
task walks its documents from the common weights, and weights averaged by a tree of
small sums start the next round. Over the rounds every word is predicted once. A document's score is the sum of its words' log
probabilities.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import encoded, stage, texts

VOCABULARY, SHAPES, CLASS, BESIDE = 1984, 64, 32, 1 << 14
SIDE, HIDDEN, ROUNDS, BATCH, HELD, RATE, SEED = 3, 24, 2, 2048, 32_768, 0.1, 11
FAN_IN, CHUNKS, CACHED_WORDS, CACHED_LENGTH = 16, 64, 400_000, 64
#: Words beyond the vocabulary, the most frequent, whose probabilities every task holds; the others meet theirs by a join.
WORDS_HELD = 300_000
_COUNTED = 400_000
# Each byte as upper-case letter, other letter (all beyond ASCII), digit, mark, or none of these.
_KINDS = np.array([8 if 65 <= c <= 90 else 4 if 97 <= c <= 122 or c >= 128 else 2 if 48 <= c <= 57 else 1 if 33 <= c <= 126 else 0 for c in range(256)], np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; each task adds up its own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush():
            for at in range(0, len(keys := list(held)), 20_000):
                some = keys[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([held[w] for w in some], pa.int64())], ["word", "n"])
            held.clear()

        for b in batches:
            for t in encoded(b):
                held.update(t.split())
                if len(held) > _COUNTED:
                    yield from flush()
        yield from flush()

    parts = docs.mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def shapes(words: list[bytes]) -> np.ndarray:
    """0 to 63 for each word: length in four steps, and which kinds of characters it has."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    kinds = _KINDS[np.frombuffer(b"".join(words), np.uint8)]
    return np.searchsorted([4, 8, 14], sizes, side="right") * 16 + np.bitwise_or.reduceat(kinds, np.cumsum(sizes) - sizes)


class Ids:
    """Codes of words: the id below, the row as a neighbour above 16 bits."""

    def __init__(self, vocabulary: list[bytes]):
        self.fixed = {w: (i + SHAPES) * 0x10001 for i, w in enumerate(vocabulary)}
        self.known = dict(self.fixed)

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHED_WORDS:
            self.known = dict(self.fixed)
        known, new = self.known, list(set(words).difference(self.known))
        if new:
            first = VOCABULARY + SHAPES + 1
            known.update((w, s | (first + zlib.crc32(w) % BESIDE) << 16) for w, s in zip(new, shapes(new).tolist()))
        out = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        for w in new:
            if len(w) > CACHED_LENGTH:
                del known[w]
        return out

    def of(self, text: bytes) -> np.ndarray:
        return self.codes(text.split()) & 0xFFFF


def initial(seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights before training. Neighbour ``size`` is the place beyond a text's ends,
    those after it are the words beyond the vocabulary."""
    r, size, classes = np.random.default_rng(seed), VOCABULARY + SHAPES, (VOCABULARY + SHAPES) // CLASS
    f = np.float32
    return {
        "near": r.normal(0, 0.1, (2 * SIDE, size + 1 + BESIDE, HIDDEN)).astype(f), "bias": np.zeros(HIDDEN, f),
        "to_class": r.normal(0, 0.1, (HIDDEN, classes)).astype(f), "class_bias": np.zeros(classes, f),
        "to_word": r.normal(0, 0.1, (classes, HIDDEN, CLASS)).astype(f), "word_bias": np.zeros((classes, CLASS), f),
    }


def windows(docs: list[np.ndarray], turn: int = 0, rounds: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, middle) of each word of the texts (ids or codes) whose place in its
    text is ``turn`` modulo ``rounds``: each word is in one of the turns."""
    size = VOCABULARY + SHAPES
    gap = np.full(SIDE, size, np.int32)
    flat = np.concatenate([gap, *(x for d in docs for x in (d, gap))])
    lengths = np.array([len(d) for d in docs])
    at = SIDE + np.arange(lengths.sum()) + np.repeat(np.arange(len(docs)) * SIDE, lengths)
    if rounds > 1:
        place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = at[place % rounds == turn]
    beside = np.where(flat >> 16, flat >> 16, flat)
    return np.stack([beside[at + k] for k in range(-SIDE, SIDE + 1) if k], axis=1), flat[at] & 0xFFFF


def _exps(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: exp(z) up to a factor (in the place of z), its sum, and the log-probability of place ``at``."""
    z -= z.max(axis=1, keepdims=True)
    chosen = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    return z, total, chosen - np.log(total)


def _hidden(w, near):
    h = w["near"][0].take(near[:, 0], axis=0)
    for k in range(1, 2 * SIDE):
        h += w["near"][k].take(near[:, k], axis=0)
    h += w["bias"]
    return np.tanh(h, out=h)


def _by_class(w, h, middle):
    """Words in the order of their classes: (order, where each class that occurs begins
    and ends, hidden rows, word scores inside the class), computed class by class."""
    group = (middle // CLASS).astype(np.uint16)
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[order], np.arange(len(w["word_bias"]) + 1)).tolist()
    parts = [(g, slice(edges[g], edges[g + 1])) for g in range(len(edges) - 1) if edges[g] < edges[g + 1]]
    h = h.take(order, axis=0)
    z = w["word_bias"].take(group[order], axis=0)
    for g, at in parts:
        z[at] += h[at] @ w["to_word"][g]
    return order, parts, h, z


def log_probabilities(w: dict[str, np.ndarray], near: np.ndarray, middle: np.ndarray) -> np.ndarray:
    h = _hidden(w, near)
    out = _exps(h @ w["to_class"] + w["class_bias"], middle // CLASS)[2].astype(np.float64)
    order, _, _, z = _by_class(w, h, middle)
    out[order] += _exps(z, (middle % CLASS)[order])[2]
    return out


def _scatter(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row sums of ``values`` (double precision) by id: differences of running sums."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")  # ids are below 2 ** 16
    ids = ids[order]
    last = np.flatnonzero(np.append(ids[1:] != ids[:-1], True))
    rows = values.take(order, axis=0)
    sums = np.cumsum(rows, axis=0, out=rows).take(last, axis=0)
    sums[1:] -= sums[:-1].copy()
    return ids[last], sums


def train_batch(w, seen, near, middle, rate: float = RATE) -> None:
    """One step of gradient ascent; step sizes fall with the squared gradients so far."""

    def step(name, g, at=...):
        if at is ...:
            seen[name] += g * g
            w[name] -= rate * g / np.sqrt(seen[name] + 1e-6)
        else:
            k, ids = at
            squares = seen[name][k].take(ids, axis=0) + g * g
            seen[name][k][ids] = squares
            w[name][k][ids] -= rate * g / np.sqrt(squares + 1e-6)

    h, n = _hidden(w, near), len(middle)
    every, group = np.arange(n), middle // CLASS
    e, total, _ = _exps(h @ w["to_class"] + w["class_bias"], group)
    e /= total[:, None]
    e[every, group] -= 1
    back = e @ w["to_class"].T
    updates = [("to_class", h.T @ e / n), ("class_bias", e.mean(axis=0))]
    order, parts, by_class, z = _by_class(w, h, middle)
    e, total, _ = _exps(z, inside := (middle % CLASS)[order])
    e /= total[:, None]
    e[every, inside] -= 1
    # classes that do not occur have no gradient, and a step of none changes nothing
    words, biases, below = np.zeros_like(w["to_word"]), np.zeros_like(w["word_bias"]), np.empty_like(by_class)
    for g, at in parts:
        np.matmul(e[at], w["to_word"][g].T, out=below[at])
        np.matmul(by_class[at].T, e[at], out=words[g])
    biases[[g for g, _ in parts]] = np.add.reduceat(e, [at.start for _, at in parts], axis=0)
    back[order] += below
    updates += [("to_word", words / n), ("word_bias", biases / n)]
    d = back * (1 - h * h) / n
    updates.append(("bias", d.sum(axis=0)))
    double = d.astype(np.float64)
    for k in range(2 * SIDE):
        ids, g = _scatter(near[:, k], double)
        updates.append(("near", g.astype(d.dtype), (k, ids)))
    for u in updates:
        step(*u)


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w.values()])


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, x in initial().items():
        out[name] = flat[at : at + x.size].reshape(x.shape).copy()
        at += x.size
    return out


def _train_task(shared, turn: int, rounds: int):
    """Chunks of this task's weights, times the number of its training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = shared.value
        ids, w = Ids(vocabulary), _shaped(flat)
        seen = {k: np.full_like(x, 1e-3) for k, x in w.items()}
        held, pending, n = [], 0, 0

        def learn():
            near, middle = windows(held, turn, rounds)
            for at in range(0, len(middle), BATCH):
                train_batch(w, seen, near[at : at + BATCH], middle[at : at + BATCH])
            return len(middle)

        for b in batches:
            for t in encoded(b):
                if len(x := ids.codes(t.split())):
                    held.append(x)
                    pending += len(x)
                if pending >= HELD:
                    n += learn()
                    held, pending = [], 0
        if held:
            n += learn()
        if n:
            part = TaskContext.get().partitionId()
            chunks = np.array_split(_flat(w).astype(np.float64) * n, CHUNKS)
            yield pa.RecordBatch.from_arrays([pa.array([part] * CHUNKS, pa.int64()), pa.array(range(CHUNKS), pa.int32()), pa.array([n] * CHUNKS, pa.int64()), pa.array([c.astype(np.float32).tobytes() for c in chunks], pa.binary())], ["part", "chunk", "n", "w"])

    return run


def _add_up(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("part")
    total = np.sum([np.frombuffer(x, np.float32).astype(np.float64) for x in g["w"]], axis=0).astype(np.float32)
    return pd.DataFrame({"part": [int(g["part"].iloc[0]) // FAN_IN], "chunk": [g["chunk"].iloc[0]], "n": [g["n"].sum()], "w": [total.tobytes()]})


def train(docs: DataFrame, vocabulary: list[bytes], rounds: int = ROUNDS) -> np.ndarray:
    """The averaged weights (11 MB, whatever the input)."""
    spark, flat = docs.sparkSession, _flat(initial())
    kind = "part long, chunk int, n long, w binary"
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, flat))
        sums, parts = docs.mapInArrow(_train_task(shared, turn, rounds), kind), 1
        while parts:  # a tree: no task adds up more than FAN_IN tasks' weights; what each task learnt is not staged
            node = sums.withColumn("node", F.floor(F.col("part") / FAN_IN))
            sums = stage(node.groupBy("node", "chunk").applyInPandas(lambda g: _add_up(g.drop(columns="node")), kind), f"lm-sums{turn}")
            parts = sums.agg(F.max("part")).first()[0]
        if parts is None:  # no words anywhere
            break
        rows = sums.orderBy("chunk").collect()
        flat = np.concatenate([np.frombuffer(r["w"], np.float32) / np.float32(r["n"]) for r in rows])
        shared.destroy()
    return flat


def _triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, code) of each byte of the words and of their ends, after the two bytes before."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    raw = np.frombuffer(b"\n\n" + b"".join(w + b"\n\n" for w in words), np.uint8).astype(np.int32)
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(word)) + word + 2
    return word, raw[at - 2] << 16 | raw[at - 1] << 8 | raw[at]


def _rare(vocabulary: list[bytes], fn, names: list[str]):
    """A ``mapInArrow`` function over the counted words beyond the vocabulary."""
    frequent = set(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(w, n) for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()) if w not in frequent]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in fn(*map(list, zip(*pairs)))], names)

    return run


def _count_triples(words, n):
    return np.unique(_triples(words)[1], return_counts=True)


def spelling(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-probability of the last byte of each seen triple, from the two before it:
    Witten-Bell smoothing by pairs, single bytes, all 256 alike."""
    pair = np.bincount(codes & 0xFFFF, weights=n, minlength=1 << 16)
    one = pair.reshape(256, 256).sum(axis=0)
    p1 = (one + 1) / (one.sum() + 256)
    pair = pair.reshape(256, 256)
    kinds = (pair > 0).sum(axis=1, keepdims=True)
    p2 = np.where(kinds > 0, (pair + kinds * p1) / np.maximum(pair.sum(axis=1, keepdims=True) + kinds, 1), p1)
    before = codes >> 8
    total = np.bincount(before, weights=n, minlength=1 << 16)[before]
    kinds = np.bincount(before, minlength=1 << 16)[before]
    return np.log((n + kinds * p2.ravel()[codes & 0xFFFF]) / (total + kinds))


def word_probabilities(counts: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(word, n, logp) of each word beyond the vocabulary: log P(word | shape), a
    distribution over the words of a shape. Absolute discounting; the discounts go to
    the shape's words by spelling."""
    grams = counts.mapInArrow(_rare(vocabulary, _count_triples, ["code", "n"]), "code int, n long")
    table = grams.groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()  # at most 256 ** 3 numbers
    codes, n = (table.column(c).to_numpy() for c in ("code", "n"))
    shared = counts.sparkSession.sparkContext.broadcast((codes, spelling(codes, n)))

    def spelt(words, n):
        codes, logs = shared.value
        word, code = _triples(words)
        return words, n, shapes(words).astype(np.int32), np.bincount(word, weights=logs[np.searchsorted(codes, code)], minlength=len(words))

    words = stage(counts.mapInArrow(_rare(vocabulary, spelt, ["word", "n", "shape", "q"]), "word binary, n long, shape int, q double"), "lm-spelt")
    once, twice = (F.count(F.when(F.col("n") == k, 1)) for k in (1, 2))
    d = F.least(F.greatest(F.coalesce(F.try_divide(once, once + 2 * twice), F.lit(0.5)), F.lit(0.1)), F.lit(0.95))
    of = F.broadcast(words.groupBy("shape").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.max("q").alias("top"), d.alias("d")))  # at most SHAPES rows
    share = F.exp(F.col("q") - F.col("top"))
    shares = F.broadcast(words.join(of, "shape").groupBy("shape").agg(F.sum(share).alias("shares")))
    p = (F.col("n") - F.col("d") + F.col("d") * F.col("kinds") * share / F.col("shares")) / F.col("total")
    return words.join(of, "shape").join(shares, "shape").select("word", "n", F.log(p).alias("logp"))


def _frequent(known: DataFrame) -> tuple[dict[bytes, float], int]:
    """The log-probabilities of the most frequent words, and from which n on: at most
    WORDS_HELD, all words of a count or none."""
    held, least = 0, 1 << 62
    for n, words in known.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        held += words
        if held > WORDS_HELD:
            break
        least = n
    table = known.where(F.col("n") >= least).toArrow()
    return dict(zip(table.column("word").to_pylist(), table.column("logp").to_pylist())), least


def _score(shared):
    """(row, doc_id, n_words, network, words, times): the part of the sum that the network
    and the held words give, and the text's other distinct words beyond the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat, logs = shared.value
        ids, w, none = Ids(vocabulary), _shaped(flat), math.nan
        for b in batches:
            lengths, sums, held, pending, rare, ends, spelt = [], [], [], 0, [], [0], []
            times: list[int] = []
            for i, t in enumerate(encoded(b)):
                words = t.split()
                held.append(ids.codes(words))
                beyond = [words[k] for k in np.flatnonzero((held[-1] & 0xFFFF) < SHAPES).tolist()]
                p = np.array([logs.get(x, none) for x in beyond])
                unknown = np.isnan(p)
                spelt.append(p[~unknown].sum())
                found = Counter(beyond[k] for k in np.flatnonzero(unknown).tolist())
                rare += found.keys()
                times += found.values()
                ends.append(len(rare))
                pending += len(held[-1])
                if pending >= HELD or i == b.num_rows - 1:
                    sums.append(_sums(w, held))
                    lengths += [len(x) for x in held]
                    held, pending = [], 0
            if lengths:
                at = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, kind)) for x, kind in ((rare, pa.binary()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(np.concatenate(sums) + np.array(spelt)), *lists], ["row", "doc_id", "n_words", "network", "words", "times"])

    return run


def _sums(w, docs: list[np.ndarray], block: int = 16_384) -> np.ndarray:
    """Each text's sum; long texts go through the network in blocks."""
    near, middle = windows(docs)
    of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    p = [log_probabilities(w, near[at : at + block], middle[at : at + block]) for at in range(0, len(middle), block)]
    return np.bincount(of, weights=np.concatenate(p) if p else None, minlength=len(docs)).astype(np.float64)


def score(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) per document.

    Null and empty texts have no words: 0 and no mean. Repeated rows and null ids keep
    their rows; without any words in the table the weights stay as they began. Words
    beside a text's ends see a mark there.
    """
    plain = texts(docs, id_col, text_col)
    counts = stage(word_counts(plain), "lm-word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()  # at most VOCABULARY rows
    vocabulary = [bytes(r["word"]) for r in top]
    known = word_probabilities(counts, vocabulary)
    often, least = _frequent(known)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, train(plain, vocabulary, rounds), often))
    rows = plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = stage(rows.mapInArrow(_score(shared), "row long, doc_id long, n_words long, network double, words array<binary>, times array<long>"), "lm-network")
    each = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "x.words", "x.times")
    rest = known.where(F.col("n") < least)
    spelt = each.join(rest, each["words"] == rest["word"]).groupBy("row").agg(F.sum(F.col("times") * F.col("logp")).alias("spelt"))
    out = rows.drop("words", "times").join(spelt, "row", "left").select("doc_id", "n_words", (F.col("network") + F.coalesce("spelt", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.try_divide("log_likelihood", "n_words"))
