"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is one of word pairs, trained on trusted (labelled) text: a word depends on
the word before it. Below the pairs are single words, and below these, also for words
never seen, the word's characters: n-grams inside the word, its edges included.
Counts, continuation counts, discounts, context totals and the interpolation from
short to long n-grams are over all trusted text, in tables that are sharded by their keys.
Words and pairs are 64-bit hashes there, packed in arrays: tasks count them chunk by chunk,
shards of keys add the counts up, and what pairs and words have to know of each other goes
between shards in messages (``shards``). Each different word of the documents is spelt once,
by its n-grams. What words and met pairs add to a text's log-probability is looked up by the
text's task if it is met often, else asked from the shard; nothing of it goes through one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.llm.common import WORD, bounded, column, shuffles_cleaned, small_batches, stage, unstage
from tidemark.llm.shards import END, MESSAGE, ODD, START, Words, added, borders, by_pieces, by_rows, by_shards, cut_out, look_up, mixed, pair, pieces, received, runs, sent, shard, table_of, unpacked

ORDER = 5
#: Bounds of a sample of the trusted rows, if one is asked for.
TRAIN_ROWS, TRAIN_CHARS = 6000, 12_000_000
#: Trusted ids, n-grams and words or pairs that are broadcast at most, and the bits that
#: tell which of the others there can be.
TRUSTED_IDS, GRAMS_HELD, FACTS_HELD, KEY_BITS = 2_000_000, 1_000_000, 1_000_000, 27
#: Pairs, and what texts ask of them, go through shuffles in so many parts, one after the other.
SLICES = 4
#: Bytes of trusted text a shard, four times as many of all text; a pair that is one in HOT of
#: all pairs, or more, is broadcast however seldom trusted texts have it.
SHARD_BYTES, HOT = 6_000_000, 2048
#: A language with SHARED held-out rows stands half on its own rows, half on all.
QUANTILE, SLACK, SHARED, ACCURACY = 0.995, 1.05, 100, 10_000
CACHED_WORDS, CACHED_LENGTH = 400_000, 64
EDGE = "\n"  # stands in no word


def sample(docs: DataFrame, trusted: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """The texts of at most ``rows`` trusted ids with together at most ``chars``
    characters, in the order of a hash of the id."""
    chosen = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most ``rows`` numbers
    met = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    met = stage(met, "trusted-sample")
    return bounded(met, chars).select("text")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, broadcast if it is proven to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def trusted_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The texts of all trusted ids, one an id."""
    # ids alone, 16 bytes each; more of them meet the documents by a shuffle
    met = docs.join(_few(trusted, TRUSTED_IDS), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return stage(met, "trusted-texts").select("text")


def _discounts(counts: DataFrame) -> DataFrame:
    """(k, d1, d2, d3): the discounts of each order of ``counts`` (k, c and more)."""
    of = [F.count(F.when(F.col("c") == j, 1)).cast("double").alias(f"n{j}") for j in (1, 2, 3, 4)]
    n = counts.groupBy("k").agg(*of)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    # a discount is between 0 and its count; counts of counts of tiny samples may be 0
    d = [F.least(F.greatest(F.coalesce(j - (j + 1) * y * F.try_divide(F.col(f"n{j + 1}"), F.col(f"n{j}")), F.lit(0.5 * j)), F.lit(0.1)), F.lit(j - 0.05)).alias(f"d{j}") for j in (1, 2, 3)]
    return n.select("k", *d)  # a row per order


def _cut(counts: DataFrame, discounts: DataFrame) -> DataFrame:
    """``counts`` with the discount ``d`` of each count; a count of 0 has none."""
    return counts.join(F.broadcast(discounts), "k").withColumn("d", F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))


def _discounted(counts: DataFrame) -> DataFrame:
    """``counts`` (k, c and more) with the discount ``d`` of each count of its order."""
    return _cut(counts, _discounts(counts))


def _windows(word: Column, order: int) -> Column:
    """For each character of a word and its end, these and up to order - 1 characters
    before, edges included; read from the back, as the word is walked once that way."""
    edged = F.concat(F.lit(EDGE), F.reverse(word), F.lit(EDGE))
    return F.slice(F.regexp_extract_all(edged, F.lit(f"(?s)(?=(.{{1,{order}}}))."), F.lit(1)), F.lit(1), F.length(word) + 1)


def _interpolated(windows: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """(k, gram, p) of every n-gram of ``windows`` (w, n; each w once), and (context, b); n
    counts a window in the training text. Windows with n = 0 count for nothing; their n-grams
    only get the probability that the others leave them."""
    ends = windows.select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("k"))
    grams = ends.groupBy("k", F.expr("right(w, k)").alias("gram")).agg(F.sum("n").alias("raw"))
    grams = stage(grams, "kn-grams")
    # shorter n-grams count how many different characters they follow; at a word's start none can
    left = grams.where("k > 1 and raw > 0").groupBy((F.col("k") - 1).alias("k"), F.expr("substr(gram, 2)").alias("gram")).agg(F.count("*").alias("follows"))
    at_start = (F.col("k") > 1) & F.col("gram").startswith(EDGE)
    c = F.when((F.col("k") == order) | at_start, F.col("raw")).otherwise(F.coalesce("follows", F.lit(0)))
    counts = grams.join(left, ["k", "gram"], "left").select("k", "gram", c.alias("c"), F.expr("substr(gram, 1, k - 1)").alias("context"))
    counts = stage(counts, "kn-counts")
    cut = _discounted(counts)
    contexts = cut.groupBy("k", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("held"))
    own = F.coalesce(F.try_divide(F.col("c") - F.col("d"), F.col("total")), F.lit(0.0))
    b = F.coalesce(F.try_divide("held", "total"), F.lit(1.0))  # no weight is lost after a context never met
    cut = stage(cut.join(contexts, ["k", "context"]).select("k", "gram", "context", "c", own.alias("own"), b.alias("b")), "kn-discounted")
    alphabet = F.lit(1.0) / (cut.where("k = 1 and c > 0").count() + 1)  # one more for what was never seen
    level = cut.where("k = 1").select("k", "gram", (F.col("own") + F.col("b") * alphabet).alias("p"))
    out = level
    for k in range(2, order + 1):
        lower = level.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        level = cut.where(F.col("k") == k).join(lower, F.expr("substr(gram, 2)") == F.col("suffix")).select("k", "gram", (F.col("own") + F.col("b") * F.col("lower")).alias("p"))
        level = stage(level, f"kn-level{k}")
        out = out.union(level)
    unstage(grams, counts)
    return out, cut.select("context", "b").distinct()


def model_tables(train: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(gram, logp) of every seen n-gram and (context, logb) of every seen context."""
    words = train.select(F.explode(_split(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    windows = words.select("n", F.explode(_windows(F.col("word"), order)).alias("w")).groupBy("w").agg(F.sum("n").alias("n"))
    out, backoff = _interpolated(windows.select(F.reverse("w").alias("w"), "n"), order)
    return out.select("gram", F.log("p").alias("logp")), backoff.select("context", F.log("b").alias("logb"))


def _split(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _pair_shares(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, v, w, c, own), the counts and discounted shares of words (k = 1) and of pairs (k = 2, v empty
    at a text's start), and (k, v, b), the back-off weights of what they stand after."""
    words = train.select(_split(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    zipped = F.zip_with(F.concat(F.array(F.lit("")), "ws"), "ws", lambda v, w: F.struct(v.alias("v"), w.alias("w")))
    pairs = words.select(F.explode(zipped).alias("p")).select("p.*").where(F.col("w").isNotNull()).groupBy("v", "w").agg(F.count("*").alias("c"))
    pairs = stage(pairs, "kn-pairs")
    single = pairs.groupBy("w").agg(F.count("*").alias("c")).select(F.lit(1).alias("k"), F.lit("").alias("v"), "w", "c")  # how many words each follows
    # not staged: a row per pair is written once, as a count, and once as a fact
    cut = _discounted(single.union(pairs.select(F.lit(2), "v", "w", "c")))
    contexts = cut.groupBy("k", "v").agg(F.sum("c").alias("total"), F.sum("d").alias("held"))
    own = cut.join(contexts, ["k", "v"]).select("k", "v", "w", "c", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"))
    return own, contexts.select("k", "v", (F.col("held") / F.col("total")).alias("b"))


def pair_tables(train: DataFrame) -> tuple[list[bytes], dict[str, np.ndarray]]:
    """The words of the sample and, by their numbers: ``own`` and ``own_pair``, the
    discounted shares of words and of pairs (first * (size + 1) + second, sorted);
    ``back``, each first word's back-off weight, of a text's start at ``size``, and of
    single words in front of the characters at ``size + 1``."""
    own, contexts = _pair_shares(train)
    # at most a row per word of the bounded sample
    single, pair = (own.where(F.col("k") == k).select("v", "w", "own").toArrow() for k in (1, 2))
    back = contexts.toArrow()
    order = pc.sort_indices(single.column("w"))
    names = single.column("w").take(order).combine_chunks()
    size = len(names)
    # a text's start is the only empty first word
    number = lambda c: pc.fill_null(pc.index_in(c, names), size).to_numpy().astype(np.int64)
    code = number(pair.column("v")) * (size + 1) + number(pair.column("w"))
    by = np.argsort(code)
    b = np.ones(size + 2)
    b[np.where(back.column("k").to_numpy() == 1, size + 1, number(back.column("v")))] = back.column("b").to_numpy()
    return names.cast(pa.binary()).to_pylist(), {"own": single.column("own").take(order).to_numpy(), "pair": code[by], "own_pair": pair.column("own").to_numpy()[by], "back": b}


class Model:
    """Probabilities of words from the tables, those of word pairs if given."""

    def __init__(self, logp: dict[str, float], logb: dict[str, float], order: int, words: list[bytes] = (), pairs: dict[str, np.ndarray] | None = None):
        self.logp, self.logb, self.order = logp, logb, order
        # what an unseen character has: the weight held back from all seen ones
        self.unseen = logb.get("", 0.0) - math.log(sum(len(g) == 1 for g in logp) + 1)
        self.numbers = {w: i for i, w in enumerate(words)}
        empty = np.empty(0)
        self.pairs = pairs or {"own": empty, "pair": empty.astype(np.int64), "own_pair": empty, "back": np.ones(2)}
        self.size = len(words)
        self.forget()

    def forget(self) -> None:
        """Met words: columns of the table of log-probability, symbols, number (whole
        numbers below 2 ** 53, so doubles hold them)."""
        self.known: dict[bytes, int] = {}
        self.facts, self.met = np.empty((3, 1 << 16)), 0

    def spelt(self, raw: bytes) -> tuple[float, int]:
        """(log-probability, symbols) of a word and its end by its characters.

        What follows a character is looked up after the longest context that was
        itself met: an n-gram of the model has its prefix in the model, so longer
        contexts have neither a continuation nor a weight held back."""
        w, total, h = EDGE + raw.decode() + EDGE, 0.0, 0
        logp, logb, order = self.logp.get, self.logb.get, self.order
        for i in range(1, len(w)):
            if i - h >= order:
                h = i - order + 1
            while (p := logp(w[h : i + 1])) is None and h < i:
                total += logb(w[h:i], 0.0)
                h += 1
            if p is None:
                total += self.unseen
                h = i + 1
            else:
                total += p
        return total, len(w) - 1

    def word(self, raw: bytes) -> tuple[float, int, int]:
        """(log-probability without the word before it, symbols, number or -1)."""
        total, symbols = self.spelt(raw)
        total += math.log(self.pairs["back"][self.size + 1])
        number = self.numbers.get(raw, -1)
        if number >= 0:
            total = float(np.logaddexp(total, math.log(self.pairs["own"][number])))
        return total, symbols, number

    def places(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if new := set(words).difference(known):
            found = np.array([self.word(w) for w in new])
            at, end = self.met, self.met + len(new)
            if end > self.facts.shape[1]:
                self.facts = np.concatenate([self.facts, np.empty((3, end))], axis=1)  # at least doubled
            self.facts[:, at:end] = found.T
            known.update(zip(new, range(at, end)))
            self.met = end
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def texts(self, texts: list[str | None]) -> list[tuple[int, float | None]]:
        """(symbols, perplexity) of each text; no words, no perplexity."""
        # words as in WORD: of the blanks, only these six split
        out = []
        for t in texts:
            words = (t or "").encode().split()
            if not words:
                out.append((0, None))
                continue
            if self.met > CACHED_WORDS:
                self.forget()
            at = self.places(words)
            p, n, number = self.facts[:, at]
            symbols = int(n.sum())
            total = float(self.after(p, number.astype(np.int64)).sum())
            out.append((symbols, math.exp(min(-total / symbols, 700.0))))
            if max(map(len, words)) > CACHED_LENGTH:
                for w in words:
                    if len(w) > CACHED_LENGTH:
                        self.known.pop(w, None)
        return out

    def after(self, p: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Log-probability of each word of a text after the word before it."""
        before = np.concatenate([[self.size], number[:-1]])
        # no weight is lost after a word that never was a first word
        backed = p + np.log(np.where(before >= 0, self.pairs["back"][before], 1.0))
        pair = self.pairs["pair"]
        if not len(pair):
            return backed
        code = before * (self.size + 1) + number
        at = np.minimum(np.searchsorted(pair, code), len(pair) - 1)
        hit = (pair[at] == code) & (before >= 0) & (number >= 0)
        backed[hit] = np.logaddexp(backed[hit], np.log(self.pairs["own_pair"][at[hit]]))
        return backed


_RESULT = StructType([StructField("symbols", LongType()), StructField("perplexity", DoubleType())])


#: The model of the last tables of this worker, with the words it met: the worker's next
#: tasks go on with it.
_LAST: list = [None, 0, None]


def _model(tables: tuple, order: int) -> Model:
    if _LAST[0] is not tables or _LAST[1] != order:
        logp, logb, words, pairs = tables
        _LAST[:] = [tables, order, Model(logp, logb, order, words, pairs)]
    return _LAST[2]


def _perplexity(tables, order: int):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(tables.value, order)
        for part in parts:
            yield pd.DataFrame(model.texts(list(part)), columns=["symbols", "perplexity"]).astype({"symbols": "int64", "perplexity": "float64"})

    return F.pandas_udf(run, _RESULT).asNondeterministic()


#: Staged pairs of a shard by their first word, with counts of counts, and a shard's words.
_PAIRS = MESSAGE + ", n1 long, n2 long, n3 long, n4 long"
_WORDS = ("at int, keys binary, met binary, spelt binary, follows binary, total binary, held binary, asker binary, firsts binary, seconds binary, "
          "first_at binary, second_at binary, n1 long, n2 long, n3 long, n4 long, words long, sum long")
_U8, _U4, _F8, _I8 = "<u8", "<u4", "<f8", "<i8"


def _three(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many counts are 1 to 4; as ``_discounts``."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else None
    d = [0.5 * j if y is None or not n[j - 1] else j - (j + 1) * y * n[j] / n[j - 1] for j in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.1), j - 0.05) for j, x in enumerate(d, 1))])


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == j).sum()) for j in (1, 2, 3, 4)]


def _cells(x: dict, **kinds: str) -> list[np.ndarray]:
    return [unpacked(x[name], kind) for name, kind in kinds.items()]


def _joined(rows: list[dict], name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(unpacked(x[name], kind) for x in rows)])


def _word_counts(shards: int, trusted: bool, hot: int):
    """Of texts, the words of a chunk (kind 0, of trusted texts 1) with their counts and
    letters, and the pairs that make up one in ``hot`` of its pairs (kind 2)."""

    def run(texts: pa.Table) -> list[tuple]:
        words = Words(texts.column("text"))
        by = np.argsort(words.key)
        ordered = words.key[by]
        first = runs(ordered)
        keys, counts, own = ordered[first], np.diff(first, append=len(ordered)).astype(_U4), by[first]
        cut, out = borders(keys, shards), []
        for j, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a:
                # in order of their first letters they pack best; their keys need not go along
                by = np.argsort(words.letters(own[a:b]))
                some = own[a:b][by]
                out.append((j, int(trusted), 0, None, counts[a:b][by], None, cut_out(words.raw, words.start[some], words.size[some])))
        if not trusted:
            pairs = np.sort(np.concatenate([pair(words.before(), words.key), pair(words.last(), END)]))
            first = runs(pairs)
            counts = np.diff(first, append=len(pairs))
            often = counts * hot >= max(len(pairs), 64 * hot)
            keys, counts = pairs[first][often], counts[often].astype(_I8)
            cut = borders(keys, shards)
            out += [(j, 2, 0, keys[a:b], counts[a:b], None, None) for j, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        return out

    return by_pieces(run)


def _vocabulary(least: int):
    """Each word of a shard once (kind 0): key, count in trusted texts, count in all, letters; and
    the pairs that all texts have ``least`` times (kind 2)."""

    def run(rows: list[dict]) -> list[tuple]:
        if not rows:
            return []
        said, pairs = [x for x in rows if x["kind"] < 2], [x for x in rows if x["kind"] == 2]
        words, counts = Words(pa.chunked_array([pa.array([_joined(said, "d", np.uint8).tobytes()], pa.large_binary())])), _joined(said, "b", _U4).astype(_I8)
        trusted = np.concatenate([np.empty(0, bool), *(np.full(len(x["b"]) // 4, x["kind"] == 1) for x in said)])
        by = np.argsort(words.key)
        first = runs(words.key[by])
        own = by[first]
        raw = cut_out(words.raw, words.start[own], words.size[own])
        out = [(rows[0]["at"], 0, 0, words.key[own], added(np.where(trusted, counts, 0)[by], first), added(counts[by], first), raw)]
        keys, counts = _joined(pairs, "a", _U8), _joined(pairs, "b", _I8)
        by = np.argsort(keys)
        first = runs(keys[by])
        hot = keys[by[first]][added(counts[by], first) >= least]
        return [*out, (rows[0]["at"], 2, 0, hot, None, None, None)]

    return by_shards(run)


def _grams(points: np.ndarray, end: np.ndarray, size: np.ndarray, order: int) -> np.ndarray:
    """Keys of the ``size`` characters that end at each place, at most ``order``."""
    key = mixed((points[end].astype(np.uint64) + np.uint64(1)) * ODD)
    for j in range(1, order):
        longer = size > j
        more = mixed((points[end[longer] - j].astype(np.uint64) + np.uint64(1)) ^ key[longer] * ODD)
        key[longer] = more
    return key


def _blocks(raw: np.ndarray) -> Iterator[tuple[int, str]]:
    """Words with line ends in parts of about a million bytes: the number of the first one, the part with a line end before it."""
    ends = np.flatnonzero(raw == 10) + 1
    at = done = 0
    while done < len(ends):
        to = max(done + 1, int(np.searchsorted(ends, at + 1_000_000, "right")))
        yield done, EDGE + raw[at : ends[to - 1]].tobytes().decode(errors="replace")
        at, done = ends[to - 1], to


def _ends(text: str, order: int) -> tuple[np.ndarray, ...]:
    """Of each character of words and their ends: code points, its place, how many characters
    of its word stand up to there, the edge and at most ``order``, and the number of the word."""
    points = np.frombuffer(text.encode("utf-32-le"), _U4)
    edge = points == ord(EDGE)
    place = np.arange(1, len(points))
    start = np.maximum.accumulate(np.where(edge, np.arange(len(points)), 0))[:-1]
    return points, place, np.minimum(place - start + 1, order), np.cumsum(edge)[:-1] - 1


def _windows_of(order: int):
    """(w, n, words) of each window of a block's words: how often trusted texts have it and in how many words it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (x for b in batches for x in received(b) if x["kind"] == 0):
            counts, raw = _cells(x, b=_I8, d=np.uint8)
            for at, text in _blocks(raw):
                points, place, size, word = _ends(text, order)
                keys = _grams(points, place, size, order)
                by = np.argsort(keys)
                first = runs(keys[by])
                own = by[first]
                n = added(counts[at + word[by]], first)
                names = [text[e - s + 1 : e + 1] for e, s in zip(place[own].tolist(), size[own].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n), pa.array(np.diff(first, append=len(by)))], ["w", "n", "words"])

    return run


def _spelt_by(held, order: int):
    """Messages (kind 2): the words of a shard, the log-probability of the grams that are held, how often they are met."""

    def run(x: dict) -> Iterator[list[tuple]]:
        if x["kind"]:
            return
        keys, met, raw = _cells(x, a=_U8, c=_I8, d=np.uint8)
        spelt = np.zeros(len(keys))
        for at, text in _blocks(raw):
            points, place, size, word = _ends(text, order)
            logp = look_up(held.value, _grams(points, place, size, order))[1]
            spelt[at : at + word[-1] + 1] = np.bincount(word, logp)
        yield [(x["at"], 2, 0, keys, spelt, met, None)]

    return by_rows(run)


def _not_held(held, order: int):
    """(key, w, times): the windows of each word that are not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (x for b in batches for x in received(b) if x["kind"] == 0):
            keys, raw = _cells(x, a=_U8, d=np.uint8)
            for at, text in _blocks(raw):
                points, place, size, word = _ends(text, order)
                left = np.flatnonzero(~look_up(held.value, _grams(points, place, size, order))[0])
                names = [text[e - s + 1 : e + 1] for e, s in zip(place[left].tolist(), size[left].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys[at + word[left]].view(_I8)), pa.array(names, pa.string())], ["key", "w"])

    return run


def _parcels(shards: int, kind: int):
    """(key, a) as messages of ``kind`` to the shards of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, values = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            keys = keys.astype(_I8).view(_U8)
            by = np.argsort(keys)
            cut = borders(keys[by], shards)
            yield from sent([(j, kind, 0, keys[by[a:b]], values[by[a:b]].astype(_F8), None, None) for j, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]).to_batches()

    return run


def _spelt(vocabulary: DataFrame, order: int, shards: int) -> DataFrame:
    """Messages with what each word adds by its characters (kind 2, and 3 for what those of 2 leave out)."""
    windows = stage(vocabulary.mapInArrow(_windows_of(order), "w string, n long, words long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "kn-windows")
    every, _ = _interpolated(windows.select("w", "n"), order)
    whole = (F.col("k") == order) | ((F.col("k") > 1) & F.col("gram").startswith(EDGE))
    grams = every.where(whole).select(F.col("gram").alias("w"), F.log("p").alias("logp"))
    if few := grams.limit(GRAMS_HELD + 1).count() <= GRAMS_HELD:
        kept = grams
    else:  # those in most words
        least = _often(windows.groupBy(F.col("words").alias("n")).agg(F.count("*").alias("rows")), GRAMS_HELD)
        kept = grams.join(windows.where(F.col("words") >= least), "w").select("w", "logp")
    got = kept.toArrow()  # GRAMS_HELD rows at most
    names = "".join(got.column("w").to_pylist())
    size = pc.utf8_length(got.column("w")).to_numpy().astype(np.int64)
    points = np.frombuffer(names.encode("utf-32-le"), _U4)
    table = table_of(_grams(points, np.cumsum(size) - 1, size, order), got.column("logp").to_numpy())
    held = vocabulary.sparkSession.sparkContext.broadcast(table)
    out = vocabulary.mapInArrow(_spelt_by(held, order), MESSAGE)
    if not few:
        rest = vocabulary.mapInArrow(_not_held(held, order), "key long, w string").join(grams, "w").groupBy("key").agg(F.sum("logp").alias("a"))
        out = out.union(rest.mapInArrow(_parcels(shards, 3), MESSAGE))
    out = stage(out, "kn-spelt")
    unstage(windows, every)
    return out


def _pair_counts(shards: int, slices: int, i: int):
    """Of texts, the pairs of a chunk that belong to slice ``i`` of the shards, with their counts."""

    def run(texts: pa.Table) -> list[tuple]:
        words = Words(texts.column("text"))
        v = words.before()
        keys = pair(v, words.key)
        own = np.flatnonzero(shard(keys, shards) % slices == i)
        keys, v = keys[own], v[own]
        by = np.argsort(keys)
        keys = keys[by]
        first = runs(keys)
        counts, v, keys = np.diff(first, append=len(keys)).astype(_U4), v[by[first]], keys[first]
        cut = borders(keys, shards)
        return [(j, 0, 0, keys[a:b], v[a:b], counts[a:b], None) for j, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]

    return by_pieces(run)


def _pairs(rows: list[dict]) -> list[tuple]:
    """The pairs of a shard, each once: first words, how many pairs each has, second words and counts."""
    if not rows:
        return []
    keys, v = _joined(rows, "a", _U8), _joined(rows, "b", _U8)
    by = np.argsort(keys)
    first = runs(keys[by])
    own, counts = by[first], added(_joined(rows, "c", _U4).astype(_I8)[by], first)
    by = np.argsort(v[own], kind="stable")
    keys, v, counts = keys[own][by], v[own][by], counts[by]
    first = runs(v)
    return [(rows[0]["at"], 0, 0, v[first], np.diff(first, append=len(v)).astype(_U4), keys - v * ODD, counts.astype(_U4), *_of_counts(counts))]


def _stood(shards: int, cuts: np.ndarray):
    """From staged pairs, to the shards of their words: how often each word is a first one and
    what it holds back (kind 0), and how many words each word follows here (kind 1)."""

    def run(x: dict) -> Iterator[list[tuple]]:
        v, size, w, counts = _cells(x, a=_U8, b=_U4, c=_U8, d=_U4)
        at = np.cumsum(size, dtype=_I8) - size
        total, held = added(counts.astype(_I8), at), added(cuts[np.minimum(counts, 3)], at)
        w, follows = np.unique(w, return_counts=True)
        out = []
        for kind, keys, *values in ((0, v, total, held), (1, w, follows.astype(_I8), None)):
            cut = borders(keys, shards)
            out += [(j, kind, x["at"], keys[a:b], *(y if y is None else y[a:b] for y in values), None) for j, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        yield out

    return by_rows(run)


def _shares(rows: list[dict]) -> list[tuple]:
    """The words of a shard with all that was sent about them, and where the words stand that each shard of pairs asked for."""
    if not rows:
        return []
    of = {kind: [x for x in rows if x["kind"] == kind] for kind in range(4)}
    keys = np.unique(np.concatenate([_joined(of[kind], "a", _U8) for kind in range(3)]))
    met, spelt, follows, total, held = (np.zeros(len(keys), t) for t in (_I8, _F8, _I8, _I8, _F8))
    for x in of[2]:
        at = np.searchsorted(keys, unpacked(x["a"], _U8))
        spelt[at] += unpacked(x["b"], _F8)
        met[at] = unpacked(x["c"], _I8)
    for x in of[3]:
        spelt[np.searchsorted(keys, unpacked(x["a"], _U8))] += unpacked(x["b"], _F8)
    askers = sorted({x["of"] for x in of[0] + of[1]})
    places = {(kind, x["of"]): np.searchsorted(keys, unpacked(x["a"], _U8)).astype(_U4) for kind in (0, 1) for x in of[kind]}
    for x in of[0]:
        total[places[0, x["of"]]] += unpacked(x["b"], _I8)
        held[places[0, x["of"]]] += unpacked(x["c"], _F8)
    for x in of[1]:
        follows[places[1, x["of"]]] += unpacked(x["b"], _I8)
    none = np.empty(0, _U4)
    sides = [[places.get((kind, p), none) for p in askers] for kind in (0, 1)]
    sizes = [np.array([len(x) for x in side], _I8) for side in sides]
    return [(rows[0]["at"], keys, met, spelt, follows, total, held, np.array(askers, _I8), *sizes, *(np.concatenate([none, *side]) for side in sides), *_of_counts(follows), int((follows > 0).sum()), int(follows.sum()))]


def _answers(shards: int, slices: int, i: int, cuts: np.ndarray, total_of_all: int, held_of_all: float):
    """From staged words, to slice ``i`` of the shards: what pairs asked for (kind 1), and facts
    of words and of a text's last word, with how often they are met (kind 2)."""
    left = math.log(held_of_all / total_of_all) if total_of_all else 0.0

    def run(x: dict) -> Iterator[list[tuple]]:
        keys, met, spelt, follows, total, held = _cells(x, keys=_U8, met=_I8, spelt=_F8, follows=_I8, total=_I8, held=_F8)
        own = (follows - cuts[np.minimum(follows, 3)]) / max(total_of_all, 1)
        with np.errstate(divide="ignore"):
            alone = np.where(follows > 0, np.log(own + np.exp(spelt + left)), spelt + left)
            lost = np.log(held)
        asker, firsts, seconds, first_at, second_at = _cells(x, asker=_I8, firsts=_I8, seconds=_I8, first_at=_U4, second_at=_U4)
        f, s, out = np.cumsum(firsts), np.cumsum(seconds), []
        for k in np.flatnonzero(asker % slices == i):
            out.append((int(asker[k]), 1, x["at"], lost[first_at[f[k] - firsts[k] : f[k]]], alone[second_at[s[k] - seconds[k] : s[k]]], None, None))
        back = np.where(total > 0, lost - np.log(np.maximum(total, 1)), 0.0)
        if x["at"] % slices == i and len(keys):
            out.append((x["at"], 2, 0, keys, np.where(keys == START, 0.0, alone) + back, met, None))
        first = np.flatnonzero(total > 0)
        last = pair(keys[first], END)
        by = np.argsort(last)
        last, gone = last[by], -back[first][by]
        cut = borders(last, shards)
        out += [(j, 2, 0, last[a:b], gone[a:b], np.full(b - a, -1, _I8), None) for j, (a, b) in enumerate(zip(cut, cut[1:])) if b > a and j % slices == i]
        yield out

    return by_rows(run)


def _facts(rows: list[dict], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard, keys in order, what each adds to a text's log-probability and how often it is met.

    A word adds its log-probability without the word before it and, as the word before
    another one, its back-off weight; a text's last word takes that back. A pair that was
    met adds what it gains over that."""
    keys, a, n = ([_joined([x for x in rows if x["kind"] == 2], name, kind)] for name, kind in (("a", _U8), ("b", _F8), ("c", _I8)))
    for x in (x for x in rows if x["kind"] == 0):
        answers = [y for y in rows if y["kind"] == 1]
        v, size, w, c = _cells(x, a=_U8, b=_U4, c=_U8, d=_U4)
        _, place = np.unique(w, return_inverse=True)
        lost, alone = np.repeat(_joined(answers, "a", _F8), size), _joined(answers, "b", _F8)[place]
        keys.append(pair(np.repeat(v, size), w))
        # log(1 + exp(x)), x the log of what the pair has over what the single word gets after v
        a.append(np.logaddexp(0.0, np.log(c - cuts[np.minimum(c, 3)]) - lost - alone))
        n.append(c.astype(_I8))
    keys, a, n = (np.concatenate(y) for y in (keys, a, n))
    by = np.argsort(keys)
    return keys[by], a[by], n[by]


def _often_met(cuts: np.ndarray, least: int, hot: np.ndarray):
    """The facts of a shard that are met ``least`` times or hot."""

    def run(rows: list[dict]) -> list[tuple]:
        keys, a, n = _facts(rows, cuts)
        often = (n >= least) | np.isin(keys, hot)
        return [(rows[0]["at"], 0, 0, keys[often], a[often], None, None)] if often.any() else []

    return by_shards(run)


def _asked(shards: int, slices: int, i: int, often, can_be):
    """Of texts, what facts of slice ``i`` add that are held (kind 3), and the others that may be,
    with the places of the texts that ask for them (kind 4); of the shard that is the chunk's
    home, with a mark of the chunk. Chunks of the same mark have the same texts."""

    def run(texts: pa.Table) -> list[tuple]:
        words, t = Words(texts.column("text")), texts.column("t").to_numpy()
        some = np.flatnonzero(words.count)
        owner = np.repeat(np.arange(len(t), dtype=np.int32), words.count)
        keys, of, sums = [], [], np.zeros(len(t))
        for kind, (k, o) in enumerate(((words.key, owner), (pair(words.last(), END), some), (pair(words.before(), words.key), owner))):
            own = np.flatnonzero(shard(k, shards) % slices == i)
            k, o = k[own], o[own]
            hit, a = look_up(often.value, k)
            sums += np.bincount(o, a, len(t))
            if kind == 2:  # of pairs, most were never met
                at = k >> np.uint64(64 - KEY_BITS)
                hit |= (can_be.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1) == 0
            keys.append(k[~hit])
            of.append(o[~hit])
        keys, of = np.concatenate(keys), np.concatenate(of)
        by = np.argsort(keys)
        cut = borders(keys[by], shards)
        home = i + slices * (int(t[0]) % (shards // slices))
        mark = np.add.reduce(mixed(t.view(_U8) + np.arange(len(t), dtype=_U8) * ODD), keepdims=True)
        out = [(home, 3, home, t, sums, None, mark)] if len(some) else []
        return out + [(j, 4, home, keys[by[a:b]], of[by[a:b]].astype(_U4), None, mark) for j, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]

    return by_pieces(run)


def _summed(cuts: np.ndarray):
    """To the homes of chunks, their texts with what held facts add (kind 0), and what the facts
    of a shard add to the texts at some places (kind 1)."""

    def run(rows: list[dict]) -> list[tuple]:
        keys, a, _ = _facts([x for x in rows if x["kind"] < 3], cuts)
        at, out = rows[0]["at"], []
        for x in rows:
            if x["kind"] == 3:
                out.append((x["of"], 0, at, *_cells(x, a=_I8, b=_F8), None, *_cells(x, d=_U8)))
            elif x["kind"] == 4 and len(keys):
                asked, place, mark = _cells(x, a=_U8, b=_U4, d=_U8)
                found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                sums = np.bincount(place, np.where(keys[found] == asked, a[found], 0.0))
                some = np.flatnonzero(sums)
                out.append((x["of"], 1, at, some.astype(_U4), sums[some], None, mark))
        return out

    return by_shards(run)


def _of_texts(table: pa.Table) -> pa.Table:
    """(t, sum) of the texts of a home, each once."""
    chunks = {}
    for x in sorted(received(table), key=lambda x: (x["kind"], x["of"])):
        mark, sums = int(unpacked(x["d"], _U8)[0]), unpacked(x["b"], _F8)
        if x["kind"]:
            chunks[mark][1][unpacked(x["a"], _U4)] += sums
        elif mark in chunks:
            chunks[mark][1][:] += sums
        else:
            chunks[mark] = unpacked(x["a"], _I8), sums.copy()
    t, sums = (np.concatenate(y) for y in zip(*chunks.values()))
    t, place = np.unique(t, return_inverse=True)
    return pa.table([t, np.bincount(place, sums, len(t))], ["t", "sum"])


def _often(counts: DataFrame, most: int) -> int:
    """From which n on there are at most ``most`` of what ``counts`` (n, rows) counts."""
    held, least = 0, None
    for n, rows in counts.groupBy("n").agg(F.sum("rows").alias("rows")).orderBy(F.desc("n")).toLocalIterator():
        held += rows
        if held > most:
            break
        least = n
    return (1 << 62) if least is None else least


def _counts_of(name: str, kind: str):
    """(n, rows): how many of a shard have each count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (x for b in batches for x in received(b)):
            n, rows = np.unique(unpacked(x[name], kind), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(_I8)), pa.array(rows.astype(_I8))], ["n", "rows"])

    return run


def _can_be(pairs: DataFrame) -> np.ndarray:
    """A table of the first KEY_BITS bits of pairs: a pair without its bit was never met. It has
    one size for any input."""

    def run(x: dict) -> Iterator[list[tuple]]:
        v, size, w = _cells(x, a=_U8, b=_U4, c=_U8)
        at = np.unique(pair(np.repeat(v, size), w) >> np.uint64(64 - KEY_BITS)).astype(np.int64)
        if len(at):
            bits = np.zeros((at[-1] >> 3) - (at[0] >> 3) + 1 << 3, np.uint8)
            bits[at - (at[0] >> 3 << 3)] = 1
            yield [(int(at[0] >> 3), 0, 0, np.packbits(bits, bitorder="little"), None, None, None)]

    table = np.zeros((1 << KEY_BITS) // 8, np.uint8)
    for row in pairs.select(*(x.split()[0] for x in MESSAGE.split(", "))).mapInArrow(by_rows(run), MESSAGE).select("at", "a").collect():
        bits = unpacked(row.a, np.uint8)
        table[row.at : row.at + len(bits)] |= bits
    return table


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, t, n_bytes, symbols) of each row; a symbol is a character of a word or its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches):
            yield from texts.drop_columns("text").append_column("symbols", pa.array(Words(texts.column("text")).symbols.astype(_I8))).to_batches()

    return docs.select("doc_id", "lang", F.xxhash64("text").alias("t"), F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(run, "doc_id long, lang string, t long, n_bytes long, symbols long")


def _scored(plain: DataFrame, train: DataFrame, order: int) -> DataFrame:
    """(doc_id, lang, symbols, perplexity), ``train`` staged, from what the texts' words and pairs of
    words add. These facts are kept in shards by their keys; those met often, or hot in the texts, are
    broadcast, for others a text asks the shards in messages, in SLICES turns that each have some of the
    shards, and without most of the pairs that there are no facts for. What was staged on the way
    goes as soon as nothing reads it. Equal texts are added up as one and divided again."""
    slices, context = SLICES, plain.sparkSession.sparkContext
    send = lambda df, fn: df.mapInArrow(fn, MESSAGE)
    meet = lambda df, fn, ddl=MESSAGE: df.groupBy("at").applyInArrow(fn, ddl)
    rows = stage(_rows(plain), "kn-rows")
    size = rows.agg(F.sum("n_bytes")).first()[0] or 0
    trusted = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = slices * max(1, -(-max(trusted // SHARD_BYTES, size // (4 * SHARD_BYTES)) // slices))
    said = send(plain.select("text"), _word_counts(shards, False, HOT)).union(send(train, _word_counts(shards, True, HOT)))
    vocabulary = stage(meet(said, _vocabulary(max(64, size // (24 * HOT)))), "kn-vocabulary")
    # at most some 4 HOT keys
    hot = np.concatenate([[START], *(unpacked(x.a, _U8) for x in vocabulary.where("kind = 2").select("a").collect())])
    spelt = _spelt(vocabulary, order, shards)
    unstage(vocabulary)
    parts = [stage(meet(send(train, _pair_counts(shards, slices, i)), by_shards(_pairs, _PAIRS), _PAIRS), "kn-pairs") for i in range(slices)]
    unstage(train)
    pairs, columns = reduce(DataFrame.union, parts), [x.split()[0] for x in MESSAGE.split(", ")]
    numbers = lambda *names: [F.coalesce(F.sum(x), F.lit(0)) for x in names]
    cuts = _three(pairs.agg(*numbers("n1", "n2", "n3", "n4")).first())
    words = stage(meet(send(pairs.select(columns), _stood(shards, cuts)).union(spelt), by_shards(_shares, _WORDS), _WORDS), "kn-words")
    unstage(spelt)
    *n, met, total = words.agg(*numbers("n1", "n2", "n3", "n4", "words", "sum")).first()
    cuts_of_words = _three(n)
    held = float(np.dot([n[0], n[1], met - n[0] - n[1]], cuts_of_words[1:]))
    facts = [parts[i].select(columns).union(send(words, _answers(shards, slices, i, cuts_of_words, total, held))) for i in range(slices)]
    counts = [df.select(x).mapInArrow(_counts_of(x, kind), "n long, rows long") for df, x, kind in ((words, "met", _I8), (pairs, "d", _U4))]
    least = _often(counts[0].union(counts[1]), FACTS_HELD)
    # FACTS_HELD rows at most and the hot ones
    with shuffles_cleaned(plain.sparkSession):
        got = [x for df in facts for x in meet(df, _often_met(cuts, least, hot)).select("a", "b").collect()]
    often = table_of(*(np.concatenate([np.empty(0, kind), *(unpacked(x[name], kind) for x in got)]) for name, kind in (("a", _U8), ("b", _F8))))
    begin = float(look_up(often, np.array([START]))[1][0])
    shared = context.broadcast(often), context.broadcast(_can_be(pairs))
    asking, sums = plain.select("text", F.xxhash64("text").alias("t")), []
    for i in range(slices):  # what a turn sends takes its shuffle files away with it
        sent_to = facts[i].union(send(asking, _asked(shards, slices, i, *shared)))
        sums.append(stage(meet(meet(sent_to, _summed(cuts)), _of_texts, "t long, sum double"), "kn-parts"))
        unstage(parts[i])
    unstage(words)
    copies = rows.where("symbols > 0").groupBy("t").agg(F.count("*").alias("copies"))
    each = reduce(DataFrame.union, sums).groupBy("t").agg(F.sum("sum").alias("sum")).join(copies, "t").select("t", (F.col("sum") / F.col("copies") + begin).alias("total"))
    out = stage(rows.join(each, "t", "left").select("doc_id", "lang", "symbols", "total"), "kn-sums")
    unstage(rows, *sums)
    perplexity = F.when(F.col("symbols") > 0, F.exp(F.least(-F.col("total") / F.col("symbols"), F.lit(700.0))))
    return out.select("doc_id", "lang", "symbols", perplexity.alias("perplexity"))


def perplexities(docs: DataFrame, labels: DataFrame, trusted_on: Column, order: int = ORDER, rows: int | None = None, chars: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, symbols, perplexity), learnt from all labelled rows of quality 1 for
    which ``trusted_on``, a condition on doc_id, holds. Without any, all characters are
    equally likely. With ``rows`` or ``chars`` the model is fitted on a sample of at most
    these, small enough that every task holds its tables."""
    small_batches(docs)
    plain = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang"))
    good = labels.groupBy(column("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where((F.col("q") == 1) & F.col("doc_id").isNotNull() & trusted_on).select("doc_id")
    if rows is None and chars is None:
        return _scored(plain, trusted_texts(plain.select("doc_id", "text"), good), order)
    train = sample(plain, good, rows or TRAIN_ROWS, chars or TRAIN_CHARS)
    logp, logb = model_tables(train, order)
    # at most a few n-grams per character of the bounded sample
    as_dict = lambda df: dict(zip(*(c.to_pylist() for c in df.toArrow().columns)))
    tables = docs.sparkSession.sparkContext.broadcast((as_dict(logp), as_dict(logb), *pair_tables(train)))
    return plain.select("doc_id", "lang", _perplexity(tables, order)("text").alias("m")).select("doc_id", "lang", "m.symbols", "m.perplexity")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, order: int = ORDER, rows: int | None = None, chars: int | None = None, quantile: float = QUANTILE, slack: float = SLACK,
             id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang, symbols, perplexity, threshold, kept.

    Trusted rows whose crc32(doc_id as text) mod ``folds`` is 0 are not trained on:
    they give each language's threshold, ``slack`` times the ``quantile`` of their
    perplexities: that of a normal tail through the median and the upper quartile, as few
    rows have no tail of their own and a single outlier would be it. The threshold of a
    language (null is one) with n such rows has the weight n / (n + SHARED), the mean
    of all languages' rows the rest; with none at all there is no threshold and all pass.
    A null or empty text, or one without words, has no perplexity and is not kept.
    Repeated rows and null ids keep their rows; an empty table gives none.
    """
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0
    scored = stage(perplexities(docs, labels, ~held, order, rows, chars, id_col, text_col, lang_col), "perplexities")
    good = labels.groupBy(column("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where((F.col("q") == 1) & held).select("doc_id")
    seen = scored.where(F.col("perplexity").isNotNull()).join(good, "doc_id", "left_semi")
    median, upper = (F.percentile_approx("perplexity", q, ACCURACY) for q in (0.5, 0.75))
    tail = NormalDist().inv_cdf(quantile) / NormalDist().inv_cdf(0.75)
    cut = (median + tail * (upper - median)) * slack
    cuts = seen.groupBy("lang").agg(F.count("*").alias("n"), cut.alias("own"))
    overall = F.lit(cuts.agg(F.sum(F.col("n") * F.col("own")) / F.sum("n")).first()[0]).cast("double")
    share = F.col("n") / (F.col("n") + SHARED)
    per = cuts.select(F.col("lang").alias("t_lang"), (share * F.col("own") + (1 - share) * overall).alias("own"))
    out = scored.join(per, F.col("lang").eqNullSafe(F.col("t_lang")), "left").withColumn("threshold", F.coalesce("own", overall))
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select("doc_id", "lang", "symbols", "perplexity", "threshold", kept.alias("kept"))
