"""Toxicity by character n-grams: a linear classifier whose features are scaled by
naive Bayes log-count ratios, trained on labelled text.

A feature is an n-gram of code points inside a lower-cased word, its edges marked; its value in a text is its
number of occurrences per word. Each feature is multiplied by the log ratio of its
smoothed share in toxic and in other texts, and a logistic regression over the
scaled features gives the weights. So a text's score is the mean of its words'
scores, and a worker computes each frequent word's score once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.llm.common import arrow_rows, bounded, column, stage, texts

GRAMS, BITS = (2, 3, 4, 5), 20
BUCKETS = 1 << BITS
#: Bounds of the labelled rows that the classifier is fitted on.
TRAIN_ROWS, TRAIN_CHARS = 5000, 48_000_000
STEPS, RATE, RIDGE, SCALE, PRIOR = 50, 0.5, 1e-5, 10.0, 1e-3
#: Cached words per worker; a cache only.
CACHED_WORDS, CACHED_LENGTH = 400_000, 64
_STEP = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words, split at the six blanks of ASCII."""
    return (text or "").lower().encode().split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position of its word) of every n-gram occurrence of the words."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer((b"^" + b"$^".join(words) + b"$").decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w.decode()) for w in words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # characters from here to the word's end
    code, buckets, owners = data, [], []
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * _STEP + data[n - 1 :]  # a polynomial modulo 2 ** 64
        if n in GRAMS:
            at = np.flatnonzero(left[: len(code)] >= n)
            mixed = code[at] + np.uint64(n)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(word[at])
    return np.concatenate(buckets), np.concatenate(owners)


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and how often each occurs, per word."""
    words = Counter(words_of(text))
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    bucket, owner = grams(list(words))
    times = np.fromiter(words.values(), np.float64, len(words))
    ids, at = np.unique(bucket, return_inverse=True)
    return ids.astype(np.int32), (np.bincount(at, weights=times[owner]) / words.total()).astype(np.float32)


def fit(toxic: np.ndarray, ids: list[np.ndarray], shares: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias); without both classes the weights are 0."""
    yes, n = float(toxic.sum()), len(toxic)
    bias = float(np.log((yes + 0.5) / (n - yes + 1)))
    if not 0 < yes < n:
        return np.zeros(BUCKETS, np.float32), bias
    f, x, row = np.concatenate(ids), np.concatenate(shares).astype(np.float64), np.repeat(np.arange(n), [len(i) for i in ids])
    in_yes, in_all = np.bincount(f, weights=x * toxic[row], minlength=BUCKETS), np.bincount(f, weights=x, minlength=BUCKETS)
    ratio = np.log((in_yes + PRIOR) / yes) - np.log((in_all - in_yes + PRIOR) / (n - yes))
    ratio[np.bincount(f, minlength=BUCKETS) < 3] = 0
    x *= SCALE * ratio[f]
    balance = np.where(toxic == 1, n / (2 * yes), n / (2 * (n - yes)))
    w, seen, b, seen_b = np.zeros(BUCKETS), np.full(BUCKETS, 1e-12), 0.0, 1e-12
    for _ in range(STEPS):  # full batches, step sizes by the sum of squared gradients
        z = np.bincount(row, weights=x * w[f], minlength=n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * balance
        g = np.bincount(f, weights=x * error[row], minlength=BUCKETS) / n + RIDGE * w
        seen += g * g
        seen_b += error.mean() ** 2
        w -= RATE * g / np.sqrt(seen)
        b -= RATE * error.mean() / np.sqrt(seen_b)
    return (SCALE * ratio * w).astype(np.float32), float(b)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """(toxic, ids, shares) of at most ``rows`` labelled documents with together at most
    ``chars`` characters, in the order of a hash of the id. ``labels`` has doc_id and
    toxic; other values than 0 and 1 are left out, conflicting labels count as toxic."""
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` pairs of numbers; of documents that share an id one is taken
    met = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    met = stage(met, "toxic-sample")
    met = bounded(met, chars)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [text_features(t) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], ["toxic", "ids", "shares"])

    # split over tasks: a sample is one small file
    return stage(met.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").repartition(16, "doc_id").mapInArrow(arrow_rows(run), "toxic int, ids array<int>, shares array<float>"), "toxic-features")


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sample = pd.concat([pd.DataFrame({"toxic": [], "ids": [], "shares": []}), *batches])
    w, b = fit(sample["toxic"].to_numpy(np.float64), list(sample["ids"]), list(sample["shares"]))
    yield pd.DataFrame({"weights": [w.tobytes()], "bias": [b]})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple[np.ndarray, float]:
    """The weights (4 MB, whatever the input) of the classifier; one task fits it."""
    sample = training_rows(docs, labels, rows, chars)
    model = sample.coalesce(1).mapInPandas(_train, "weights binary, bias double").first()
    if model is None:  # no partition at all
        return fit(np.empty(0), [], [])
    return np.frombuffer(model["weights"], np.float32), model["bias"]


def _score(model):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = model.value
        known: dict[bytes, float] = {}
        for part in batches:
            split = [words_of(t) for t in part]
            words = set().union(*split)
            if len(known) > CACHED_WORDS:
                known = {}
            new = list(words.difference(known))
            for at in range(0, len(new), 20_000):
                some = new[at : at + 20_000]
                bucket, owner = grams(some)
                known.update(zip(some, np.bincount(owner, weights=weights[bucket], minlength=len(some)).tolist()))
            of = known.__getitem__
            z = np.array([bias + (sum(map(of, x)) / len(x) if x else 0.0) for x in split])
            for w in [w for w in words if len(w) > CACHED_LENGTH]:
                del known[w]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -700.0, 700.0))))

    return F.pandas_udf(run, DoubleType())


def score(docs: DataFrame, labels: DataFrame, trained_on: Column, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) per document. ``trained_on`` is a condition on doc_id:
    only labels of such rows are learnt from. The score is 0 to 1; ``predicted`` is 1
    from 0.5. Null and empty texts have no words and get the score of the bias alone.
    Without labels every score is 1/3. Repeated rows and null ids keep their rows, an
    empty table gives none.
    """
    plain = texts(docs, id_col, text_col)
    known = labels.select(column("doc_id").cast("long").alias("doc_id"), column("toxic").alias("toxic")).where(trained_on)
    model = docs.sparkSession.sparkContext.broadcast(train(plain, known, rows, chars))
    out = plain.select("doc_id", _score(model).asNondeterministic()("text").alias("score"))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
