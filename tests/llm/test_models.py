"""Classifiers, language models, archives, search and the pipeline."""

import gzip
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, kneser_ney, masked_lm, shards, suffix, toxicity, warc
from tidemark.llm.common import unstage
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, r, words):
    return " ".join(r.choice(words) for _ in range(n))


def vocabulary(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean, noisy and rude documents, and the edges; labels for most."""
    r, words, rude = random.Random(2), vocabulary(300, 1), ["blark", "zworg", "kvetz"]
    rows, labels = [], []
    for i in range(600):
        kind = i % 6
        ws = [r.choice(words) for _ in range(r.randint(60, 120))]
        if kind == 0:
            ws = [w.upper() + "%%%" if r.random() < 0.5 else "#" * r.randint(1, 9) for w in ws]
        if kind == 1:
            ws = [r.choice(rude) if r.random() < 0.1 else w for w in ws]
        rows.append((i, " ".join(ws), "ab"[i % 2], "s", 0))
        if i % 10:
            labels.append((i, int(kind != 0), int(kind == 1)))
    rows += [(1000, None, None, None, None), (1001, "", "a", "s", 0), (1002, " \n\t", None, "s", 0), (None, "no id here", "a", "s", 0), rows[0], (1003, "x" * 50_000, "a", "s", 0)]
    labels += [(None, 1, 1), (5, None, None), (8, 1, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_kneser_ney_sums_to_one(spark):
    r, words = random.Random(4), vocabulary(50, 3)
    train = spark.createDataFrame([(prose(200, r, words),) for _ in range(20)] + [(None,), ("",)], "text string")
    logp, logb = (dict(map(tuple, t.collect())) for t in kneser_ney.model_tables(train, 4))
    model = kneser_ney.Model(logp, logb, 4)
    letters = [g for g in logp if len(g) == 1]
    for context in ["", kneser_ney.EDGE, "a", "qq", kneser_ney.EDGE + words[0][:2], words[1][:3]]:
        total = 0.0
        for c in [*letters, "☃"]:  # the last stands for all unseen characters
            g, held = context + c, 0.0
            while g not in logp and len(g) > 1:
                held += logb.get(g[:-1], 0.0)
                g = g[1:]
            total += math.exp(held + (logp[g] if g in logp else model.unseen))
        assert total == pytest.approx(1.0, abs=1e-9)


def test_kneser_ney_words_by_every_context(spark):
    """The longest met context gives what trying all contexts gives."""
    r, words = random.Random(9), vocabulary(60, 5)
    train = spark.createDataFrame([(prose(150, r, words),) for _ in range(12)], "text string")
    for order in (2, 3, 5):
        logp, logb = (dict(map(tuple, t.collect())) for t in kneser_ney.model_tables(train, order))
        model = kneser_ney.Model(logp, logb, order)
        odd = ["".join(r.choice("abcdefghijklmnop☃") for _ in range(r.randrange(1, 12))) for _ in range(300)]
        for word in [*words, *odd, kneser_ney.EDGE, "x" + kneser_ney.EDGE + words[0], "☃" * 9]:
            w, total = kneser_ney.EDGE + word + kneser_ney.EDGE, 0.0
            for i in range(1, len(w)):
                h = max(0, i - order + 1)
                while h < i and w[h : i + 1] not in logp:
                    total += logb.get(w[h:i], 0.0)
                    h += 1
                total += logp.get(w[h : i + 1], model.unseen) if h == i else logp[w[h : i + 1]]
            assert model.spelt(word.encode()) == (total, len(w) - 1), word


def test_kneser_ney_by_hand(spark):
    """Two words, order 2: every number of the formulas."""
    train = spark.createDataFrame([("ab ab ac",)], "text string")
    logp, _ = (dict(map(tuple, t.collect())) for t in kneser_ney.model_tables(train, 2))
    # bigrams ^a 3, ab 2, ac 1, b$ 2, c$ 1: n1 = 2, n2 = 2, n3 = 1, so Y = 1/3
    d1, d2, d3 = 1 - 2 / 3 * 1, 2 - 3 * (1 / 3) * (1 / 2), 2.95
    # unigrams count what they follow: a 1, b 1, c 1, $ 2; n1 = 3, n2 = 1, Y = 3/5
    u1, u2 = 1 - 2 * 0.6 / 3, 1.95
    held = (3 * u1 + u2) / 5
    p_b = (1 - u1) / 5 + held / 5
    assert math.exp(logp["b"]) == pytest.approx(p_b)
    assert math.exp(logp["ab"]) == pytest.approx((2 - d2) / 3 + (d1 + d2) / 3 * p_b)
    assert d3 == 2.95  # no counts of four: the largest discount allowed


def test_quality_classifier(spark, corpus):
    docs, labels = corpus
    got = kneser_ney.classify(docs, labels).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    for i in (1000, 1001, 1002):
        assert by_id[i].symbols == 0 and by_id[i].perplexity is None and not by_id[i].kept
    assert np.mean([by_id[i].kept for i in range(600) if i % 6 > 1]) > 0.97
    assert not any(by_id[i].kept for i in range(0, 600, 6))
    assert kneser_ney.classify(docs.limit(0), labels).count() == 0
    alone = kneser_ney.classify(docs, labels.limit(0)).where("doc_id < 600").collect()
    assert all(r.kept and r.threshold is None for r in alone)


def test_masked_lm_gradient():
    r = np.random.default_rng(1)
    w = {k: x.astype(np.float64) + r.normal(0, 0.1, x.shape) for k, x in masked_lm.initial().items()}
    docs = [r.integers(0, 2048, n).astype(np.int32) for n in (1, 5, 40)]
    near, middle = masked_lm.windows(docs)
    assert near.shape == (46, 6) and (near[0] == 2048).all() and near[1].tolist()[3:] == docs[1][1:4].tolist()
    loss = lambda v: -masked_lm.log_probabilities(v, near, middle).mean()
    moved = {k: x.copy() for k, x in w.items()}
    masked_lm.train_batch(moved, {k: np.ones_like(x) for k, x in w.items()}, near, middle, rate=1e-3)
    for name in w:  # with seen = 1 and a tiny step, the move is the gradient
        at = tuple(np.unravel_index(np.abs(moved[name] - w[name]).argmax(), w[name].shape))
        up, down = ({k: x.copy() for k, x in w.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        g = (loss(up) - loss(down)) / 2e-5
        assert (w[name][at] - moved[name][at]) / 1e-3 == pytest.approx(g / math.sqrt(1 + g * g), rel=1e-3)


def test_masked_lm_is_a_distribution():
    w = masked_lm.initial()
    near = np.tile(np.array([[1, 2, 2048, 7, 9, 2048]], np.int32), (2048, 1))
    p = np.exp(masked_lm.log_probabilities(w, near, np.arange(2048, dtype=np.int32)))
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_masked_lm_scores(spark, corpus):
    docs, _ = corpus
    counts = {bytes(r.word): r.n for r in masked_lm.word_counts(docs.select("doc_id", "text")).collect()}
    assert counts[b"x" * 50_000] == 1 and counts[b"id"] == 1
    got = masked_lm.score(docs).collect()
    start = masked_lm.score(docs, rounds=0).collect()
    assert len(got) == docs.count()
    assert {(r.n_words, r.log_likelihood, r.mean_log_likelihood) for r in got if r.doc_id in (1000, 1001, 1002)} == {(0, 0.0, None)}
    better = lambda rows: np.mean([r.mean_log_likelihood for r in rows if r.n_words])
    assert better(got) > better(start) + 0.2
    assert masked_lm.score(docs.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark, corpus):
    docs, labels = corpus
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    got = toxicity.score(docs, labels, ~held).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = [(r.predicted, r.doc_id % 6 == 1) for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(b"%d" % r.doc_id) % 5 == 0]
    assert np.mean([p == t for p, t in truth]) > 0.97
    # labels of held-out rows change nothing
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(docs, turned, ~held).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert {round(r.score, 6) for r in toxicity.score(docs, labels.limit(0), ~held).collect()} == {round(1 / 3, 6)}
    assert toxicity.score(docs.limit(0), labels, ~held).count() == 0


def test_toxicity_bounds(spark, corpus):
    docs, labels = corpus
    sample = toxicity.training_rows(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), rows=50, chars=5000)
    assert 0 < sample.count() < 20


def test_archives_round_trip(spark):
    big, odd = "<p>é\r\n\r\nWARC/1.1\r\n\r\n" * 80, "\x00\x01 mixed \r\n\r\n" * 100
    rows = [
        (1, "http://a/1", big), (2, "http://a/ 2\r\nX: y", big), (9, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
        (7, "u", odd), (None, "u", odd), (8, "u", "x" * 1000), (8, "u", "x" * 1000), (10, "u", "x" * 999), (11, "u", "x" * 999),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows) and all(r.request and r.metadata for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    keep = by_id[9][0]
    assert keep.response.record_type == "response" and bytes(keep.response.payload) == big.encode() and keep.url is None
    for i in (1, 2):
        r = by_id[i][0]
        assert r.response.record_type == "revisit" and r.response.refers_to == keep.capture_id and bytes(r.response.payload) == b""
        assert r.payload_bytes == len(big.encode()) and r.response.digest == keep.response.digest
    assert by_id[2][0].url == "http://a/%202%0D%0AX:%20y"
    assert bytes(by_id[7][0].response.payload) == odd.encode() and by_id[None][0].response.refers_to == by_id[7][0].capture_id
    assert [bytes(by_id[i][0].response.payload) for i in (3, 4, 5, 6)] == [b"", b"", b"short", b"short"]
    assert sorted(r.response.record_type for r in by_id[8]) == ["response", "revisit"]
    assert by_id[10][0].response.record_type == by_id[11][0].response.record_type == "response"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_not_written_twice(spark, tmp_path, monkeypatch):
    """What is kept of transactions is staged without the payloads, digests are of what was read back."""
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(string(id % 300), 512), 40) AS html")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    staged, before = [], warc.stage
    monkeypatch.setattr(warc, "stage", lambda df, name: staged.append(before(df, name)) or staged[-1])
    got = {r.page_id: r for r in QUERIES["op7_warc_transactions"](spark, f"file://{tmp_path}").collect()}
    assert all("payload" not in (f.dataType.simpleString() + f.name).replace("payload_", "") for df in staged for f in df.schema)
    assert all(r.request.block and r.metadata.block for df in staged for r in df.collect())
    for r in pages.collect():
        x, keeper = got[r.page_id], r.page_id + 300 if r.page_id < 100 else None
        assert (x.payload_bytes, x.payload_digest) == (5120, hashlib.sha1(r.html.encode()).hexdigest())
        assert (x.record_type, x.refers_to) == ("revisit" if keeper else "response", keeper)
    some = warc.round_trip(pages.limit(3), keep=["page_id", "response.payload"]).collect()
    assert len(some) == 3 and all(len(r.payload) == 5120 for r in some)


def test_archives_from_elsewhere(spark, tmp_path):
    """Unmatched, repeated and orphan records; a damaged archive is an error."""
    def record(kind, rid, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    data = record("response", "r1", b"HTTP/1.1 200 OK\r\n\r\nbody", "WARC-Target-URI: http://x") + record("response", "r2", b"HTTP/1.1 200 OK\r\n\r\n")
    data += record("request", "q1", b"GET", "WARC-Concurrent-To: <r1>") + record("request", "q2", b"GET", "WARC-Concurrent-To: <r1>") + record("request", "q3", b"GET", "WARC-Concurrent-To: <gone>")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    got = {r.capture_id: r for r in warc.transactions(warc.read(spark, f"file://{tmp_path}")).collect()}
    assert set(got) == {"<r1>", "<r2>"} and got["<r1>"].request.record_id == "<q1>" and got["<r2>"].request is None and got["<r1>"].page_id is None
    assert bytes(got["<r1>"].response.payload) == b"body" and got["<r1>"].url == "http://x"
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(data[:-6]))


def test_archives_of_many_members(spark, tmp_path):
    """A gzip member a record, as the format recommends, padding, and any piece size."""
    def record(i, body):
        return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r{i}>\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"

    r = random.Random(3)
    bodies = [b"HTTP/1.1 200 OK\r\n\r\n" + bytes(r.choices(b"ab\r\n\0WARC/", k=n)) for n in (0, 5, 300_000, 17, 4000)]
    data = b"".join(record(i, b) for i, b in enumerate(bodies))
    for size in (1, 7, 1000, len(data)):
        pieces = [data[i : i + size] for i in range(0, len(data), size)] if size > 1 else [data[:2000][i : i + 1] for i in range(2000)] + [b"", data[2000:]]
        assert [x[6] for x in warc.parse(pieces)] == bodies
    members = b"".join(gzip.compress(record(i, b)) for i, b in enumerate(bodies)) + b"\0" * 512
    assert b"".join(warc.inflate(members)) == data == b"".join(warc.inflate(gzip.compress(data)))
    (tmp_path / "b.warc.gz").write_bytes(members)
    got = {x["record_id"]: bytes(x["block"]) for x in warc.read(spark, f"file://{tmp_path}").collect()}
    assert got == {f"<r{i}>": b for i, b in enumerate(bodies)}
    for broken in (members[:-600], gzip.compress(data)[:-9]):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.parse(warc.inflate(broken)))
    for broken in (data[:-6], data[:40], b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse([broken]))



def exact(rows, k):
    """Brute force over (id, vector) pairs, repeated pairs once."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % 50 == 0:
            score = ann.cosine(x, np.array(v, float)[None, :])
            out[i] = sorted(((-s, j) for s, (j, _) in zip(score, rows) if j != i))[:k]
    return out


def test_graph_search_recall_and_scores(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(30, 24))
    x = (centres[r.integers(0, 30, 3000)] + 0.5 * r.normal(size=(3000, 24))).astype(np.float32)
    x[200:900] = x[200]  # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [None] * 24), (None, x[0].tolist()), (100, x[100].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for a in ann.nearest(df, F.col("vec_id") % 50 == 0, shard=1000).orderBy("query_id", "rank").collect():
        got.setdefault(a.query_id, []).append((a.vec_id, a.score, a.rank))
    want = exact(rows, 5)
    assert set(got) == set(want)
    hits = sum(len({i for i, _, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    assert [i for i, _, _ in got[250]] == [200, 201, 202, 203, 204] and [i for i, _, _ in got[200]] == [201, 202, 203, 204, 205]
    scores = {(q, i): -s for q, near in exact(rows, 3000).items() for s, i in near}
    for q, near in got.items():
        assert [k for _, _, k in near] == [1, 2, 3, 4, 5]
        assert all(s == scores[q, i] for i, s, _ in near)


def test_graph_search_with_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 0.0]), (3, [1.0])], schema)
    got = [(a.query_id, a.rank, a.vec_id) for a in ann.nearest(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(few.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, fn in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.stage(fn(spark, kept[-1], SF), "test-stage"))
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] >= ids[1] >= ids[2] == ids[3] >= ids[4]
    packed = corpus_pipeline.best_fit_packing(spark, kept[-1], SF)
    assert packed.where("piece = 0").count() == kept[-1].count()
    assert QUERIES["pipeline"](spark, SF).count() == packed.count()
    empty = docs.limit(0)
    for _, fn in corpus_pipeline.STAGES:
        assert fn(spark, empty, SF).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    ok, message, _ = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert ok, message


def test_all_ten_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}


def test_word_ids_and_shapes():
    ids = masked_lm.Ids([b"the", b"of"])
    text = b"the of The THE2 a.b 99 \xc3\xa9t\xc3\xa9 ... " + b"x" * 100
    slow = []
    for w in text.split():
        kinds = [any(c in s for c in w) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(97, 123)) + bytes(range(128, 256)), b"0123456789")]
        kinds.append(any(33 <= c <= 126 and not chr(c).isalnum() for c in w))
        size = sum(len(w) >= k for k in (4, 8, 14))
        slow.append({b"the": 64, b"of": 65}.get(w, size * 16 + sum(k << (3 - i) for i, k in enumerate(kinds))))
    assert ids.of(text).tolist() == ids.of(text).tolist() == slow
    assert b"x" * 100 not in ids.known and len(ids.of(b" \n")) == 0


def test_masked_lm_tells_rare_words_apart(spark):
    """Words beyond the vocabulary have their own probability, by count and spelling."""
    vocab = [f"w{i}" for i in range(masked_lm.VOCABULARY)]
    rows = [(" ".join(vocab) + " ") * 30 + "lanterns " * 5 + "gatherings mornings evenings rainings leanings landings", "w1 lanterns w2", "w1 gatherings w2", "w1 qzxkvwjqpx w2"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    counts = masked_lm.word_counts(docs)
    top = [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(masked_lm.VOCABULARY).collect()]
    logp = {bytes(r.word): r.logp for r in masked_lm.word_probabilities(counts, top).collect()}
    by_shape = {}
    for w, p in logp.items():
        by_shape[int(masked_lm.shapes([w])[0])] = by_shape.get(int(masked_lm.shapes([w])[0]), 0) + math.exp(p)
    assert len(logp) == 8 and all(s == pytest.approx(1) for s in by_shape.values())
    got = {r.doc_id: r.log_likelihood for r in masked_lm.score(docs, rounds=0).collect()}
    assert got[1] > got[2] > got[3]  # one shape, so one id in the middle
    ids = masked_lm.Ids(top)
    near, middle = masked_lm.windows([ids.codes(rows[i].encode().split()) for i in (1, 3)])
    assert near[0].tolist() != near[3].tolist() and middle[1] == middle[4] < masked_lm.SHAPES


def test_masked_lm_trains_on_every_word(spark, monkeypatch):
    """Over the rounds each place of each text is a target once, whatever the batches."""
    docs = [np.arange(n, dtype=np.int32) for n in (1, 5, 40)]
    met = [masked_lm.windows(docs, turn, 2) for turn in range(2)]
    whole = masked_lm.windows(docs)
    rows = lambda near, middle: sorted(map(tuple, np.column_stack([near, middle]).tolist()))
    assert rows(*whole) == rows(*map(np.concatenate, zip(*met)))
    seen = []
    monkeypatch.setattr(masked_lm, "train_batch", lambda w, s, near, middle: seen.append(len(middle)))
    one = spark.sparkContext.broadcast(([b"a"], masked_lm._flat(masked_lm.initial())))
    monkeypatch.setattr(masked_lm.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_arrays([pa.array(["a b " * n for n in (1, 30, 20_000)] + [None, "a"])], ["text"])
    for turn in range(masked_lm.ROUNDS):
        list(masked_lm._train_task(one, turn, masked_lm.ROUNDS)(iter([batch])))
    assert sum(seen) == 2 * 20_031 + 1


def test_quality_depends_on_word_order(spark):
    """Pairs by hand, sums of one, and order, repeats and unseen words in a text."""
    train = spark.createDataFrame([("the cat sat on the mat the cat ran",)] * 3 + [("a dog sat on a mat",)] * 3, "text string")
    logp, logb = (dict(map(tuple, t.collect())) for t in kneser_ney.model_tables(train))
    words, pairs = kneser_ney.pair_tables(train)
    model = kneser_ney.Model(logp, logb, 5, words, pairs)
    size = len(words)
    assert words == sorted(words) and size == 8
    back, own = pairs["back"], pairs["own"]
    assert back[size + 1] + own.sum() == pytest.approx(1)
    for v in range(size + 1):  # shares after a word and what it leaves
        share = pairs["own_pair"][pairs["pair"] // (size + 1) == v].sum()
        assert share + (back[v] if share else 0) == pytest.approx(1 if share else 0)
    clean, shuffled, repeated = (model.texts([t])[0] for t in ("the cat sat on a mat", "mat a on sat cat the", "cat cat cat cat cat cat"))
    assert clean[0] == shuffled[0] and clean[1] < 0.8 * shuffled[1] and clean[1] < 0.8 * repeated[1]
    assert model.texts([None, " ", "zebra zebra"])[:2] == [(0, None), (0, None)]


def test_one_long_text_does_not_void_the_samples(spark):
    docs = spark.createDataFrame([(i, "abc " * 25) for i in range(40)], "doc_id long, text string")
    first = docs.orderBy(F.xxhash64("doc_id")).first().doc_id
    docs = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("xyz "), 5000)).otherwise(F.col("text")))
    ids = docs.select("doc_id")
    for chars, least in ((4000, 30), (10_000, 40), (30_000, 40)):
        texts = [r.text for r in kneser_ney.sample(docs, ids, chars=chars).collect()]
        toxic = toxicity.training_rows(docs, ids.withColumn("toxic", F.lit(1)), chars=chars).count()
        assert sum(map(len, texts)) <= chars and min(len(texts), toxic) >= least


def test_thresholds_of_small_languages(spark, monkeypatch):
    """No switch by size, and an outlier is no threshold."""
    def thresholds(sizes, outlier=None):
        rows = [(lang, 5 + 0.01 * i + 3 * (lang == "b")) for lang, n in sizes.items() for i in np.linspace(0, 100, n)]
        rows += [("a", outlier)] if outlier else []
        made = [(i, lang, 10, float(p)) for i, (lang, p) in enumerate(rows)]
        scored = spark.createDataFrame(made, "doc_id long, lang string, symbols long, perplexity double")
        monkeypatch.setattr(kneser_ney, "perplexities", lambda *a: scored)
        labels = spark.createDataFrame([(i, 1) for i in range(len(rows))], "doc_id long, quality int")
        out = kneser_ney.classify(scored, labels, folds=1)
        return {r.lang: r.threshold for r in out.select("lang", "threshold").distinct().collect()}

    few, more, outlier = thresholds({"a": 300, "b": 99}), thresholds({"a": 300, "b": 101}), thresholds({"a": 107, "b": 99}, 40.0)
    assert few["a"] < few["b"] and abs(few["b"] - more["b"]) < 0.1
    assert outlier["a"] < thresholds({"a": 107, "b": 99})["a"] + 0.1


def test_graph_looks_at_all_reverse_edges():
    """Of 300 nodes that point at one the nearest stay, wherever they stand."""
    r = np.random.default_rng(6)
    x = ann._unit(r.normal(size=(301, 24)))
    x[300] = ann._unit((x[0] + 0.1 * x[1])[None, :])[0]  # the nearest of all comes last
    edges = np.full((301, 32), -1, np.int64)
    ann._add_back(x, edges, np.arange(1, 301), np.zeros(300, np.int64), 32, 1.0)
    assert 300 in edges[0]


def test_graph_recall_on_full_shards_of_clusters():
    r = np.random.default_rng(8)
    hits = 0
    for _ in range(2):
        centres = r.normal(size=(12, 16))
        x = ann._unit(centres[r.integers(0, 12, ann.SHARD)] + 0.15 * r.normal(size=(ann.SHARD, 16)))
        edges, start = ann.build_graph(x)
        q = x[:: ann.SHARD // 100]
        found, _ = ann.beam_search(x, edges, start, q, ann.SEARCH_BEAM)
        want = np.argsort(1 - q @ x.T, axis=1, kind="stable")[:, :6]
        hits += sum(len({*a[:6].tolist()} & {*b.tolist()}) for a, b in zip(found, want)) / want.size
    assert hits / 2 >= 0.95


def test_texts_of_one_id_have_their_own_keys(spark):
    rows = spark.range(3000).select(F.lit(1).alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert rows.select(*suffix._keys("doc_id", "text")).distinct().count() == 3000
    twice = "".join(random.Random(1).choices("abcdef", k=300))
    docs = spark.createDataFrame([(1, f"{i} {twice}" if i < 2 else f"{i} short") for i in range(20)], "doc_id long, text string")
    got = suffix.remove_repeats(docs).collect()
    assert len(got) == 20 and sum(len(r.spans) > 0 for r in got) == 2


def test_word_cache_is_bounded_with_long_words(monkeypatch):
    monkeypatch.setattr(kneser_ney, "CACHED_WORDS", 50)
    model = kneser_ney.Model({"a": -1.0, "b": -2.0}, {"": -0.5}, 3)
    once = kneser_ney.Model({"a": -1.0, "b": -2.0}, {"": -0.5}, 3)
    for i in range(300):
        text = "ab " + "a" * (70 + i)  # a word too long to be kept, another one in each text
        assert model.texts([text]) == once.texts([text])
        assert model.met <= 52 and len(model.known) <= 52
        once.forget()


def test_toxicity_grams_are_of_code_points():
    words = ["дурак".encode(), "坏人".encode(), b"ab"]
    bucket, owner = toxicity.grams(words)
    for i, w in enumerate(w.decode() for w in words):
        marked = "^" + w + "$"
        assert (owner == i).sum() == sum(max(len(marked) - n + 1, 0) for n in toxicity.GRAMS)
        alone = toxicity.grams([w.encode()])[0]
        assert sorted(alone) == sorted(bucket[owner == i])  # neighbours do not matter
    assert toxicity.words_of("ДУРАК\u00a0Ä\tB\n") == ["дурак\u00a0ä".encode(), b"b"]
    same, other = toxicity.grams(["дура".encode()])[0], toxicity.grams(["кура".encode()])[0]
    assert len(set(same) & set(other)) == 6  # of 14 grams those that hold neither the edge before nor the first letter


def test_quality_model_counts_all_trusted_text(spark, monkeypatch):
    """What 6,001 and more trusted texts say counts, to the last one; joins give what the
    tables of one task give, whichever facts are broadcast."""
    r, words = random.Random(11), vocabulary(120, 12)
    rows = [(i, prose(r.randrange(1, 12), r, words), "a") for i in range(6400)]
    rows += [(7000, "☃ zebra " + words[0], "a"), (7001, rows[0][1], "a"), (7002, None, "a"), (7003, " \n", None), (7004, "x" * 3000, "b"), (None, words[1], "b"), (5, rows[9][1], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(6400)], "doc_id long, quality int")
    every = {(x.doc_id, x.lang, x.symbols): x.perplexity for x in kneser_ney.perplexities(docs, labels, F.lit(True), rows=10_000).collect()}
    for held in (0, 100, 1_000_000):
        monkeypatch.setattr(kneser_ney, "FACTS_HELD", held)
        got = kneser_ney.perplexities(docs, labels, F.lit(True)).collect()
        assert len(got) == len(rows)
        for x in got:
            want = every[x.doc_id, x.lang, x.symbols]
            assert x.perplexity == (want if want is None else pytest.approx(want, rel=1e-9)), x
    none = kneser_ney.perplexities(docs, labels.limit(0), F.lit(True)).where("symbols > 0").agg(F.min("perplexity"), F.max("perplexity")).first()
    assert tuple(none) == (1.0, 1.0)


def test_masked_lm_holds_frequent_words_only(spark, monkeypatch):
    """Broadcast or joined, a word beyond the vocabulary counts the same, and what is
    broadcast is bounded; what tasks learnt goes into sums without being staged."""
    vocab = [f"w{i}" for i in range(masked_lm.VOCABULARY)]
    rows = [(" ".join(vocab) + " ") * 9 + "lanterns " * 5 + "evenings evenings rainings landings", "w1 lanterns w2 landings", "w1 evenings lanterns", None, "qzxkvwjqpx"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got, often, staged = {}, masked_lm._frequent, []
    for held, words in ((0, 0), (1, 1), (4, 3), (100, 5)):  # counts 7, 3, 2, 1, 1: those of a count are held together
        met = []
        monkeypatch.setattr(masked_lm, "WORDS_HELD", held)
        monkeypatch.setattr(masked_lm, "_frequent", lambda known: met.append(often(known)) or met[0])
        got[held] = [r.log_likelihood for r in masked_lm.score(docs, rounds=0).orderBy("doc_id").collect()]
        assert len(met[0][0]) == words
    assert all(x == pytest.approx(got[0], rel=1e-9) for x in got.values()) and got[0][3] == 0 and len(set(got[0])) == 5
    plain = masked_lm.stage
    monkeypatch.setattr(masked_lm, "stage", lambda df, name: staged.append(name) or plain(df, name))
    masked_lm.train(docs, [b"w1"], 2)
    assert {x.rstrip("01") for x in staged} == {"lm-sums"}


def test_quality_model_leaves_little_on_disk(spark, tmp_path, monkeypatch):
    """Pairs go through shuffles in slices, tables no longer read go away, nobody else's do."""
    r, words = random.Random(5), vocabulary(60, 6)
    docs = spark.createDataFrame([(i, prose(20, r, words), "a") for i in range(200)] + [(500, "y" * 3000 + " " + words[0], "a")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in (*range(100), 500)], "doc_id long, quality int")
    plain, got = kneser_ney.stage, {}
    for slices in (1, 3):
        staged = []
        monkeypatch.setattr(kneser_ney, "SLICES", slices)
        monkeypatch.setattr(kneser_ney, "stage", lambda df, name: staged.append((name, df.count(), out := plain(df, name), out.inputFiles())) or out)
        got[slices] = {x.doc_id: x.perplexity for x in kneser_ney.perplexities(docs, labels, F.lit(True)).collect()}
        pairs = [n for name, n, *_ in staged if name == "kn-pairs"]
        assert len(pairs) == slices and max(pairs) < sum(pairs) * (1.1 if slices == 1 else 0.7)
        left = {name for name, _, _, files in staged if any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in files)}
        assert left <= {"kn-parts", "kn-sums"}, left
    assert got[1] == pytest.approx(got[3], rel=1e-12) and all(math.isfinite(p) for p in got[1].values())
    docs.write.parquet(at := f"{tmp_path}/docs-0123456789ab")
    unstage(spark.read.parquet(at))
    assert spark.read.parquet(at).count() == 201


def test_words_as_keys():
    """Words, symbols and what stands around them as bytes.split() has them; packing is lossless."""
    r = random.Random(3)
    parts = ["a", "b", " ", "\n", "\t", "\x0b", "\xa0", "é", "☃", "𝄞", "\0", "longer-than-8", "q" * 70, "q" * 71]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(400)] + [None, "", " ", "a", "a\0", "a\0\0"]
    words = shards.Words(pa.chunked_array([pa.array(texts[:90]), pa.array(["left out", *texts[90:]]).slice(1)]))
    split = [(t or "").encode().split() for t in texts]
    flat = [w for ws in split for w in ws]
    assert words.count.tolist() == [len(ws) for ws in split]
    assert words.symbols.tolist() == [sum(len(w.decode()) + 1 for w in ws) for ws in split]
    assert [words.raw[s : s + n].tobytes() for s, n in zip(words.start, words.size)] == flat
    assert len({*zip(flat, words.key)}) == len({*flat}) == len({*words.key})
    key = dict(zip(flat, words.key))
    assert words.last().tolist() == [key[ws[-1]] for ws in split if ws]
    assert words.before().tolist() == [key[w] if w else shards.START for ws in split for w in [None, *ws[:-1]][: len(ws)]]
    for x in (words.key, np.sort(words.key), words.size.astype("<u4"), np.array([0.5, -1e300]), words.raw, words.key[:0], words.raw[:0]):
        assert (shards.unpacked(pa.py_buffer(shards.packed(x)), x.dtype) == x).all()
    table = shards.table_of(words.key[:100], np.arange(100.0))
    assert shards.look_up(table, words.key)[0].tolist() == np.isin(words.key, words.key[:100]).tolist()


def test_quality_words_travel_packed(spark, monkeypatch):
    """Neither a word nor a pair is a row of what is staged, and chunks, shards, held n-grams and
    hot pairs do not change a result."""
    r, words = random.Random(21), vocabulary(150, 22)
    docs = spark.createDataFrame([(i, prose(40, r, words) + " so it is" * (i % 40), "a") for i in range(300)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(150)], "doc_id long, quality int")
    want = {x.doc_id: x.perplexity for x in kneser_ney.perplexities(docs, labels, F.lit(True), rows=10_000).collect()}
    pairs = len({p for d in docs.where("doc_id < 150").collect() for p in zip(["", *d.text.split()], d.text.split())})
    plain = kneser_ney.stage
    for grams, size, hot, held in ((0, 400, 8, 20), (60, 3000, 2048, 0)):
        staged = {}
        monkeypatch.setattr(kneser_ney, "stage", lambda df, name: staged.update({name: staged.get(name, 0) + (out := plain(df, name)).count()}) or out)
        for where, name, value in ((kneser_ney, "GRAMS_HELD", grams), (kneser_ney, "SHARD_BYTES", size), (kneser_ney, "HOT", hot), (kneser_ney, "FACTS_HELD", held), (shards, "CHUNK", 5000)):
            monkeypatch.setattr(where, name, value)
        got = {x.doc_id: x.perplexity for x in kneser_ney.perplexities(docs, labels, F.lit(True)).collect()}
        assert got == pytest.approx(want, rel=1e-9)
        assert 8 < max(staged[name] for name in ("kn-vocabulary", "kn-pairs", "kn-words")) < pairs / 10
