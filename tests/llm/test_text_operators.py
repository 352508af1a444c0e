"""Rules, packing, near and exact duplicates, mixing: against brute force and at the edges."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import mixing, packing, rules, simhash, suffix
from tidemark.llm.components import components, local_forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `start` string, `a.b` int"


def rows(*texts, sources=("s",), ids=None):
    return [(i if ids is None else ids[i], t, "en", sources[i % len(sources)], len(t or ""), "x", 1) for i, t in enumerate(texts)]


def vocabulary(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n)]


def prose(n, seed, words=vocabulary(400)):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def repeated_words(ws):
    at = {}
    for i in range(len(ws) - 2):
        at.setdefault(tuple(ws[i : i + 3]), []).append(i)
    return len({i + k for x in at.values() if len(x) > 1 for i in x for k in range(3)})


EDGES = [None, "", " \t\n", "one", "a b c a b c", "a a a a a", "#$%\n#$%\n\n#$%", "É" * 40 + " \x85 ü", prose(300, 3), prose(300, 3), "X Y " * 200, "w\n" * 100]


def test_rules_match_plain_counts(spark):
    docs = spark.createDataFrame(rows(*EDGES), DOCS)
    got = {r.doc_id: r for r in rules.ledger(docs).collect()}
    assert len(got) == len(EDGES)
    for i, t in enumerate(EDGES):
        t = t or ""
        ws, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeated_words(ws))
        assert bool(r.failure_bits & 1) == (len(ws) < 50)
        assert bool(r.failure_bits & 2) == (100 * repeated_words(ws) > 50 * len(ws))


def test_rules_keep_and_ablation(spark):
    docs = spark.createDataFrame(rows(*EDGES), DOCS)
    kept = rules.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {8, 9}
    table = {r.rule: r for r in rules.ablation(rules.ledger(docs)).collect()}
    assert table["few_words"].n_docs == 12 and table["few_words"].n_kept == 2
    bits = [r.failure_bits for r in rules.ledger(docs).collect()]
    for r in rules.RULES:
        assert table[r.name].n_failed == sum(bool(b >> r.bit & 1) for b in bits)
        assert table[r.name].n_failed_only == sum(b == 1 << r.bit for b in bits)
    empty = spark.createDataFrame([], DOCS)
    assert rules.ledger(empty).count() == rules.keep(empty).count() == 0
    assert {r.n_docs for r in rules.ablation(rules.ledger(empty)).collect()} == {0}


def test_words_with_many_ids_do_not_clash():
    ws = [b"%d" % (i % 1_100_000) for i in range(1_100_000)] + [b"0", b"1", b"2"]
    assert rules._repeated(ws) == 6


def test_targets_share_and_stop(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5), ("z", 0)], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.targets(sizes).collect()}
    assert all(t <= 2 * s + 1e-9 for s, t in got.values())
    assert sum(t for _, t in got.values()) == pytest.approx(1.5 * 2015)
    # weights 5, 2, 1, 5, 2 in the order a, b, c, z, null: small ones stop, b and c share 2 : 1
    assert got["a"][1] == 20 and got[None][1] == 10 and got["z"][1] == 0
    assert got["b"][1] == pytest.approx(1995) and got["c"][1] == pytest.approx(997.5)


def test_mix_comes_near_targets(spark):
    r = random.Random(5)
    docs = [(i, prose(r.randint(0, 80), i), "en", r.choice(["a", "a", "a", "b", None, "d"]), 0, "x", 1) for i in range(3000)]
    docs += [docs[0]] * 5 + [(None, "some words here", "en", "b", 0, "x", 1)] * 2
    df = spark.createDataFrame(docs, DOCS)
    mixed = mixing.mix(df)
    got = mixed.toPandas()
    again = mixing.mix(df.repartition(7)).toPandas()
    key = ["doc_id", "source", "nth", "size"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert len(got) == len(docs) and (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() + 1e-6
    taken = mixing.take(df, mixed)
    assert taken.columns == df.columns and taken.count() == got.copies.sum()
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_is_exact_and_gapless(spark):
    texts = [None, "", "Don't STOP l'été!", "a<|endoftext|>b İstanbul ΣΑΣ", "日本語 한국어 x́ ²½", prose(30_000, 9), *[prose(n, n) for n in range(20, 900, 7)], "same", "same"]
    docs = spark.createDataFrame(rows(*texts), DOCS).repartition(5)
    got = packing.pack(docs, TOKENS, capacity=512, slack=4, digest=zlib.crc32, keep_ids=True).collect()
    plain = Tokenizer.from_file(TOKENS)
    by_doc = {}
    for r in got:
        assert r.digest == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) and r.start == 512 * r.piece
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [x for r in sorted(by_doc[i], key=lambda r: r.piece) for x in r.ids]
        assert ids == plain.encode(t or "", add_special_tokens=False).ids + [1]
    full = {}
    for r in got:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in full.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in got)
    assert len(full) <= 1.02 * total / 512
    assert packing.pack(spark.createDataFrame([], DOCS), TOKENS).count() == 0


def test_words_of_many_texts_are_looked_up_once():
    class Counting(dict):
        n = 0

        def get(self, *a):
            Counting.n += 1
            return super().get(*a)

    texts = ["The cat, the CAT\nand don't! l'été " * 50, None, "", "x" * 200 + " Ωμέγα 42 the", "naïve\u00a0the"] * 20
    plain, got = Tokenizer.from_file(TOKENS), packing.WordTokenizer(TOKENS)
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    got._ids = Counting(got._ids)
    assert got(pa.array(texts)) == want == got(pa.array(texts))
    assert Counting.n < 50  # of 14,500 words
    # where no id tells that a word ends, the tokenizer's own word numbers do
    other = packing.WordTokenizer(TOKENS)
    other._last[:] = False
    assert other(pa.array(texts, pa.large_string())) == want and other(pa.array([], pa.string())) == []


def test_best_fit_needs_few_bins():
    sizes = np.array([2500] * 10 + [1596] * 10 + [1] * 3)
    bins, offsets, fill = packing.best_fit(sizes, 4096)
    assert len(fill) == 11 and fill.max() == 4096 and np.bincount(bins, weights=sizes).tolist() == fill.tolist()


def test_golay_keys_find_all_links():
    r = np.random.default_rng(3)
    x = r.integers(-(1 << 63), 1 << 63, 300, dtype=np.int64)
    for a in range(64):
        for b in (a, (a * 7 + 13) % 64):
            y = (x.view(np.uint64) ^ np.uint64((1 << a) | (1 << b))).view(np.int64)
            (i, k), (j, m) = simhash.keys_of(x), simhash.keys_of(y)
            shared = set(zip(i.tolist(), k.tolist())) & set(zip(j.tolist(), m.tolist()))
            assert len({row for row, _ in shared}) == len(x)


def brute_components(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def slow_fingerprint(text):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) > 2 else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_near_duplicates_match_all_pairs(spark, bucket):
    r = random.Random(8)
    base = [prose(400, s).split() for s in range(6)]
    texts = [None, "", " \n", "one", "ONE", "two words", "É É É É"]
    for _ in range(90):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(rows(*texts) + rows(*texts[7:9], ids=[7, 8]) + [(None, "one", "en", "s", 3, "x", 1)], DOCS)
    got = simhash.near_duplicates(docs, bucket=bucket).collect()
    assert len(got) == len(texts) + 3
    by_id = {r.doc_id: r for r in got}
    fps = [slow_fingerprint(t) for t in texts]
    assert [by_id[i].fp & (2**64 - 1) for i in range(len(texts))] == fps
    assert [by_id[i].component_id for i in range(len(texts))] == brute_components(fps)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(fps)))
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (70, 3), (3, 70)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(1, 61), 70]}, **{1000 + i: 1000 for i in range(1, 50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = local_forest(np.array([5, 7, 9]), np.array([7, 9, 1]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(5, 1), (7, 1), (9, 1)]


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen, twice = set(), set()
    for b in raw:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            (twice if w in seen else seen).add(w)
    masks = []
    for b in raw:
        m = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in twice:
                m[i : i + length] = True
        masks.append(m)
    return raw, masks


@pytest.mark.parametrize(("length", "anchor", "group"), [(40, 12, suffix.GROUP), (40, 12, 1), (25, 24, 2), (30, 1, 3)])
def test_repeats_match_all_windows(spark, length, anchor, group):
    r = random.Random(length + anchor)
    passage, line = prose(30, 77), prose(6, 78)
    texts = [None, "", "short", "a" * 90, "ab" * 60, passage, "é" * 50, prose(50, 5), prose(50, 5)]
    for s in range(40):
        cut = r.randrange(60)
        texts.append(prose(r.randint(5, 40), s) + " " + (passage[cut : cut + r.randint(20, 120)] if s % 2 else line) + " ü " + prose(r.randint(5, 40), 1000 + s))
    docs = spark.createDataFrame(rows(*texts) + [(None, passage, "en", "s", 1, "x", 1)], DOCS)
    raw, masks = brute_repeats([*texts, passage], length)
    got = suffix.remove_repeats(docs, length, anchor, group).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        b, m = (raw[-1], masks[-1]) if row.doc_id is None else (raw[row.doc_id], masks[row.doc_id])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], m.astype(int), [0]])))
        assert bytes(row.kept) == bytes(np.frombuffer(b, np.uint8)[~m]) and list(row.spans) == edges.tolist() and row.n_bytes == len(b)
    left = suffix.strip_repeats(docs, length, anchor, group)
    assert left.columns == docs.columns
    for row in left.where("doc_id IS NOT NULL").collect():
        t, m = texts[row.doc_id], masks[row.doc_id]
        if t is None:
            assert row.text is None
        else:
            ends = np.cumsum([len(c.encode()) for c in t]).tolist()
            assert row.text == "".join(c for c, a, e in zip(t, [0, *ends], ends) if not m[a:e].all())
    empty = spark.createDataFrame([], DOCS)
    assert suffix.remove_repeats(empty).count() == suffix.strip_repeats(empty).count() == 0


def test_repeats_across_cuts_of_a_long_text(spark):
    r = random.Random(4)
    words = vocabulary(5000, 6)
    unique = " ".join(f"{r.choice(words)}{i}" for i in range(90_000))
    part = unique[suffix.CHUNK - 150 : suffix.CHUNK + 350]
    docs = spark.createDataFrame([(1, unique), (2, "- " + part + " -")], "doc_id long, text string")
    got = {x.doc_id: x for x in suffix.remove_repeats(docs).collect()}
    at = suffix.CHUNK - 150
    assert list(got[1].spans) == [at, at + 500] and list(got[2].spans) == [2, 502]
    assert hashlib.sha1(bytes(got[1].kept)).digest() == hashlib.sha1((unique[:at] + unique[at + 500 :]).encode()).digest()


def test_extra_columns_may_clash(spark):
    docs = spark.createDataFrame(rows(prose(80, 1), prose(80, 2)), DOCS)
    clash = docs.withColumns({c: F.lit(1) for c in ("id", "tag", "spans", "kept", "bits", "piece", "fp", "k1", "component", "size", "copies", "nth", "m", "doc", "left")})
    assert rules.keep(clash).columns == clash.columns
    named = docs.withColumn("__rule_measures", F.lit("mine"))
    assert {r["__rule_measures"] for r in rules.keep(named, "base").collect()} <= {"mine"} and rules.keep(named).columns == named.columns
    assert simhash.keep_one(clash).columns == clash.columns and simhash.keep_one(clash).count() == 2
    assert suffix.strip_repeats(clash).count() == 2
    assert mixing.take(clash, mixing.mix(clash)).columns == clash.columns
    assert packing.pack(clash, TOKENS).count() == 2


def test_dense_buckets_at_one_bit_link_direct_neighbours_only(spark):
    from tidemark.llm import simhash

    base, top = 0x1234, (1 << 62) | (1 << 63)
    fps = [base, base ^ top, base ^ 1, base ^ 1 ^ (1 << 40), base ^ (1 << 63), 77]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    d = spark.createDataFrame([(f,) for f in signed], "fp long")
    for bits in (1, 2):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in simhash._centres(d, bits).collect():
            a, b = a % (1 << 64), b % (1 << 64)
            root[find(a)] = find(b)
            if bits == 1:
                assert (a ^ b).bit_count() == 1
        want = {f: f for f in fps}
        for a in fps:  # brute force over all pairs, to a fixed point
            for _ in fps:
                for x in fps:
                    for y in fps:
                        if (x ^ y).bit_count() <= bits:
                            want[x] = want[y] = min(want[x], want[y])
        same = lambda g: sorted(sorted(x for x in fps if g(x) == g(y)) for y in fps)
        assert same(find) == same(want.get)
