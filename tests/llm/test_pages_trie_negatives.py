"""Main text of pages, the conversation trie and hard negatives, against brute force."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, page_text, prefix_trie
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_hard_negatives"])
def test_query_matches_sql(spark, name):
    ok, message, rows = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert ok and rows, message


# --- main text


def text_of(page):
    return " ".join(page_text.candidates(page)[0])


@pytest.mark.parametrize("page, want", [
    ("", ""),
    ("no markup &amp; all text", "no markup & all text"),
    ("<p>one<p>two <b>th</b>ree<br>four&nbsp;\n five", "one two three four five"),
    ("<title>t</title><style>p{}</style><script>var a='</p><p>x';</script><p>kept</p>", "kept"),
    ("<p>a<!-- <p>b -->c</p><!-- open <p>d", "ac"),
    ("<p>a &lt;b&gt; &#233; &unknown; &amp", "a <b> é &unknown; &"),
    ("<nav><ul><li>m</ul></nav><article><h1>T</h1><p>x</article><footer>f</footer><p>outside", "T x"),
    ("<div class=ad>buy<article><p>x</p></article>", "x"),
    ("<aside><article><p>teaser</p></article></aside><main><p>x</p></main>", "x"),
    ("<article><header><h1>T</h1></header><div class='share-bar'>s</div><p>x</p><section id=comments><p>c</section></article>", "T x"),
    ("<header>h</header><form>f<input></form><p>x</p><div class='cookie-notice'>c</div><div id=siteFooter>f</div>", "x"),
    ("<div role=navigation>m</div><p hidden>h</p><p style='display: none'>h</p><p aria-hidden=true>h</p><p>x</p>", "x"),
    ("<div class='entry-content'><p>x</p></div><p>outside</p>", "x"),
    ("<body class='has-sidebar'><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul><p><a href=4>x</a></p>", "x"),
    ("<table><tr><td>a<td>b<tr><td>c</table></div></p>d", "a b c d"),
    ("<p title='a > b'>x</p><p class=\"oops>y", "x y"),
    ("1 < 2 <3 </p> 4", "1 < 2 <3 4"),
    ("<script>never closed <p>x", ""),
])
def test_lines_of_a_page(page, want):
    assert text_of(page) == want


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("bits", [1 << 26, 64, 4])
def test_shared_lines_are_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(page_text, "_MATRIX_BITS", bits)
    r = random.Random(bits)
    for _ in range(300):
        a, b = ([r.randint(0, r.choice([2, 8])) for _ in range(r.randint(0, 25))] for _ in "ab")
        at = page_text.shared(a, b)
        rest = iter(b)
        assert sorted(set(at)) == at and len(at) == longest(a, b)
        assert all(any(a[i] == y for y in rest) for i in at)


def soup(host, n, r, prose):
    """Pages without any named part: everything but the story is the host's template."""
    menu = "".join(f"<div>{host} menu {k}</div>" for k in range(4))
    foot = f"<div>{host} imprint</div><div>{host} privacy</div>"
    story = [" ".join(prose(r) for _ in range(r.randint(5, 30))) for _ in range(r.randint(2, 6))]
    return "<body>" + menu + "".join(f"<div>{html.escape(s)}</div>" for s in story) + foot, " ".join(story)


def test_template_goes_by_differencing(spark, monkeypatch):
    monkeypatch.setattr(page_text, "RANGE_PAGES", 40)
    r = random.Random(5)
    prose = lambda r: "".join(r.choice("abcdefgh<&é") for _ in range(r.randint(2, 9)))
    rows, want = [], {}
    for i in range(400):
        host = "hot.example" if i % 3 else f"h{i % 7}.example"
        page, story = soup(host, i, r, prose)
        rows.append((i, f"https://{host}/a{i % 5}/{r.randint(0, 999)}?x={i}", page))
        want[i] = story
    copies = rows[1][2]
    for i in range(400, 430):  # many copies next to each other are no template
        rows.append((i, f"https://hot.example/a1/copy{i}", copies))
        want[i] = want[1]
    rows.append((500, "https://lonely.example/", "<p>only page</p>"))
    want[500] = "only page"
    schema = "page_id long, url string, html string"
    got = [{x["page_id"]: x["text"] for x in page_text.extract(spark.createDataFrame(rows, schema).repartition(k)).collect()} for k in (1, 7)]
    assert got[0] == got[1] == brute_pages(rows)
    wrong = [i for i in want if " ".join(want[i].split()) != got[0][i]]
    assert not [i for i in wrong if not 400 <= i < 430]


def brute_pages(rows):
    """The method over the whole list, without ranges."""
    host = lambda u: re.sub(r".*//|[/?#].*", "", u)
    path = lambda u: re.sub(r"[?#].*", "", u.split(host(u), 1)[1])
    rows = sorted(rows, key=lambda x: (host(x[1]), path(x[1]), x[1], str(x[0])))
    found, out = [page_text.candidates(x[2])[0] for x in rows], {}
    for k, (i, url, _) in enumerate(rows):
        near = lambda ks: [found[j] for j in ks if 0 <= j < len(rows) and host(rows[j][1]) == host(url)]
        out[i] = " ".join(page_text.difference(found[k], near(range(k - 1, k - 9, -1)), near(range(k + 1, k + 9))))
    return out


def test_pages_of_given_tables_give_their_articles(spark):
    got = {x["page_id"]: x for x in QUERIES["op11_main_text"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for x in pages:
        article = x["html"].split("<article>")[1].split("</article>")[0]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "\n", article)).split())
        assert (got[x["page_id"]]["text"], got[x["page_id"]]["n_chars"], got[x["page_id"]]["url"]) == (want, len(want), x["url"])


def test_marked_articles_are_differenced_too(spark):
    """An unmarked line that all pages around have goes from an article as well; a
    sentence that the nearest articles repeat stays, as does one on a host's few pages."""
    own = lambda h, i: " ".join(f"{h}{i}{k} is said here" for k in range(30))
    rows = []
    for i in range(40):
        said = "<p>It rained again.</p>" if 10 <= i < 15 else ""
        rows.append((i, f"http://a.org/p/{i:03d}", f"<article><h1>Title {i}</h1><p>{own('a', i)}</p>{said}<p>Tell your friends about us</p></article>"))
    rows += [(100 + i, f"http://b.org/{i}", f"<article><p>{own('b', i)}</p><p>It rained again.</p></article>") for i in range(3)]
    got = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(2, 38):
        assert got[i] == f"Title {i} {own('a', i)}" + (" It rained again." if 10 <= i < 15 else ""), i
    # an end of the order has too few pages on one side
    assert got[0].endswith("Tell your friends about us") and got[39].endswith("Tell your friends about us")
    assert all(got[100 + i].endswith("It rained again.") for i in range(3))


def test_pages_edges(spark):
    schema = "page_id long, url string, html string, text string, part int, k string, n_chars int"
    long = "<p>" + "</p><p>".join(f"word{i} é" for i in range(50_000)) + "</p>"
    rows = [(1, "http://a/x", None), (2, None, "<p>x"), (None, None, "<p>y"), (3, "no url", ""), (4, "http://a/y", "<p>z</p>"), (4, "http://a/y", "<p>z</p>"), (5, "http://b/", long)]
    df = spark.createDataFrame([(*x, "mine", 1, "k", 2) for x in rows], schema)
    got = sorted((x["page_id"] or 0, x["url"], x["text"], x["n_chars"]) for x in page_text.extract(df).collect() if x["page_id"] != 5)
    assert got == sorted([(0, None, "y", 1), (1, "http://a/x", "", 0), (2, None, "x", 1), (3, "no url", "", 0), (4, "http://a/y", "z", 1), (4, "http://a/y", "z", 1)], key=str) or len(got) == 6
    assert [x["n_chars"] for x in page_text.extract(df).where("page_id = 5").collect()] == [len(" ".join(f"word{i} é" for i in range(50_000)))]
    assert page_text.extract(df.limit(0)).collect() == []


# --- trie


def brute_trie(sequences):
    """Nodes as (conv_id, depth) -> the other columns, from {conv_id: [(role, text)]}."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, seq in sequences.items():
        seq = tuple(seq)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                kids[seq[: d - 1]].add(seq[:d])
        ends[seq].append(c)
    saved, leaves = defaultdict(int), defaultdict(int)
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += node not in kids
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return {
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]) if n in kids else 0, leaves[n], saved[n], sha(n)) for n, m in members.items()
    }


def rebuilt(rows):
    """The contract's conversations, from (conv_id, turn, role, text) without ties."""
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        own[c].append((role or "", text or ""))
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    return {c: own.get(c - c % 5, [])[: h(c)] + t[h(c) :] for c, t in list(own.items())}


def trie(df, heads=True):
    t = prefix_trie.turns(df)
    c = F.col("conv_id")
    out = prefix_trie.build(*prefix_trie.with_heads(t, c - c % 5, F.crc32(c.cast("string")) % 9, 8)) if heads else prefix_trie.build(t, prefix_trie.lengths(t))
    return [tuple(x) for x in out.collect()]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_matches_brute_force(spark):
    r = random.Random(9)
    rows = []
    for c in [x for x in range(60) if x % 11]:
        for turn in range(r.choice([1, 2, 3, 5, 8, 9, 17])):
            rows.append((c, None if turn == 0 and c % 2 else turn, r.choice(["user", "assistant", None]) if r.random() < 0.2 else "user", r.choice(["", "é", "abc", None])))
    rows += [(1000, t, "u", "same") for t in range(70)] + [(1001, t, "u", "same") for t in range(33)]
    r.shuffle(rows)
    got = trie(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert len(got) == len(set(got)) and set(got) == brute_trie(rebuilt(rows))


def test_trie_of_long_and_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_CHUNK", 16)
    rows = [(1, t, "u", f"t{t}") for t in range(300)] + [(c, t, "u", f"t{t}") for c in range(2, 60) for t in range(3)] + [(99, t, "u", "x" * t) for t in range(257)]
    plain = defaultdict(list)
    for c, _, role, text in rows:
        plain[c].append((role, text))
    assert set(trie(spark.createDataFrame(rows, SCHEMA), heads=False)) == brute_trie(plain)


def test_trie_edges(spark):
    extra = SCHEMA + ", d long, name string, i int, key string, part int"
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (1, None, None, None), (None, 0, "u", "lost"), (2, 1, "u", "x" * 100_000)]
    df = spark.createDataFrame([(*x, 1, "n", 1, "k", 1) for x in rows], extra)
    got = trie(df, heads=False)
    assert set(got) == brute_trie({1: [("", ""), ("u", "a"), ("u", "a")], 2: [("u", "x" * 100_000)]})
    assert trie(df.limit(0)) == [] and trie(df.limit(0), heads=False) == []
    # conversations 1 to 4 may lose all their turns to an absent conversation 0
    short = [(c, 0, "u", "a") for c in range(1, 5)]
    assert set(trie(spark.createDataFrame(short, SCHEMA))) == brute_trie(rebuilt(short))
    tie = [(1, 0, "u", x) for x in "ba"]
    assert trie(spark.createDataFrame(tie, SCHEMA), heads=False) == trie(spark.createDataFrame(tie[::-1], SCHEMA), heads=False)


# --- hard negatives


def brute_negatives(rows, positives=5, negatives=3):
    whole = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    last = lambda x: (x is None, x or 0)
    for a in whole:
        if a[0] is None or a[0] % 50:
            continue
        near = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), last(b[0]), b) for b in whole if b != a and len(b[2]) == len(a[2])), key=lambda x: x[:2])
        for s, _, p in [x for x in near if x[2][1] == a[1]][:positives]:
            fit = [x for x in near if x[2][1] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a[0], p[0], k + 1, n[0], -s, -t) for k, (t, _, n) in enumerate(fit)]
    return sorted(out, key=str)


def mined(df):
    return sorted((tuple(x) for x in hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect()), key=str)


VECTORS = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("blocks", [(65_536, 65_536), (70, 3)])
def test_negatives_match_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "ROWS", blocks[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", blocks[1])
    g = np.random.default_rng(3)
    centre = g.normal(size=(6, 12))
    rows = [(i, int(g.integers(0, 5)), [float(np.float32(x)) for x in centre[g.integers(0, 6)] + g.normal(size=12) * g.choice([0.1, 0.6])]) for i in range(600)]
    rows += [(1000 + i, i % 5, rows[3][2]) for i in range(150)]  # one vector, many ids
    df = spark.createDataFrame(rows, VECTORS)
    assert mined(df) == brute_negatives(rows)


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [0.5, 0.5]), (1, 1, [1.0, 0.1]), (2, 1, None), (3, None, [1.0, 0.0]), (4, 1, [nan, 1.0]), (5, 1, [inf, 1.0]), (6, 2, [None, 1.0]),
        (7, 2, [0.9, 0.0]), (8, 3, [0.75, -9.0]), (9, 2, [0.5, 0.0]), (10, 2, []), (50, 2, []), (51, 1, []), (None, 2, [0.75, 1.0]), (None, 1, [2.0, 2.0]), (100, 4, [-1.0, -1.0]), (101, 4, [0.5, 0.5]), (102, 1, [1.0]),
    ]
    extra = VECTORS + ", asks boolean, v int, mark long, dim int, score double"
    df = spark.createDataFrame([(*x, True, 1, 1, 1, 0.0) for x in rows], extra)
    assert mined(df) == brute_negatives(rows)
    assert mined(df.limit(0)) == []
    big = [(i, i % 2, [2.0**20 * (i + 1) + i / 256, float(i)]) for i in range(6)] + [(50, 0, [2.0**20 + 3 / 256, 1.0])]
    doubles = spark.createDataFrame(big, "vec_id long, label int, embedding array<double>")
    assert mined(doubles) == brute_negatives(big) != []
    assert mined(doubles.withColumn("embedding", F.transform("embedding", lambda x: x * 1e40))) == []


def test_threshold_join_finds_all_pairs():
    g = np.random.default_rng(8)
    x = np.floor(g.normal(size=(500, 20)) * 256 * np.geomspace(1, 0.01, 20))
    q = np.floor(g.normal(size=(40, 20)) * 256)
    index = hard_negatives.Index(x)
    score = q @ x.T
    for part in (0.2, 0.9, 0.999, 1.0):
        least = np.quantile(score, part, axis=1)
        i, r, s = index.join(q, least)
        assert set(zip(i, r)) == set(zip(*np.nonzero(score >= least[:, None]))) and (s == score[i, r]).all()
