"""Main text of web pages by differencing a page against the pages nearest by URL.

A page becomes lines: one per block of markup, without script, style and other hidden
matter, and without blocks that their markup names as menus, headers, footers,
sidebars, notices, adverts, forms or comments. Where the page marks its article, lines
outside of it go too. Pages of a host are then ordered by path; each is aligned with
the nearest ones before and after it by longest common subsequence, and lines that it
shares with most of them are template and are deleted; inside a marked article only if
most of all the pages looked at, on either side, have them too.

The order is cut into ranges by the urls themselves, so that a host with a third of all
pages lies in many tasks. The few pages next to a cut go to both sides, and a range is
read as a stream that holds a few pages at a time.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import column, small_batches

#: Pages looked at on each side, pages compared on each side, and the share of text from
#: which two pages are copies of each other, which say nothing about the template.
LOOK, COMPARED, COPY = 8, 2, 0.9
#: Pages in a range of the order, and ranges at most: their first urls are sent to every task.
RANGE_PAGES, MAX_RANGES, _PER_RANGE = 1500, 65_536, 4

# Elements by what they do in a page.
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_BLOCK = _CLOSES_P | frozenset("body br caption dd dt head html legend li optgroup option select tbody td tfoot th thead tr button noscript template".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption".split())
_SCOPE = frozenset("table td th caption template object html".split())
#: An opening tag ends an open element of its kind, unless one of the second set lies between.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    **{t: (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
}
_APART = frozenset("nav aside footer form button select datalist dialog template noscript svg math object canvas audio video map menu".split())
_APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner menu submenu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside rail header masthead topbar footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login search share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond discussion pager pagination toolbar widget "
    "widgets copyright disclaimer".split()
)
_APART_STARTS = ("advert", "sidebar", "cookie", "comment", "newsletter", "breadcrumb", "navbar", "footer", "sponsor")
_TEXT_WORDS = frozenset("article articlebody post entry story content maincontent main".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


def _reading(name: str, raw: str, rank: int) -> tuple[bool, int]:
    """(is apart from the main text, how surely it is the article) of an opening tag:
    3 an article, 2 the main part, 1 named like one, 0 unknown."""
    apart = name in _APART or (name == "header" and rank < 2)
    own = 3 if name == "article" else 2 if name == "main" else 0
    if not raw or raw.isspace():
        return apart, own
    at = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(raw)}
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(at.get("style", "")):
        apart = True
    role = at.get("role", "").lower()
    own = max(own, {"main": 2, "article": 3}.get(role, 0), 3 if at.get("itemprop", "").lower() == "articlebody" else 0)
    if name in ("html", "body"):
        return False, 0
    named = [w.lower() for w in _WORDS.findall(f"{at.get('class', '')} {at.get('id', '')}")]
    text = not _TEXT_WORDS.isdisjoint(named)
    # an article's own head holds its title
    outside = [w for w in named if (w in _APART_WORDS or w.startswith(_APART_STARTS)) and not (w == "header" and (text or rank >= 1))]
    if own < 2:
        apart = apart or role in _APART_ROLES or bool(outside)
        own = max(own, int(text and not outside))
    return apart, own


def lines(page: str) -> list[tuple[int, bool, str]]:
    """(rank, is one link, text) of each block that is not apart from the main text.

    Markup may be broken: unclosed paragraphs, items and cells end where HTML ends them,
    stray end tags are ignored, an unclosed script or comment reaches to the end. Text
    has its references decoded and white space turned into single blanks."""
    out: list[tuple[int, bool, str]] = []
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # (element, apart, rank)
    piece: list[str] = []
    rank, linked, plain, links, seen_article, prose = 0, False, False, 0, False, False

    def flush() -> None:
        nonlocal piece, plain, linked, rank
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                out.append((rank, linked and not plain, text))
            piece, plain, linked = [], False, False
        rank = 0

    def close(names, walls) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return True
            if stack[k][0] in walls:
                return False
        return False

    def take(text: str) -> None:
        nonlocal rank, plain, linked
        if not text or stack[-1][1]:
            return
        if "&" in text:
            text = entities.unescape(text)
        if not text.isspace():
            rank = max(rank, stack[-1][2])
            if links and not prose:
                linked = True
            else:
                plain = True
        piece.append(text)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        end, name, raw = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if end:
            if name == "a":
                links = 0
            if name in _BLOCK:
                flush()
                close((name,), _SCOPE - {name} if name != "li" else _SCOPE | {"ul", "ol", "menu"})
            else:
                close((name,), _BLOCK)
            continue
        if name in _RAW:
            if not raw.endswith("/") or name not in ("iframe", "title"):
                stop = re.compile(f"</{name}[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else n
            continue
        if name in _BLOCK:
            flush()
            prose = name in _PROSE
            if name in _CLOSES_P:
                close(("p",), _SCOPE | {"button"})
            if name in _ENDS:
                close(*_ENDS[name])
            if name[0] == "h" and name[1:].isdigit() and stack[-1][0][:1] == "h" and stack[-1][0][1:].isdigit():
                stack.pop()
        if name in _VOID:
            continue
        if name == "a":
            links = 1
        _, outer, held = stack[-1]
        apart, own = _reading(name, raw, held)
        if own == 3 and not apart and not seen_article:
            # a box before the article that was never closed does not swallow it
            outer = outer and any(s[0] in _APART for s in stack)
            seen_article = True
        if raw.endswith("/") and name in ("svg", "math", "path", "use", "g"):
            continue
        stack.append((name, outer or apart, max(held, own)))
    flush()
    return out


def candidates(page: str) -> tuple[list[str], bool]:
    """The lines that can be main text, those of the surest mark that has any, and whether
    that is a mark of an article. Without a mark, three or more lines in a row that are
    nothing but a link are a menu."""
    found = lines(page)
    best = max((r for r, _, _ in found), default=0)
    if best:
        return [t for r, _, t in found if r == best], best == 3
    out: list[str] = []
    run: list[str] = []
    for _, link, text in [*found, (0, False, "")]:
        if link:
            run.append(text)
            continue
        if len(run) < 3:
            out += run
        run = []
        if text:
            out.append(text)
    return out, False


_MATRIX_BITS = 1 << 26


def shared(a: Sequence, b: Sequence) -> list[int]:
    """The places in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Rows of the table of lengths are kept as the bits of one number; where the table
    would take over 8 MB, ``b`` is halved and ``a`` cut where the halves' lengths are
    largest together, so any length is taken in bounded memory."""
    in_b = set(b)
    mine = [i for i, x in enumerate(a) if x in in_b]
    if not mine:
        return []
    in_a = {a[i] for i in mine}
    return [mine[i] for i in _lcs([a[i] for i in mine], [x for x in b if x in in_a])]


def _rows(a: list, b: list, keep: bool) -> list[int]:
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    v, out = every, []
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & every
        if keep:
            out.append(v)
    return out if keep else [v]


def _lcs(a: list, b: list) -> list[int]:
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    head, a, b = list(range(lead)), a[lead:], b[lead:]
    if not a or not b:
        return head
    if len(a) * len(b) <= _MATRIX_BITS or len(b) == 1:
        rows = _rows(a, b, True)
        i, j, back = len(a), len(b), []
        while i and j:
            if rows[j - 1] >> (i - 1) & 1:
                i -= 1
            elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
                j -= 1
            else:
                i, j = i - 1, j - 1
                back.append(i)
        return head + [lead + i for i in reversed(back)]
    half = len(b) // 2
    up = _zeros(_rows(a, b[:half], False)[0], len(a))
    down = _zeros(_rows(a[::-1], b[half:][::-1], False)[0], len(a))
    cut = max(range(len(a) + 1), key=lambda i: up[i] + down[len(a) - i])
    left = _lcs(a[:cut], b[:half])
    return head + [lead + i for i in left] + [lead + cut + i for i in _lcs(a[cut:], b[half:])]


def _zeros(v: int, n: int) -> list[int]:
    """Zeros among the lowest 0, 1, ... n bits."""
    out = [0]
    for c in reversed(bin(v)[2:].zfill(n)):
        out.append(out[-1] + (c == "0"))
    return out


def difference(page: list[str], before: Sequence[list[str]], after: Sequence[list[str]], compared: int = COMPARED, copy: float = COPY, sure: bool = False) -> list[str]:
    """The lines of a page that it does not share with most of the nearest other pages.

    ``before`` and ``after`` come nearest first. Of each side the first ``compared``
    pages count that are no copies: of two copies each shares ``copy`` of its characters
    with the other. Without a page to compare with, all lines stay.

    Where the lines are those of a marked article (``sure``), articles near each other
    may repeat a sentence: a line shared with most of the nearest pages goes if most of
    all the pages given have it too, on either side, of at least ``compared`` each."""
    if not sum(map(len, page)):
        return page
    near = [_votes(page, side, compared, copy) for side in (before, after)]
    votes, pages = [x + y for x, y in zip(near[0][0], near[1][0])], near[0][1] + near[1][1]
    gone = [2 * v > pages > 0 for v in votes]
    if sure and any(gone):
        for side in (before, after):
            votes, pages = _votes(page, side, len(side), copy)
            gone = [g and 2 * v > pages >= compared for g, v in zip(gone, votes)]
    return [x for x, g in zip(page, gone) if not g]


def _votes(page: list[str], side: Sequence[list[str]], compared: int, copy: float) -> tuple[list[int], int]:
    """With how many of the first ``compared`` pages that are no copies each line is
    shared, and how many these are."""
    total, votes, used = sum(map(len, page)), [0] * len(page), 0
    for other in side:
        if used == compared:
            break
        if not other:
            continue
        at = shared(page, other)
        same = sum(len(page[i]) for i in at)
        if same >= copy * total and same >= copy * sum(map(len, other)):
            continue
        used += 1
        for i in at:
            votes[i] += 1
    return votes, used


def _sort_key(url: Column, page_id: Column) -> Column:
    """Host, path, whole url and id: pages of a host lie side by side in order of path."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract(text, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", k)
    host = F.regexp_replace(F.lower(part(1)), r"^.*@|:\d*$", "")
    return F.concat_ws("\u0000", host, part(2), text, F.coalesce(page_id.cast("string"), F.lit("")))


def _ranges(keys: DataFrame) -> tuple[list[str], dict[int, tuple[str, str]]]:
    """(first keys of all ranges but the first, range -> (key of its LOOK-th page, key of
    its LOOK-th page from the end)). The cuts depend on the keys alone, not on partitions."""
    n = keys.count()
    ranges = min(MAX_RANGES, -(-n // RANGE_PAGES))
    if ranges < 2:
        return [], {}
    every = max(1, n // (_PER_RANGE * ranges))
    some = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).distinct().limit(2 * _PER_RANGE * ranges).collect())
    cuts = some[_PER_RANGE::_PER_RANGE]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("k")
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(cuts, x) for x in k.to_pylist()], pa.int32()), k], ["part", "k"])

    placed = keys.mapInArrow(place, "part int, k string")
    near = lambda order: F.row_number().over(W.partitionBy("part").orderBy(order))
    first = placed.withColumn("nth", near(F.col("k").asc())).where(F.col("nth") <= LOOK).groupBy("part").agg(F.max("k").alias("first"))
    last = placed.withColumn("nth", near(F.col("k").desc())).where(F.col("nth") <= LOOK).groupBy("part").agg(F.min("k").alias("last"))
    return cuts, {r["part"]: (r["first"], r["last"]) for r in first.join(last, "part").collect()}


_DEALT = "part int, own boolean, k string, page_id long, url string, sure boolean, lines array<string>"


def _deal(cuts: list[str], ends: dict[int, tuple[str, str]]):
    """Pages as lines, dealt to their range; those next to a cut also to the range beyond."""
    schema = pa.schema([("part", pa.int32()), ("own", pa.bool_()), ("k", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("sure", pa.bool_()), ("lines", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, page_id, url, page in zip(*(b.column(c).to_pylist() for c in ("k", "page_id", "url", "html"))):
                found, sure = candidates(page or "")
                at = bisect_right(cuts, k)
                rows.append((at, True, k, page_id, url, sure, found))
                first, last = ends.get(at, ("", ""))
                if at > 0 and k <= first:
                    rows.append((at - 1, False, k, page_id, None, sure, found))
                if at < len(cuts) and k >= last:
                    rows.append((at + 1, False, k, page_id, None, sure, found))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each own page of a range differenced against its neighbours of the same host. Rows come in order and LOOK of them are held each way."""
    held: deque[dict] = deque()  # the pages before, the page in turn, the pages after
    turn = 0  # where in ``held`` the page in turn is

    def texts(rows: list[dict], at: int) -> dict:
        row = rows[at]
        host = row["k"].partition("\0")[0]
        near = lambda places: [rows[i]["lines"] for i in places if rows[i]["k"].partition("\0")[0] == host]
        kept = difference(row["lines"], near(range(at - 1, max(at - 1 - LOOK, -1), -1)), near(range(at + 1, min(at + 1 + LOOK, len(rows)))), sure=row["sure"])
        text = " ".join(kept)
        return {"page_id": row["page_id"], "url": row["url"], "text": text, "n_chars": len(text)}

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def step(last: bool) -> list[dict]:
        """What can be told: a page with LOOK pages after it, or all that is left."""
        nonlocal turn
        out = []
        while turn < len(held) and (last or len(held) - turn > LOOK):
            if held[turn]["own"]:
                out.append(texts(held, turn))
            turn += 1
            while turn > LOOK:
                held.popleft()
                turn -= 1
        if last:
            held.clear()
            turn = 0
        return out

    for b in batches:
        done = []
        for row in b.to_pylist():
            if held and held[-1]["part"] != row["part"]:
                done += step(True)
            held.append(row)
            done += step(False)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if held and (done := step(True)):
        yield pa.RecordBatch.from_pylist(done, schema)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page, its blocks in order
    joined by one blank, and its code points.

    Every row of ``pages`` gives a row, repeated rows and rows with a null id or url too
    (pages without a host are neighbours of each other). Null or empty html, or a page
    without main text, gives an empty text. Long pages are taken whole, a page is held
    in one task. Pages of one url are ordered by id, then by their lines. A page whose
    host has no other page keeps all lines that its own markup does not rule out. An
    empty table gives no rows.
    """
    small_batches(pages)
    page_id, url = column(id_col).cast("long"), column(url_col).cast("string")
    rows = pages.select(page_id.alias("page_id"), url.alias("url"), column(html_col).cast("string").alias("html"), _sort_key(url, page_id).alias("k"))
    cuts, ends = _ranges(rows.select("k"))
    dealt = rows.mapInArrow(_deal(cuts, ends), _DEALT)
    ordered = dealt.repartition("part").sortWithinPartitions("part", "k", "lines", "own")
    return ordered.mapInArrow(_compare, "page_id long, url string, text string, n_chars long")
