"""Main text of web pages by differencing pages with neighbouring URLs.

Pages of a host are ordered by URL path.  A page's lines are aligned with its
nearest neighbour's by longest common subsequence, and lines that both have
are template text and deleted.  What the markup itself names is not left to
chance: navigation, forms, scripts, adverts and the like are deleted although
no neighbour has the same words, and the blocks of an ``article`` or ``main``
element are kept although a neighbour has them too, since articles are
copied and quoted under neighbouring URLs.  A neighbour that shares most of a
page's lines is a copy and tells nothing about templates.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded_batches

MAIN, OTHER, TEMPLATE = 0, 1, 2
#: A neighbour with over this share of a page's undecided lines is a copy.
COPY = 0.8
#: Pairs of equal lines for each line up to which alignment goes by pairs; beyond it by rows.
MANY = 20

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_UNCLOSED = re.compile(r"<[!?]")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend optgroup option".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never part of the article.
_OUT = set("head nav footer aside form script style template noscript iframe svg math canvas object audio video button select textarea menu dialog datalist title map".split())
_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
#: Words of class and id that name template parts.
_NAMES = set(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs masthead header footer sidebar sidebars aside "
    "notice notices cookie cookies consent gdpr banner alert alerts warning announcement ad ads adv advert adverts advertisement "
    "advertisements advertising adsense adslot sponsor sponsors sponsored promo promos promotion promoted newsletter subscribe "
    "subscription signup login form forms search social share sharing sharebar related recommended recommendations popular trending "
    "widget widgets popup modal overlay toolbar pagination pager comment comments commentlist reply replies disqus respond copyright "
    "skip skiplink hidden paywall teaser toc".split()
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def _is_template(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("html", "body", "article", "main"):
        return False
    if tag in _OUT or attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return any(w.lower() in _NAMES for w in _PARTS.findall(names))


def _is_main(tag: str, attributes: dict[str, str]) -> bool:
    return tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or "articlebody" in attributes.get("itemprop", "").lower()


def lines(html: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in order: (text, MAIN, OTHER or TEMPLATE).

    Text is decoded, white space is one space, empty blocks are left out.
    Null and empty pages have none.  Unclosed elements end with an enclosing
    one; an ``article`` or ``main`` that opens inside a template part ends it.
    """
    html = html or ""
    found: list[tuple[str, int]] = []
    piece: list[str] = []
    stack: list[Open] = []
    count: dict[str, int] = {}
    kind = OTHER

    def flush() -> None:
        if piece:
            if text := " ".join(unescape("".join(piece)).split()):
                found.append((text, kind))
            piece.clear()

    def turn() -> None:
        """What is open has changed: text so far belongs to what was open before."""
        nonlocal kind
        now = stack[-1].kinds[0] if stack else OTHER
        if now != kind:
            flush()
            kind = now

    def cut(upto: int) -> None:
        for x in stack[upto:]:
            count[x.tag] -= 1
        del stack[upto:]

    def put(tag: str, template: bool, main: bool, head: bool) -> None:
        stack.append(_opened(stack[-1] if stack else None, len(stack), tag, template, main, head))
        count[tag] = count.get(tag, 0) + 1

    # behind the last ">" no tag ends: all is text, up to a comment or declaration that is not closed
    last = html.rfind(">") + 1
    rest = html[last:]
    at = 0
    for m in _MARKUP.finditer(html, 0, last):
        if m.start() < at:
            continue
        if m.start() > at:
            piece.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if (m[0].startswith("<!--") and not m[0].endswith("-->")) or (m[0].startswith("<![CDATA[") and not m[0].endswith("]]>")):
                rest = ""
            continue
        closing, text = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _BLOCK or tag in _OUT:
            flush()
        elif tag == "br":
            piece.append(" ")
        if closing:
            if count.get(tag):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                cut(i)
                turn()
            continue
        if tag in _VOID or (text.endswith("/") and tag not in _BLOCK):
            continue
        if tag in _RAW or tag in ("noscript", "template", "svg"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        attributes = _attributes(text)
        main = _is_main(tag, attributes)
        if main and stack and stack[-1].templates and tag in ("article", "main") and not stack[-1].aside:
            while stack and stack[-1].templates:
                cut(len(stack) - 1)
        if tag == "body":
            kept = count.get("html", 0)
            cut(0)
            for _ in range(kept):
                put("html", False, False, False)
        if (tag == "p" or (tag == "li" and stack and stack[-1].tag == "li")) and stack:
            # a paragraph ends an open one
            i = stack[-1].block
            if i >= 0 and stack[i].tag == tag:
                cut(i)
        inside = bool(stack) and stack[-1].inside
        header = tag == "header" or ("header" in attributes.get("class", "").lower() and inside)
        template = _is_template(tag, attributes) or (tag == "header" and not inside)
        if inside and (tag in _HEADINGS or header):
            template = False
        put(tag, template, main, header and inside and tag not in _HEADINGS)
        turn()
    if at < last:
        piece.append(html[at:last])
    if at <= last:
        opened = _UNCLOSED.search(rest)
        piece.append(rest[: opened.start()] if opened else rest)
    flush()
    return found


class Open(NamedTuple):
    """An open element, with what it and those around it say of the text inside."""

    tag: str
    templates: int  # template parts so far
    aside: bool  # whether one is an aside, nav or footer
    inside: bool  # within a main part
    block: int  # place of the innermost block element
    kinds: tuple[int, int]  # kind of the text, and of the text of a heading


def _opened(around: Open | None, place: int, tag: str, template: bool, main: bool, head: bool) -> Open:
    templates, kinds = (around.templates if around else 0) + template, []
    for heading in (False, True):
        heading |= tag in _HEADINGS
        if template or (head and not heading):
            kinds.append(TEMPLATE)
        elif main:
            kinds.append(MAIN if not templates else TEMPLATE)
        else:
            kinds.append(around.kinds[heading] if around else OTHER)
    aside = bool(around and around.aside) or tag in ("aside", "nav", "footer")
    return Open(tag, templates, aside, main or bool(around and around.inside), place if tag in _BLOCK else around.block if around else -1, tuple(kinds))


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence of two lists."""
    start, most = 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    own, theirs = Counter(x), Counter(y)
    few = sum(n * theirs[k] for k, n in own.items()) <= MANY * (len(x) + len(y))
    return [*range(start), *(start + i for i in (_by_matches(x, y) if few else _by_rows(x, y))), *range(len(a) - end, len(a))]


def _by_rows(a: list[int], b: list[int]) -> list[int]:
    """The same for lists with many equal lines: a row of the table is the bits of one whole number.

    A bit of a row is 0 where the length grows from one column to the next.
    Every so many rows are kept and those between worked out again on the way back.
    """
    full = (1 << len(b)) - 1
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j

    def below(row: int, x: int) -> int:
        hit = row & where.get(x, 0)
        return ((row + hit) | (row - hit)) & full

    step = max(1, int(len(a) ** 0.5))
    row, kept = full, [full]
    for i, x in enumerate(a):
        row = below(row, x)
        if (i + 1) % step == 0:
            kept.append(row)
    out, j = [], len(b)
    for k in range(len(kept) - 1, -1, -1):
        rows = [kept[k]]
        for x in a[k * step : (k + 1) * step]:
            rows.append(below(rows[-1], x))
        i = len(rows) - 1
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append(k * step + i)
    return out[::-1]


def _by_matches(a: list[int], b: list[int]) -> list[int]:
    """The same over all pairs of equal lines (Hunt and Szymanski)."""
    where: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    tails: list[int] = []
    links: list[tuple[int, int]] = []
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            k = bisect_left(ends, j)
            links.append((i, tails[k - 1] if k else -1))
            if k == len(ends):
                ends.append(j)
                tails.append(len(links) - 1)
            elif j < ends[k]:
                ends[k], tails[k] = j, len(links) - 1
    at, out = tails[-1] if tails else -1, []
    while at >= 0:
        out.append(links[at][0])
        at = links[at][1]
    return out[::-1]


def line_hash(text: str, kind: int) -> int:
    """A signed 32-bit hash of a line."""
    import xxhash

    return xxhash.xxh32_intdigest(text.encode(), kind) - (1 << 31)


def shared_lines(kinds: list[int], own: list[int], neighbours: list[list[int]]) -> set[int]:
    """Places of the lines that the first neighbour has too that is not a copy; lines are given by their hashes."""
    open_lines = [i for i, k in enumerate(kinds) if k == OTHER]
    for other in neighbours:
        same = set(common(own, other))
        if len(same.intersection(open_lines)) <= COPY * len(open_lines):
            return same
    return set()


def difference(page: list[tuple[str, int]], neighbours: list[list[tuple[str, int]]]) -> str:
    """The text of a page without template lines, its neighbours being given nearest first."""
    kinds, hashes = [k for _, k in page], lambda p: [line_hash(*x) for x in p]
    shared = shared_lines(kinds, hashes(page), [hashes(n) for n in neighbours])
    return "\n".join(t for i, (t, k) in enumerate(page) if stays(i, k, MAIN in kinds, shared))


def stays(place: int, kind: int, article: bool, shared: set[int]) -> bool:
    return kind == MAIN or (kind == OTHER and not article and place not in shared)


def parsed(html: Column) -> Column:
    """Blocks of pages; the text is left out of those that are not part of the result whatever the neighbours are."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int32()), ("hash", pa.int32())]))

    def blocks(page: str | None) -> list[dict]:
        found = lines(page)
        article = any(k == MAIN for _, k in found)
        return [{"text": t if stays(-1, k, article, set()) else None, "kind": k, "hash": line_hash(t, k)} for t, k in found]

    @arrow_udf("array<struct<text:string,kind:int,hash:int>>")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array([blocks(p.as_py()) for p in pages], kind)

    return of(html)


def hashed(html: Column) -> Column:
    """Line hashes of pages."""

    @arrow_udf("array<int>")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array([[line_hash(*x) for x in lines(p.as_py())] for p in pages], pa.list_(pa.int32()))

    return of(html)


def with_neighbours(rows: DataFrame, parts: int) -> DataFrame:
    """(host, path, before, after): line hashes of the previous and next path of the same host.

    Pages are dealt into ranges of (host, path), so a host may have any share
    of them; the ends of a range meet the next range's through a table with
    two rows per range.
    """
    order = ["host", "path"]
    dealt = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    w = W.partitionBy("part").orderBy(*order)
    page = F.struct("host", "path", "hashes")
    near = dealt.select("*", F.lag(page).over(w).alias("before"), F.lead(page).over(w).alias("after"))
    # one row per range at most
    ring = W.orderBy("part")
    ends = near.where("before is null or after is null")
    edge = ends.groupBy("part").agg(F.max_by(page, F.when(F.col("after").isNull(), 1).otherwise(0)).alias("tail"), F.max_by(page, F.when(F.col("before").isNull(), 1).otherwise(0)).alias("head"))
    edge = edge.select(F.col("part").alias("p"), F.lag("tail").over(ring).alias("left"), F.lead("head").over(ring).alias("right"))
    joined = near.join(F.broadcast(edge), F.col("part") == F.col("p"), "left")
    joined = joined.withColumn("before", F.coalesce("before", "left")).withColumn("after", F.coalesce("after", "right"))
    of = lambda c: F.when(F.col(f"{c}.host").eqNullSafe(F.col("host")), F.col(c))
    slim = lambda c: F.when(of(c).isNotNull(), F.struct(F.col(f"{c}.path").alias("path"), F.col(f"{c}.hashes").alias("hashes")))
    return joined.select("host", "path", slim("before").alias("before"), slim("after").alias("after"))


def _shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def extract(df: DataFrame, url: str = "url", html: str = "html", parts: int | None = None) -> DataFrame:
    """Add ``text``: the main text of every page, blocks joined by line ends.

    Null and empty pages give an empty text; pages without a URL have no
    neighbours.  Repeated rows give the same text.  Only line hashes are dealt
    by URL; pages are joined with their neighbours' hashes once.
    """
    bounded_batches(df.sparkSession)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    link = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    # copies of a page under one path are not each other's neighbours: one stands for the path
    first = F.min_by("hashes", F.xxhash64("hashes"))
    light = df.select(host.alias("host"), path.alias("path"), hashed(F.col(html)).alias("hashes")).groupBy("host", "path").agg(first.alias("hashes"))
    near = with_neighbours(light, parts).select(F.xxhash64("host", "path").alias("_k"), F.col("path").alias("_path"), "before", "after")
    kept = [c for c in df.columns if c not in (html, "text")]
    rows = df.select(*kept, F.xxhash64(host, path).alias("_key"), parsed(F.col(html)).alias("_lines"))

    @arrow_udf("string")
    def text(pages: pa.Array, paths: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
        out = []
        for page, p, b, a in zip(pages, paths, before, after):
            page = page.as_py() or []
            near = sorted((x for x in (b.as_py(), a.as_py()) if x), key=lambda x: -_shared_prefix(x["path"], p.as_py() or ""))
            kinds = [x["kind"] for x in page]
            shared = shared_lines(kinds, [x["hash"] for x in page], [x["hashes"] for x in near])
            out.append("\n".join(x["text"] for i, x in enumerate(page) if stays(i, x["kind"], MAIN in kinds, shared)))
        return pa.array(out, pa.string())

    joined = rows.join(near, F.col("_key") == F.col("_k"), "left")
    return joined.select(*kept, text("_lines", "_path", "before", "after").alias("text"))
