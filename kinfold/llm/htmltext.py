"""Main text of web pages by nearest-URL page differencing.

A page is parsed to lines: one per block of text, with where it stands. Pages are sorted
by host and URL path, so a page's neighbours in that order share the longest path prefix
with it; its lines are aligned with those of each neighbour by longest common
subsequence, and lines they share are deleted as template. Structure decides what
differencing cannot: elements that are never prose (navigation, headers, footers, asides,
forms, scripts, styles, adverts, notices, comments) go even where neighbours differ in
them, and prose inside the article element stays even where a neighbour repeats it, since
copied articles and repeated passages are content. So inside an article only shared lines
that are nothing but links are deleted.

Words in class or id name subjects as well as page parts (``category-social-media``, a
heading's ``social-effects``). Inside an article or main element a mark therefore counts as
a whole class token or with words of page parts only (``share-buttons``); in any other
compound it is a doubt, and the lines go only where a neighbour shares them. Ids of headings
never count, those of sections only outside articles and whole, and nothing in its class
drops an article element.

A page may have several articles (or elements with a mark such as ``post`` or ``story``):
all that stand free are kept, and the largest, wherever it stands, with those of the same
surrounding element. Elements of which only a part of a class names an article, and
articles with a mark as class (cards, adverts), are kept only as the largest.

The order of (host, path, id) is cut into cells: a page whose key hashes to 0 modulo
``Settings.cell`` starts one. Neighbours are sought inside a cell, and partitions are runs of
whole cells, so a host with a third of all pages spans many tasks and yet no text depends on
the number of partitions. At the border of two cells a page has its two nearest neighbours
of its own side. Pages are parsed before they are dealt, so only their lines travel.

Edge cases: null or empty html gives an empty text; a page without article or main
element keeps what is neither structural nor shared; a neighbour with the very same lines
is a copy, not evidence of a template, and is passed over; tags that are never closed end
with their parent; a null url stands alone under an empty host; repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML whose content is never shown or never prose.
NEVER = frozenset("script style noscript template iframe object svg canvas head title nav footer aside form button select option textarea dialog menu datalist audio video map".split())
#: Elements of HTML without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of HTML that end a line.
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Chosen here: words in class, id or role that mark an element as not of the article.
MARKS = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar cookie cookies consent gdpr notice notification alert newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser comment comments commentlist disqus respond reply replies popup modal overlay pagination pager skip contentinfo complementary search dialog copyright disclaimer".split())
#: Chosen here: words that make a page part of a mark.
PARTS = frozenset("bar box button buttons container icons links list posts widget widgets wrapper".split())
#: Elements whose id is an anchor on prose.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Chosen here: words in class, id, role or itemprop that mark the article where there is no such element.
MAIN_MARKS = frozenset("article articlebody main post entry story".split())

_RAW = frozenset("script style textarea title noscript template iframe".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Line:
    text: str
    where: str  #: tags from the body down
    never: bool  #: inside an element that is not of the article
    article: int  #: number of the outermost article it stands in, 0 for none
    group: int  #: of that article: 0 stands free, above 0 in one dropped element, below 0 alone
    main: bool
    links_only: bool
    doubt: bool  #: inside an article, in an element that may be a page part by its class


@dataclass
class Marks:
    words: set[str]  #: tokens of class, id, role and itemprop and their parts
    tokens: set[str]  #: tokens of class, role and itemprop
    ids: set[str]  #: tokens of id
    hidden: bool


def _parts(value: str) -> set[str]:
    return {w.lower() for w in _PART.findall(value)}


def _marks(attributes: str) -> Marks:
    m = Marks(set(), set(), set(), False)
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop"):
            (m.ids if name == "id" else m.tokens).update(value.split())
            m.words |= _parts(value) | {w.lower() for w in value.split()}
        m.hidden |= name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and bool(re.search(r"display\s*:\s*none", value, re.I))
    return m


def _whole(tokens: set[str]) -> bool:
    """Whether a token is a mark, alone or with words of page parts only."""
    for w in tokens:
        words = {x for x in _parts(w) if len(x) > 1}
        if w.lower() in MARKS or words & MARKS and words <= MARKS | PARTS:
            return True
    return False


def _drops(tag: str, m: Marks, article: bool, inside: bool) -> tuple[bool, bool]:
    """Whether class, id and role mark an element as not of the article, and whether they only may."""
    if tag in ("html", "body", "main", "article") or not m.words & MARKS:
        return False, False
    own = {w.lower() for w in m.tokens}
    section = tag == "section" or "section" in own
    if inside or own & MAIN_MARKS:
        whole = _whole(m.tokens) or tag in ("div", "section", "ul", "ol") and not (section and article) and _whole(m.ids)
        return whole, not whole and tag not in HEADINGS and any(_parts(w) & MARKS for w in m.tokens)
    if tag in HEADINGS or section:
        return any(_parts(w) & MARKS or w.lower() in MARKS for w in m.tokens) or tag not in HEADINGS and _whole(m.ids), False
    return True, False


def parse(page: str | None) -> list[Line]:
    """The lines of a page, in order. White space inside a line is one blank; references are decoded."""
    lines: list[Line] = []
    if not page:
        return lines
    # tag, drops, opens an article (its number), opens a main region, is a link, is in doubt, what it suspends
    stack: list[tuple[str, bool, int, bool, bool, bool, tuple[int, int, int] | None]] = []
    drop, articles, mains, links, doubts, count = 0, [], 0, 0, 0, 0
    since, zone, group = 0, 0, {}  # where what drops began, the dropped element articles stand in, groups of articles
    text: list[str] = []
    linked, plain = False, False

    def end_line() -> None:
        nonlocal text, linked, plain
        if text:
            t = " ".join(_html.unescape("".join(text)).split())
            if t:
                lines.append(Line(t, "/".join(x[0] for x in stack if x[0] in BLOCK), drop > 0, articles[0] if articles else 0, group[articles[0]] if articles else 0, mains > 0, linked and not plain, doubts > 0))
        text, linked, plain = [], False, False

    def pop_to(i: int) -> None:
        nonlocal drop, mains, links, doubts, since, zone
        while len(stack) > i:
            _, d, a, m, l, u, held = stack.pop()
            doubts -= u
            drop -= d
            mains -= m
            links -= l
            if a:
                articles.pop()
            if held:
                drop, since, zone = drop + held[0], held[1], held[2]

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            piece = page[at:lt]
            text.append(piece)
            if not piece.isspace():
                linked, plain = linked or links > 0, plain or links == 0
            at = lt
            continue
        m = _TOKEN.match(page, at)
        if not m:  # a bare less-than sign
            text.append("<")
            at += 1
            continue
        at = m.end()
        if m[1] is not None:
            text.append(m[1])
            continue
        if m[3] is None:
            continue
        closing, tag, attributes = bool(m[2]), m[3].lower(), m[4] or ""
        if tag in BLOCK:
            end_line()
        elif tag in ("br", "td", "th"):
            text.append(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        if tag in BLOCK or tag == "p":
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in ("li", "tr", "dt", "dd", "option"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag or tag in ("dt", "dd") and stack[i][0] in ("dt", "dd"):
                    pop_to(i)
                    break
                if stack[i][0] in ("ul", "ol", "table", "dl", "div", "article", "main"):
                    break
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        marks = _marks(attributes) if attributes.strip() else Marks(set(), set(), set(), False)
        words, inside = marks.words, bool(articles) or mains > 0
        whole, held = _whole(marks.tokens), None
        if tag in ("article", "main") and drop and not whole and not (inside and words & MARKS):
            # An article never stands inside an advert or a menu: what is open there was not closed.
            if articles:
                for i, x in enumerate(stack):
                    if x[1]:
                        pop_to(i)
                        break
            else:
                held, zone, drop = (drop, since, zone), zone or since, 0
        marked, doubt = _drops(tag, marks, bool(articles), inside)
        if tag == "article" and articles:  # a reader's comment or a card
            marked = whole
        drops = tag in NEVER or marks.hidden or marked or tag == "header" and not inside
        opens = 0
        if not drops and not drop and (tag == "article" and not (whole and mains) or tag not in ("html", "body", "span", "a", "p", "article") and words & MAIN_MARKS and not words & {"header", "title", "meta"}):
            count += 1
            opens = count
            strong = not whole if tag == "article" else bool({w.lower() for w in marks.tokens} & MAIN_MARKS)
            group[opens] = zone if strong else -opens
        main = tag == "main" or "main" in words and tag in ("div", "section")
        stack.append((tag, drops, opens, main, tag == "a", doubt, held))
        if drops and not drop:
            since = at
        doubts += doubt
        drop += drops
        mains += main
        links += tag == "a"
        if opens:
            articles.append(opens)
    end_line()
    return lines


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Matches are walked in order of ``a`` while the best end in ``b`` of each length is kept,
    so the cost follows the number of equal pairs, not the product of the lengths.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = set(range(lo)) | set(range(len(a) - hi, len(a)))
    places: dict[int, list[int]] = {}
    for j in range(len(b) - hi - 1, lo - 1, -1):
        places.setdefault(b[j], []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i in range(lo, len(a) - hi):
        for j in places.get(a[i], ()):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def signature(lines: list[Line]) -> list[int]:
    """A number for each line, from its text and where it stands."""
    return [zlib.crc32(x.where.encode()) << 32 | zlib.crc32(x.text.encode("utf-8", "replace")) for x in lines]


def main_text(lines: list[Line], own: list[int], neighbours: list[list[int]]) -> str:
    """The lines that remain after differencing with the neighbours, joined by blank lines."""
    template: set[int] = set()
    for other in neighbours:
        if other != own:
            template |= shared_lines(own, other)
    size: dict[int, int] = {}
    for x in lines:
        if x.article and not x.never:
            size[x.article] = size.get(x.article, 0) + len(x.text)
    best = max(size, key=lambda n: (size[n], -n)) if size else 0
    kept_groups = {0} | {x.group for x in lines if x.article == best}
    has_main = not best and any(x.main and not x.never for x in lines)
    kept = []
    for i, x in enumerate(lines):
        if x.never:
            continue
        inside = x.article > 0 and x.group in kept_groups if best else x.main
        if best or has_main:
            if inside and not (i in template and (x.links_only or x.doubt)):
                kept.append(x.text)
        elif i not in template:
            kept.append(x.text)
    return "\n\n".join(kept)


#: A line without its text: never, article, group, main, links_only, doubt.
_MARK = np.dtype([("never", "?"), ("article", "<i4"), ("group", "<i4"), ("main", "?"), ("links_only", "?"), ("doubt", "?")])


def packed(lines: list[Line]) -> tuple[bytes, bytes, str]:
    """Signatures, marks, and the texts of lines that may be prose, one below the other."""
    marks = np.array([(x.never, x.article, x.group, x.main, x.links_only, x.doubt) for x in lines], _MARK)
    return np.array(signature(lines), "<u8").tobytes(), marks.tobytes(), "\n".join(x.text for x in lines if not x.never)


def unpacked(signatures: bytes, marks: bytes, texts: str) -> tuple[list[int], list[Line]]:
    prose = iter(texts.split("\n"))
    lines = [Line("" if m[0] else next(prose), "", *m) for m in np.frombuffer(marks, _MARK).tolist()]
    return np.frombuffer(signatures, "<u8").tolist(), lines


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, html with host, path and digest: the order of pages, whole even for pages of one key."""
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.withColumn("host", F.lower(F.regexp_extract(bare, "^(?:[^/@]*@)?([^/:?#]*)", 1)))
    return rows.withColumn("path", F.regexp_replace(F.regexp_extract(bare, "^[^/?#]*([^?#]*)", 1), "(?:/|\\.html?|\\.php)+$", ""))


@dataclass(frozen=True)
class Settings:
    cell: int = 256  #: pages of a cell, on average
    max_cells: int = 1 << 18
    partition_bytes: int = 64 << 20  #: of html


def _key(host: str, path: str, page_id: int | None) -> tuple[bytes, bytes, int]:
    return host.encode("utf-8", "replace"), path.encode("utf-8", "replace"), -(1 << 63) if page_id is None else page_id


def _bounds(rows: DataFrame, s: Settings, partitions: int | None) -> tuple[DataFrame, list[tuple[bytes, bytes, int]]]:
    """The rows with ``start`` (whether their key starts a cell), and the first key of each partition but the first.

    Bounds are starts, evenly chosen. The driver sees about ``max_cells`` starts at most: in a
    table with more pages a cell is longer, by the number of pages alone.
    """
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    cell = max(s.cell, 1 << (max(1, -(-n // s.max_cells)) - 1).bit_length())
    rows = rows.withColumn("start", F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(cell)) == 0)
    starts = sorted(_key(*r) for r in rows.where("start").select("host", "path", "page_id").distinct().collect())
    wanted = partitions or max(-(-size // s.partition_bytes), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    parts = max(1, min(wanted, len(starts) + 1))
    return rows, [starts[(i * (len(starts) + 1)) // parts - 1] for i in range(1, parts)]


def extract(pages: DataFrame, settings: Settings = Settings(), partitions: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page. ``partitions`` deals the work and changes no text."""
    rows, bounds = _bounds(keyed(pages), settings, partitions)
    held = rows.sparkSession.sparkContext.broadcast(bounds)  # at most about max_cells keys

    def lines_of(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for page_id, url, html, host, path, start in zip(*(b.column(c).to_pylist() for c in range(6))):
                at = bisect_right(held.value, _key(host, path, page_id))
                out.append((page_id, url, host, path, start, at, zlib.crc32((html or "").encode("utf-8", "replace")), *packed(parse(html))))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["page_id", "url", "host", "path", "start", "part", "digest", "signatures", "marks", "texts"])

    def run(batches):
        import pyarrow as pa

        # Five pages at a time: the page in the middle and two on each side.
        window, middle, out = [], 0, []

        def ready():
            place, host, own, lines = window[middle]
            near = sorted((j for j in range(len(window)) if j != middle and window[j][1] == host), key=lambda j: abs(j - middle))[:2]
            out.append((place, main_text(lines, own, [window[j][2] for j in near])))

        def pages_of():
            cell, before = 0, None
            for b in batches:
                for page_id, url, host, path, start, signatures, marks, texts in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "host", "path", "start", "signatures", "marks", "texts"))):
                    key = host, path, page_id
                    cell += start and key != before
                    before = key
                    yield (page_id, url), (host, cell), *unpacked(signatures, marks, texts)

        stream = pages_of()
        while True:
            while len(window) < middle + 3 and (x := next(stream, None)) is not None:
                window.append(x)
            if middle >= len(window):
                break
            ready()
            middle += 1
            if middle > 2:
                window.pop(0)
                middle -= 1
            if len(out) >= 500:
                yield _batch(pa, out)
                out.clear()
        if out:
            yield _batch(pa, out)

    schema = "page_id long, url string, host string, path string, start boolean, part int, digest long, signatures binary, marks binary, texts string"
    order = ["host", "path", "page_id", "digest"]
    dealt = rows.mapInArrow(lines_of, schema).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _batch(pa, rows):
    text = [t for _, t in rows]
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.int64()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])
