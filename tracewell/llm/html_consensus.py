"""Main text of web pages by host consensus.

1. One scan parses every page, scores its containers and votes for the best ones, as generalised paths of
   tags and classes (numbers and ids left out), per host.  Spark adds the votes of a host, on the map side
   first, so a host with a third of all pages is no single task.
2. Each host's winning paths, a few short strings, go to its pages: broadcast if Spark knows the table to
   be small, else joined.
   What scores best is widened first: where an article's text is spread over a lead and a body, only their
   common container holds all of it.
3. A second scan extracts from every page the elements at the winning path that it has; a page that has none
   uses its own best container.

What is never text: scripts, styles, forms and the like, elements that are by tag, role or class a menu,
header, footer, sidebar, notice, advert or comment section, and markup.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import saved

#: Votes per page, and winning paths per host.
VOTES, PATHS = 3, 5
#: A container with more than this share of link text in what it would add is a list of links, no wider article.
LINK_SHARE = 0.3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: What a class says an element has or lacks is not what it is.
_SAID = re.compile(r"(?<![A-Za-z0-9])(?:has|with|without|no)[-_][A-Za-z0-9]+", re.I)
_DIGITS = re.compile(r"\d+")

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = RAW | frozenset("head noscript template nav header footer aside form button select option datalist dialog menu svg math object canvas audio video map".split())
CONTAINERS = frozenset("body main article section div td".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that a start tag ends when they are open, and elements at which the search stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
KEEPS_PARAGRAPH = INLINE | frozenset("br wbr script style template noscript li dt dd tr td th tbody thead tfoot caption col colgroup option head body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Parts of class and id names.  The first are never text; the second only where no part of the third stands beside them.
ALWAYS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist disqus replies respond cookie cookies consent gdpr nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead related recommended recommendations share sharing social newsletter subscribe subscription pagination pager popup modal".split())
MAYBE = frozenset("header sidebar aside notice notices alert banner widget widgets toolbar topbar overlay login signup search form".split())
BODY = frozenset("content main article post entry story page wrapper wrap container layout body has with no".split())
GOOD = frozenset("content article post entry story main text body".split())


class _Element:
    __slots__ = ("tag", "path", "parent", "first", "last", "never", "good", "box", "link")

    def __init__(self, tag, path, parent, first, never, good, box, link=False):
        self.tag, self.path, self.parent, self.first, self.last, self.never, self.good, self.box, self.link = tag, path, parent, first, None, never, good, box, link


def _label(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """(generalised label, never text, looks like content) of a start tag."""
    never, good, label = tag in NEVER, tag in ("article", "main"), tag
    if attrs and "=" in attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                never |= value.strip().lower() in ROLES
                continue
            parts = {p.lower() for p in _PART.split(_SAID.sub(" ", value))}
            if tag not in ("html", "body", "article", "main"):
                never |= bool(parts & ALWAYS) or (bool(parts & MAYBE) and not parts & BODY)
            good |= bool(parts & GOOD)
            if name == "class":
                label += "".join(f".{_DIGITS.sub('N', c)}" for c in sorted(value.split())[:3])
    return label, never, good


def parse(page: str | None) -> tuple[list[_Element], list[str], list[int]]:
    """(elements that can hold text, pieces of text, whether a piece may count).  An element's pieces are those from ``first`` to ``last``."""
    page = page or ""
    pieces: list[str] = []
    counts: list[int] = []  # 0: never text, 1: text, 2: text of a link
    root = _Element("", "", None, 0, False, False, None)
    root.box = root
    elements, stack, at = [root], [root], 0

    def close(n: int) -> None:
        for e in stack[n:]:
            e.last = len(pieces)
        del stack[n:]

    def gap() -> None:
        pieces.append(" ")
        counts.append(int(not stack[-1].never))

    def find(tags, stops=frozenset()) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stops:
                return 0
        return 0

    while at < len(page):
        m = _TOKEN.search(page, at)
        start = m.start() if m else len(page)
        if start > at:
            pieces.append(page[at:start])
            counts.append(0 if stack[-1].never else 1 + stack[-1].link)
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag not in INLINE:
                gap()
            # an inline end tag closes nothing beyond the block it stands in
            if i := find((tag,), CONTAINERS if tag in INLINE else frozenset()):
                close(i)
            continue
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        if tag not in INLINE:
            gap()
            if tag not in KEEPS_PARAGRAPH and (i := find(("p",), CONTAINERS)):
                close(i)
            elif tag in CLOSES and (i := find(*CLOSES[tag])):
                close(i)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        up = stack[-1]
        label, never, good = _label(tag, attrs)
        e = _Element(tag, up.path, up, len(pieces), up.never or never, good, up.box, up.link or tag == "a")
        if tag not in INLINE and tag != "p":
            tail = up.path.rsplit("#", 1)[0].split(">")[-5:]
            e.path = f"{'>'.join([*tail, label])}#{hash_path(up.path, label)}"
        if tag in CONTAINERS and not e.never:
            e.box = e
            elements.append(e)
        stack.append(e)
        if tag not in INLINE:
            gap()
    close(0)
    return elements, pieces, counts


def hash_path(above: str, label: str) -> str:
    """Tells apart long paths, of which only the last labels are written out."""
    return f"{zlib.crc32(label.encode('utf-8', 'surrogatepass'), zlib.crc32(above.encode('utf-8', 'surrogatepass'))):08x}"


def text_of(spans: list[tuple[int, int]], pieces: list[str], counts: list[int]) -> str:
    return " ".join(html.unescape("".join(pieces[i] for a, b in spans for i in range(a, b) if counts[i])).split())


def scores(elements: list[_Element], pieces: list[str], counts: list[int]) -> list[tuple[float, _Element]]:
    """Containers by score, best first: text right below one counts whole, each level of containers further in by half; less by up to nine tenths for its share of link text."""
    own, links = {id(e): 0.0 for e in elements}, {id(e): 0.0 for e in elements}
    starts = sorted(elements, key=lambda e: e.first)
    open_, k = [], 0
    for i, piece in enumerate(pieces):
        while k < len(starts) and starts[k].first <= i:
            open_.append(starts[k])
            k += 1
        while open_ and open_[-1].last is not None and open_[-1].last <= i:
            open_.pop()
        if counts[i] and open_ and (n := len(piece.strip())):
            own[id(open_[-1])] += n
            links[id(open_[-1])] += n * (counts[i] == 2)
    total, whole = dict(own), dict(own)
    for e in reversed(starts):
        box = e.parent.box if e.parent is not None else None
        if box is not None and id(box) in total:
            total[id(box)] += total[id(e)] / 2
            whole[id(box)] += whole[id(e)]
            links[id(box)] += links[id(e)]
    found = [(total[id(e)] * (1 - 0.9 * links[id(e)] / whole[id(e)]) * (1.25 if e.good else 1.0), e) for e in elements if total[id(e)] > 0]
    return sorted(found, key=lambda x: (-x[0], x[1].first))


def best_text(page: str | None, paths: list[str] = ()) -> str:
    """The text at the first of ``paths`` that the page has with text, else of its own best container."""
    elements, pieces, counts = parse(page)
    for path in paths:
        spans, end = [], -1
        for e in elements:
            if e.path == path and e.first >= end:
                spans.append((e.first, e.last))
                end = e.last
        if spans and (text := text_of(spans, pieces, counts)):
            return text
    found = scores(elements, pieces, counts)
    if not found:
        return ""
    best = widened(found[0][1], pieces, counts)
    return text_of([(best.first, best.last)], pieces, counts)


def widened(e: _Element, pieces: list[str], counts: list[int]) -> _Element:
    """The widest container around ``e`` that looks like content and adds text, not links; an article is wide enough."""
    best, at = e, e
    while best.tag not in ("article", "main") and at.parent is not None:
        at = at.parent
        if at.box is not at or not at.good:
            continue
        size = [0, 0, 0]
        for i in (*range(at.first, best.first), *range(best.last, at.last)):
            size[counts[i]] += len(pieces[i].strip())
        if size[2] > LINK_SHARE * (size[1] + size[2]):
            break
        best = at
    return best


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def vote(pages: DataFrame) -> DataFrame:
    """(host, paths): each host's winning paths, best first.  Pages without a host do not vote."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, rows = batch.slice(k, 64), []
                for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    elements, pieces, counts = parse(page)
                    found = scores(elements, pieces, counts)[:VOTES]
                    whole = sum(s for s, _ in found)
                    rows += [(host, widened(e, pieces, counts).path, s / whole) for s, e in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.string(), pa.float64()))], ["host", "path", "weight"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> ''").mapInArrow(scan, "host string, path string, weight double")
    # whole thousandths: sums do not depend on the order of addition
    votes = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("weight") * 1000).cast("long")).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.col("weight").desc(), "path"))
    top = votes.withColumn("rank", rank).where(F.col("rank") <= PATHS)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html).

    A null or empty page has an empty text.  Pages without a host use their own best container.  Rows that
    repeat, and null ids, keep their rows; an empty table gives none.
    """
    won = saved(vote(pages), "paths")
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(won, "host", "left").drop("host")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = [best_text(page, paths or ()) for page, paths in zip(part.column("html").to_pylist(), part.column("paths").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return own.select(F.col("page_id").cast("long"), "url", "html", "paths").mapInArrow(scan, "page_id bigint, url string, text string, n_chars bigint")
