"""Main text of web pages, by differencing with the nearest page of the host.

Pages are sorted by host and URL path. Each is aligned, line by line, with the
neighbour whose path is nearer; lines of the longest common subsequence are
boilerplate and go, unless they are an article's own paragraphs, which copies of
an article share. What boilerplate differs from page to page is known by its
markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.llm import texts

# Elements of HTML by their role here, and words of class names, ids and roles.
RAW = "script style noscript template iframe svg canvas object math textarea select xmp noembed noframes".split()
SKIPPED = set("head title nav header footer aside form button dialog menu fieldset".split())
BLOCKS = set(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {  # an opening tag ends these open elements
    **{t: {"p"} for t in BLOCKS},
    "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
SCOPES = {"article", "aside", "div", "section", "main", "nav", "header", "footer", "form", "table", "ul", "ol", "dl", "body"}
PROSE = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BOILERPLATE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer "
    "copyright comment comments commentlist reply replies disqus respond share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login toolbar pagination pager widget complementary contentinfo search dialog".split()
)

INSIDE = r"(?:\"[^\"]*+\"|'[^']*+'|[^>])*+"  # of a tag; one that does not end goes on to the page's end
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){INSIDE}>.*?(?:</(?P=raw)\s*+>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>{INSIDE})(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
PARTS = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)


def boilerplate_words(value: str) -> set[str]:
    """Words of a class, id or role that name boilerplate; 'has-sidebar' and the like name its surroundings."""
    found = set()
    for name in value.split():
        parts = PARTS.findall(CAMEL.sub("-", name).lower())
        found |= {
            p for i, p in enumerate(parts) if p in BOILERPLATE and (i == 0 or parts[i - 1] not in ("has", "with", "no", "without"))
        }
    return found


def named_boilerplate(tag: str, attributes: str) -> set[str]:
    """What an element's attributes say of its being boilerplate; empty if nothing."""
    found: set[str] = set()
    if not attributes.strip() or tag in ("html", "body", "main"):
        return found
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("class", "id", "role"):
            found |= boilerplate_words(value)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            found.add("hidden")
        elif name == "style" and HIDDEN.search(value):
            found.add("hidden")
    return found


@dataclass(frozen=True)
class Element:
    tag: str = ""
    skipped: bool = False  # boilerplate by markup, its own or of what holds it
    article: bool = False
    main: bool = False
    heading: bool = False  # in an article's header, of which only headings count
    block: str = ""  # the nearest block, itself included


@dataclass(frozen=True)
class Line:
    text: str
    tag: str  # the block that holds it
    skipped: bool
    article: bool
    main: bool


class Reader:
    """Reads a page from tag to tag and gathers its lines."""

    def __init__(self):
        self.stack = [Element()]
        self.opened: dict[str, int] = {}  # how many elements of a tag are open
        self.kept: list[str] = []
        self.skipped: list[str] = []
        self.lines: list[Line] = []

    def text(self, raw: str) -> None:
        here = self.stack[-1]
        (self.skipped if here.skipped else self.kept).append(html.unescape(raw) if "&" in raw else raw)

    def end_block(self) -> None:
        here = self.stack[-1]
        holder = here.block
        for pieces, skipped in ((self.kept, here.heading and holder not in HEADINGS), (self.skipped, True)):
            line = " ".join("".join(pieces).split())
            pieces.clear()
            if line:
                self.lines.append(Line(line, holder, skipped, here.article, here.main))

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.end_block()
        elif tag == "br":
            self.text(" ")
        if tag in VOID:
            return
        ends = CLOSES.get(tag, ())
        if any(self.opened.get(t) for t in ends):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in ends:
                    self.drop(i)
                    if not any(self.opened.get(t) for t in ends):
                        break
                elif self.stack[i].tag in SCOPES:
                    break
        here, named = self.stack[-1], named_boilerplate(tag, attributes)
        heading = here.article and (tag == "header" or named == {"header"})
        skipped = here.skipped or (not heading and (tag in SKIPPED or bool(named)))
        self.opened[tag] = self.opened.get(tag, 0) + 1
        self.stack.append(
            Element(tag, skipped, here.article or (tag == "article" and not skipped), here.main or tag == "main", here.heading or heading,
                    tag if tag in BLOCKS else here.block)
        )

    def drop(self, depth: int) -> None:
        for element in self.stack[depth:]:
            self.opened[element.tag] -= 1
        del self.stack[depth:]

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_block()
        if not self.opened.get(tag):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self.drop(i)
                return
            if self.stack[i].tag in SCOPES and tag not in SCOPES:
                return


def page_lines(source: str | None) -> list[Line]:
    """The blocks of text of a page, one line each, with what their markup says."""
    source, reader, at = source or "", Reader(), 0
    for m in TAG.finditer(source):
        if m.start() > at:
            reader.text(source[at : m.start()])
        at = m.end()
        if m["raw"] is not None:
            reader.text(" ")
        elif m["tag"] is not None:
            (reader.close if m["close"] else lambda t, a=m["attributes"]: reader.open(t, a))(m["tag"].lower())
    reader.text(source[at:])
    reader.end_block()
    return reader.lines


# ---- longest common subsequence


def prefix_lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``, with bits for ``b``."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``; memory grows with their sum."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = list(range(low))
    inner: list[int] = []
    todo = [(low, len(a) - high, low, len(b) - high)]
    while todo:  # halves of a, with the border in b that leaves most in common
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                inner.append(a0)
            continue
        mid = (a0 + a1) // 2
        left = prefix_lengths(a[a0:mid], b[b0:b1])
        right = prefix_lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
        border = b0 + int(np.argmax(left + right))
        todo += [(a0, mid, b0, border), (mid, a1, border, b1)]
    return out + sorted(inner) + list(range(len(a) - high, len(a)))


# ---- differencing of neighbours


@dataclass
class Page:
    row: int
    host: str
    path: str
    lines: list[Line]


def common_path(a: str, b: str) -> int:
    """How many leading characters two paths share."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def shared_with(page: Page, other: Page | None) -> set[int] | None:
    """Numbers of the lines that the neighbour has in the same order; None if it tells nothing.

    A page of another host tells nothing, nor does a copy, whose lines that are
    not boilerplate by markup are all the same.
    """
    if other is None or other.host != page.host:
        return None
    found = set(common_lines([x.text for x in page.lines], [x.text for x in other.lines]))
    content = {i for i, x in enumerate(page.lines) if not x.skipped}
    return None if content and content <= found else found


def main_text(page: Page, neighbours: list[Page | None]) -> tuple[str, int]:
    """The text that is left of a page, and how many lines the differencing deleted."""
    near = sorted((n for n in neighbours if n is not None), key=lambda n: -common_path(n.path, page.path))
    shared = next((s for s in (shared_with(page, n) for n in near) if s is not None), set())
    articles = any(x.article and not x.skipped for x in page.lines)
    mains = any(x.main and not x.skipped for x in page.lines)
    kept, deleted = [], 0
    for i, x in enumerate(page.lines):
        inside = x.article if articles else x.main if mains else True
        own = articles and x.article and x.tag in PROSE
        if i in shared and not own:
            deleted += 1
        elif inside and not x.skipped:
            kept.append(x.text)
    return " ".join(kept), deleted


def page_batches(names: list[str]) -> Callable:
    """Pages sorted by host and path; holds a batch and the pages on both sides of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: Page | None = None
        held: tuple[Page, list] | None = None  # a page that waits for the next one

        def finished(out: list) -> pa.RecordBatch:
            columns = list(zip(*out))
            fields = [pa.array(columns[k], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(
                [*fields, pa.array(columns[-2], pa.string()), pa.array([len(t) for t in columns[-2]], pa.int64()),
                 pa.array(columns[-1], pa.int64())],
                names=[*names, "text", "n_chars", "n_deleted"],
            )

        kinds: list = []
        for batch in texts.chunks(batches, "__html"):
            kinds = [batch.schema.field(n).type for n in names]
            out = []
            for i in range(batch.num_rows):
                value = lambda c: batch.column(c)[i].as_py()
                page = Page(i, value("__host"), value("__path"), page_lines(value("__html")))
                if held is not None:
                    out.append((*held[1], *main_text(held[0], [before, page])))
                    before = held[0]
                held = (page, [value(n) for n in names])
            if out:
                yield finished(out)
        if held is not None:
            yield finished([(*held[1], *main_text(held[0], [before]))])

    return run


def url_host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit(""))


def extract_text(
    pages: DataFrame, source: str = "html", url: str = "url", key: str = "page_id", ranges: int | None = None
) -> DataFrame:
    """``key``, ``url``, ``text``, ``n_chars`` (code points) and ``n_deleted`` of every row of ``pages``.

    ``n_deleted`` counts the lines that the nearest page of the host has too.
    Null and empty pages have the empty text. Pages with a null URL are of one
    nameless host. Rows that repeat are neighbours, and as copies they tell
    nothing of each other. Pages are sorted into ``ranges`` (as many as the
    session's shuffle partitions), so a host with many is cut; at the cuts a
    page has one neighbour. Other columns are not read.
    """
    read = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("__html"),
        url_host(F.col(url)).alias("__host"), url_path(F.col(url)).alias("__path"),
    )
    order = ["__host", "__path", "url", "key"]
    dealt = read.repartitionByRange(ranges or texts.spread(pages.sparkSession), *order).sortWithinPartitions(*order)
    schema = T.StructType(
        [T.StructField("key", pages.schema[key].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()),
         T.StructField("n_chars", T.LongType()), T.StructField("n_deleted", T.LongType())]
    )
    return dealt.mapInArrow(page_batches(["key", "url"]), schema).withColumnsRenamed({"key": key, "url": url})
