"""Main text of web pages, by removal of site templates.

Every page is parsed to a tree of elements. Hashes of the block-level subtrees (tags and text) are counted
per host in Spark, over pages of different content, and subtrees that recur are the host's template and are deleted
first. How often they must recur depends on what is at stake: outside a marked article a few pages will do; a container
at the edge of a page without one must be on more pages; within an article, or between its parts, it must be on a third of all
pages of the host, so that what some articles share stays.
Elements whose names merely hint at what is not the article (``search-algorithms``, ``menu-items``) are counted without their text, and
on a host with enough pages go only if they recur as well; on a smaller host they stay within a marked article. Labels and buttons go with
their form, and stay where they are in a text. What recurrence cannot show, for it differs from page to
page or the host has few pages, goes by tag, role, class or id: menus, footers, forms, comments and the like. If
a page marks its article, only what is marked is kept, and it is never deleted as a whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, map_batches

# Element names of the HTML standard, and names that sites commonly give to what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
DROP_TAGS = set("head nav footer aside form select object svg canvas audio video dialog menu".split()) | RAW
DROP_NAMES = re.compile(
    "ads?|adbox|adsense|adslot|advert.*|alerts?|.*banner|breadcrumbs?|comments?.*|.*cookies?.*|.*consent|copyright|disclaimer|disqus.*|.*footer|gdpr.*|login|masthead|.*menu|modal.*|.*nav|navbar.*|navigation|newsletter.*|notices?|overlay|pager|paginat.*|paywall|popup.*|promo.*|recommend.*|related.*|repl(?:y|ies)|respond|search.*|share.*|sharing|.*sidebar.*|signup|skip.*|social.*|sponsor.*|subscri.*|teasers?|toolbar|topbar|trackbacks?|widget.*"
)
#: Names that alone are enough: one of the words, perhaps of a part of the page, perhaps with what the frame of such a part is called;
#: what readers write, whatever its frame. With a word for what such a part holds (``menu-items``) a name is a hint.
SURE_NAMES = re.compile(
    "(?:(?:site|page|main|post|entry|article)[-_]?)?(?:(?:ads?|adverts?|advertisements?|advertising|alerts?|banner|breadcrumbs?|cookies?|consent|copyright|disclaimer|disqus|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|overlay|pager|pagination|paywall|popup|promos?|promotions?|recommended|recommendations?|related|replies|reply|respond|search|shares?|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|subscription|teasers?|toolbar|topbar|trackbacks?|widgets?)"
    "(?:[-_]?(?:area|articles?|bar|block|box|buttons?|container|form|menu|message|nav|news|notice|panel|posts?|section|slot|stories|unit|widget|wrap|wrapper))*"
    "|comments?(?:[-_]?(?:area|block|box|container|content|form|inner|items?|list|section|text|thread|wrap|wrapper))*)[-_]?[0-9]*"
)
CONTAINERS = set("div section aside ul ol table header footer nav form figure".split())
DROP_ROLES = set("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

#: How often a subtree recurs on its host: on a few pages, on many, and on many that are also a good share of all.
ON_SOME, ON_MANY, ON_MOST = 1, 2, 3
NOTHING: Mapping[int, int] = {}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>=]+|=)*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|[\"'/=]+")
_NAME = re.compile(r"[a-z]+|\d+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://([^/?#]*)", re.I)


class Element:
    __slots__ = ("tag", "names", "whole", "role", "hidden", "marked", "parts", "digest", "full", "size", "linked", "links", "mark_below", "title_below", "menu_below", "key", "candidate", "inside", "loose", "sure")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.names, self.whole, self.role, self.hidden, self.marked, self.parts = tag, (), (), "", False, tag in ("article", "main"), []
        self.candidate = self.inside = self.loose = self.sure = False
        if attributes and not attributes.isspace():
            for name, *values in _ATTRIBUTE.findall(attributes):  # one after another, so that no value is read as a name
                name, value = name.lower(), "".join(values).lower()
                if name in ("class", "id"):
                    self.names += tuple(_NAME.findall(value))
                    self.whole += tuple(value.split())
                elif name == "role":
                    self.role = value
                    self.marked |= value in ("main", "article")
                elif name == "itemprop":
                    self.marked |= value == "articlebody"
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    self.hidden = True
                elif name == "style":
                    self.hidden |= "display:none" in "".join(value.split())
            if self.names:
                self.loose = any(map(DROP_NAMES.fullmatch, self.names))
                self.sure = self.loose and any(map(SURE_NAMES.fullmatch, self.whole))

    def heading(self) -> bool:
        """Whether it calls itself a header and is not the head of an article: no title in it, or a menu."""
        return (self.tag == "header" or "header" in self.names) and (not self.title_below or self.menu_below)

    def holds_article(self) -> bool:
        return self.mark_below and self.tag not in DROP_TAGS

    def teaser(self) -> bool:
        """Nothing but headings and links, with a link."""
        return self.links > 0 and self.linked == self.size


def parse(html: str) -> Element:
    """The tree of a page. Wrong nesting is mended: a block ends an open paragraph, an end tag ends all that it
    encloses, end tags without a start are dropped, and what is open at the end ends there."""
    root = Element("#")
    stack, at, n = [root], 0, len(html)
    opened: Counter[str] = Counter()  # so that what is not open is not sought

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            stack[-1].parts.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].parts.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                close(max(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag) if stack[-1].tag != tag else len(stack) - 1)
            continue
        if tag in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in SIBLINGS and any(opened[t] for t in SIBLINGS[tag]):
            scope = SCOPES[tag]
            cut_at = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in scope:
                    break
                if stack[k].tag in SIBLINGS[tag]:
                    cut_at = k
            if cut_at:
                close(cut_at)
        own = Element(tag, m[3])
        stack[-1].parts.append(own)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and (tag in BLOCK or not m[3].endswith("/")):
            stack.append(own)  # a slash at the end of a block's tag means nothing in HTML
            opened[tag] += 1
    return root


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def _signed(x: int) -> int:
    return x - (1 << 63)


class Page:
    """A parsed page: its subtrees with their keys for the host, and where its article is."""

    def __init__(self, html: str, url: str | None = None):
        self.root = parse(html)
        host = xxhash.xxh3_64_intdigest(host_of(url))
        self.host = _signed(host ^ 0x686F7374)  # stands for the host itself, so its pages are counted along
        self.order = self._settle(host)
        marks = self._marks()
        kept = [m for m in marks if not m.teaser()]
        self.marked = bool(marks)
        self.roots = kept or marks or [self.root]
        for r in self.roots:
            if r is not self.root:
                self._each(r, lambda e: setattr(e, "inside", True))
        for e in self.order:
            if e.key and not e.marked and e.tag not in ("html", "body") and not e.holds_article():
                e.candidate = not e.inside or e.tag in CONTAINERS
        self.hashed_host = host

    def _settle(self, host: int) -> list[Element]:
        """All elements in page order; what an element contains is summed up from the leaves, without recursion."""
        order, stack = [], [self.root]
        while stack:
            e = stack.pop()
            order.append(e)
            stack += [p for p in reversed(e.parts) if not isinstance(p, str)]
        for e in reversed(order):
            own, e.full, e.size, e.linked, e.links = xxhash.xxh3_64(e.tag), False, 0, 0, int(e.tag == "a")
            e.mark_below = e.title_below = e.menu_below = False
            if e.tag not in RAW:
                for p in e.parts:
                    if isinstance(p, str):
                        if words := p.split():
                            own.update("\1" + (text := " ".join(words)))
                            e.full = True
                            e.size += len(text)
                        continue
                    e.mark_below |= p.mark_below or p.marked and not p.loose
                    e.title_below |= p.title_below or p.tag in ("h1", "h2")
                    e.menu_below |= p.menu_below or p.tag in ("nav", "form", "menu")
                    e.links += p.links
                    if p.full:
                        own.update(p.digest)
                        e.full = True
                        e.size += p.size
                        e.linked += p.linked
            if e.tag == "a" or e.tag in HEADINGS:
                e.linked = e.size
            e.digest = own.digest()
            e.key = _signed(own.intdigest() ^ host) if e.full and e.tag in BLOCK else 0
        return order

    def _marks(self) -> list[Element]:
        """Elements that the page marks as its article, outermost first in page order."""
        stack, found = [self.root], []
        while stack:
            x = stack.pop()
            if x.marked and not (x.tag == "article" and x.loose):
                found.append(x)
                continue
            if x.tag not in DROP_TAGS and x.role not in DROP_ROLES and (x.tag in ("#", "html", "body") or x.holds_article() or not x.loose):
                stack += [p for p in reversed(x.parts) if not isinstance(p, str)]
        return found

    @staticmethod
    def _each(e: Element, f) -> None:
        stack = [p for p in e.parts if not isinstance(p, str)]
        while stack:
            x = stack.pop()
            f(x)
            stack += [p for p in x.parts if not isinstance(p, str)]

    def _signature(self, e: Element) -> int:
        """Key of an element without its text."""
        return _signed(xxhash.xxh3_64_intdigest("\0".join((e.tag, *e.whole))) ^ self.hashed_host)

    def keys(self) -> list[int]:
        """Keys that are counted per host: the host's own, those of the subtrees that may be template (all outside the
        article, inside it containers), and of elements with doubtful names."""
        found = {e.key for e in self.order if e.candidate}
        found |= {self._signature(e) for e in self.order if e.loose and not e.sure}
        return [self.host, *sorted(found - {self.host})]

    def _template(self, e: Element, template, edges: set[int]) -> bool:
        often = template.get(e.key, 0) if e.candidate else 0
        if not often or self.marked and not e.inside:
            return often > 0
        return often == ON_MOST and (e.tag in CONTAINERS or id(e) in edges) or often >= ON_MANY and e.tag in CONTAINERS and id(e) in edges

    def _unwanted(self, e: Element, template, by_name: bool) -> bool:
        if e.tag in ("#", "html", "body") or e.holds_article():
            return False
        if e.tag in DROP_TAGS or e.hidden or e.role in DROP_ROLES or e.heading():
            return True
        if not by_name or not e.loose:
            return False
        if e.sure:
            return True
        return template.get(self._signature(e), 0) == ON_MOST if template.get(self.host, 0) >= ON_MANY else not e.inside

    def _edges(self, template, by_name: bool) -> set[int]:
        """Template blocks of any kind (by id()) before the first and after the last text of a page that stays."""
        found: set[int] = set()
        if not template or self.marked:
            return found
        for turned in (True, False):
            stack: list = [self.root]
            while stack:
                x = stack.pop()
                if isinstance(x, str):
                    if x and not x.isspace():
                        break
                    continue
                often = template.get(x.key, 0) if x.candidate else 0
                if often == ON_MOST or often >= ON_MANY and x.tag in CONTAINERS:
                    found.add(id(x))
                    continue
                if self._unwanted(x, template, by_name):
                    continue
                stack += reversed(x.parts) if turned else x.parts
        return found

    def _blocks(self, e: Element, template, by_name: bool, edges: set[int]) -> list[str]:
        """Text of the wanted blocks in page order, white space made one space."""
        out: list[str] = []
        held: list[str] = []

        def flush() -> None:
            if text := " ".join("".join(held).split()):
                out.append(text)
            held.clear()

        stack: list = [e]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                held.append(x)
                continue
            if x is None:
                flush()
                continue
            if x is not e:
                if x.tag == "br":
                    held.append(" ")
                    continue
                if self._template(x, template, edges):
                    flush()
                    continue
                if self._unwanted(x, template, by_name):
                    if x.tag in BLOCK:
                        flush()
                    continue
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.parts)
        flush()
        return out

    def text(self, template: Mapping[int, int] = NOTHING) -> str:
        """Blocks of the article, joined by empty lines. Where nothing would be left of a page, first its template, then its
        names are not believed."""
        found: list[str] = []
        for known, by_name in ((template, True), (NOTHING, True), (NOTHING, False)):
            edges = self._edges(known, by_name)
            found = [b for r in self.roots for b in self._blocks(r, known, by_name, edges)]
            if found:
                break
        return "\n\n".join(found)

    def deleted(self, template: Mapping[int, int] = NOTHING) -> tuple[int, int, int]:
        """Characters of text that go as template, by tag, role or name, and for standing outside the marked article."""
        by = [0, 0, 0]
        edges = self._edges(template, True)
        articles = {id(r) for r in self.roots}
        stack: list[Element] = [self.root]
        while stack:
            x = stack.pop()
            if self._template(x, template, edges):
                by[0] += x.size
            elif x.tag in RAW:
                continue
            elif self._unwanted(x, template, True):
                by[1] += x.size
            else:
                if self.marked and not x.inside and id(x) not in articles:
                    by[2] += sum(len(" ".join(p.split())) for p in x.parts if isinstance(p, str))
                stack += [p for p in x.parts if not isinstance(p, str)]
        return by[0], by[1], by[2]


def text_of(html: str | None, url: str | None = None, template: Mapping[int, int] = NOTHING) -> str:
    return Page(html, url).text(template) if html else ""


def extract(pages: DataFrame, least_pages: int = 8, broadcast_limit: int = 500_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_share: float = 1 / 3, least_outside: int = 3, report: bool = False) -> DataFrame:
    """(id, url, text, n_chars) of every page; with ``report`` also how many characters of text went as template, by name
    and for standing outside the marked article (template_chars, named_chars, outside_chars).

    A subtree is template if it recurs on pages of its host that differ in content, so copies of one page are no
    evidence: on ``least_outside`` of them if it stands outside a marked article; on ``least_pages`` if it is a container
    at the edge of a page that marks none; elsewhere on as many that are also ``least_share`` of the host's pages. What
    recurs less is left to tags and names. A marked
    article that is nothing but headings and links is a teaser and goes if the page has another one; all others
    are kept, whatever their length. Template keys are broadcast (9 bytes each) if there are at most
    ``broadcast_limit``; beyond it they are joined to the pages that have them, with the same result. Null or empty html
    gives the empty text; pages with a null or odd url share one unnamed host; repeated rows give repeated rows; an
    empty table gives none; a long or deep page is taken whole, in time and memory in proportion to it; other columns are
    not read. There are no ties: a count decides by itself.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    keyed = pa.schema([("page", pa.int64()), ("host", pa.int64()), ("content", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for url, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                html = html.as_py() or ""
                page = Page(html, url)
                found.append((_page(url, html), page.host, _signed(xxhash.xxh3_64_intdigest(page.text().encode("utf-8", "surrogatepass"))), page.keys()))
            yield batch(keyed, list(zip(*found, strict=True)) if found else [[], [], [], []])

    listed = map_batches(rows.select("url", "html").where("html is not null"), list_keys, "page long, host long, content long, keys array<long>")
    counted = cut(listed.select("host", "content", F.explode("keys").alias("key")).distinct().groupBy("host", "key").count().where(F.col("count") >= least_outside))
    hosts = counted.where("key = host").select("host", F.col("count").alias("pages"))
    many = F.col("count") >= least_pages
    often = F.when(many & (F.col("count") >= least_share * F.col("pages")), ON_MOST).when(many, ON_MANY).otherwise(ON_SOME)
    template = cut(counted.join(hosts, "host").select("key", often.alias("often")))
    counts = ["template_chars", "named_chars", "outside_chars"] if report else []
    schema = pa.schema([(id_col, pa.int64()), (url_col, pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), *((c, pa.int64()) for c in counts)])
    shape = f"`{id_col}` long, `{url_col}` string, text string, n_chars long" + "".join(f", {c} long" for c in counts)

    def texts(b: pa.RecordBatch, held) -> pa.RecordBatch:
        """``held``: keys and how often they are, for all rows or for each."""
        out: list[list] = [[], [], *([] for _ in counts)]
        for k, (url, html) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
            known = held if isinstance(held, dict) else held[k]
            page = Page(html.as_py() or "", url)
            found = [text := page.text(known), len(text), *(page.deleted(known) if counts else ())]
            for column, x in zip(out, found, strict=True):
                column.append(x)
        return batch(schema, [b.column(0), b.column(1), *out])

    if template.count() <= broadcast_limit:
        found = template.collect()
        known = np.array([r["key"] for r in found], np.int64), np.array([r["often"] for r in found], np.int8)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = dict(zip(*(x.tolist() for x in known), strict=True))
            for b in batches:
                yield texts(b, held)

        return map_batches(rows, run, shape)

    paged = pa.schema([("id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("page", pa.int64())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(paged, [b.column(0), b.column(1), b.column(2), [_page(u, h.as_py() or "") for u, h in zip(b.column(1).to_pylist(), b.column(2), strict=True)]])

    own = listed.select("page", F.explode("keys").alias("key")).distinct().join(template, "key").groupBy("page").agg(F.map_from_entries(F.collect_set(F.struct("key", "often"))).alias("keys"))
    joined = map_batches(rows, name, "id long, url string, html string, page long").join(own, "page", "left").select("id", "url", "html", "keys")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield texts(b, [dict(k.as_py() or ()) for k in b.column(3)])

    return map_batches(joined, apart, shape)


def _page(url: str | None, html: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(f"{url or ''}\0{html}".encode("utf-8", "surrogatepass")))
