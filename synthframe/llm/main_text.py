"""Main text of web pages by consensus of a host's pages.

Every page scores its containers and votes for the generalised tag-class path of its best one; votes are
counted per host in Spark, and every page is read again at its host's winning path. A page that lacks the
path falls back to its own best container.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..session import scratch_path
from .texts import text_slices

# Fixed values of HTML: elements without content, with raw content, and elements that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
#: Open elements that a new one of the same group ends, and the elements beyond which it doesn't look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that hold no main text.
NOISE = frozenset("nav footer aside script style noscript template form button select option textarea input iframe object svg canvas head title menu dialog audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Words of class names and ids that mark menus, notices, adverts and reader comments.
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay "
                        "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside footer masthead topbar toolbar share sharing social follow newsletter subscribe "
                        "subscription signup login comment comments commentlist disqus respond replies reply related recommended recommendations widget widgets pagination pager skip "
                        "hidden".split())
#: Elements of running text.
SPOKEN = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Class names that mark content, and first words of a name that only speak about its page or its surroundings.
CONTENT_NAMES = frozenset("article body content entry main page post story text".split())
SAYING = frozenset("has have is no not show hide with without".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?][^>]*>?)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([^\s=/\"'>]+)")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")


class Element:
    """An element of the open stack or a container of the page."""

    __slots__ = ("tag", "parent", "label", "noise", "article", "linked", "container", "place", "score", "first", "last", "lists")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent = tag, parent
        found = {(m[1] or m[3]).lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        classes = sorted({re.sub(r"\d+", "#", c) for c in found.get("class", "").lower().split()})
        self.label = ".".join([tag, *classes])
        self.article = tag in ("article", "main") or parent is not None and parent.article
        self.linked = tag == "a" or parent is not None and parent.linked
        self.noise = parent is not None and parent.noise or tag in NOISE or tag == "header" and not self.article or self._marked(tag, found)
        self.container = self if tag in CONTAINERS else parent.container if parent else None
        # stands for the whole path, which is only spelled where it matters
        self.place = hash((parent.place if parent else 0, self.label))
        self.score = 0.0
        self.first = self.last = -1  # blocks of a container
        self.lists = 0  # text outside links in the items of a list

    def _marked(self, tag: str, found: dict[str, str]) -> bool:
        if not found or tag in ("html", "body", "main", "article"):
            return False
        if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
            return True
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            return True
        return marked_names(found.get("class", "").lower().split() + found.get("id", "").lower().split())

    def path(self) -> str:
        names, at = [], self
        while at is not None:
            names.append(at.label)
            at = at.parent
        return ">".join(reversed(names))


def marked_names(names: list[str]) -> bool:
    """Whether class names and ids mark a menu, notice, advert or the like.

    A name that is such a word does. A name that has one as a part does as well (``cookie-banner``), unless it says what the
    page has or lacks (``has-sidebar``, ``no-comments``), or another name of the element marks content.
    """
    words = [WORDS.findall(n) for n in names]
    if any(len(w) == 1 and w[0] in NOISE_WORDS for w in words):
        return True
    if any(len(w) == 1 and w[0] in CONTENT_NAMES for w in words):
        return False
    return any(w and w[0] not in SAYING and any(x in NOISE_WORDS for x in w) for w in words)


class Page:
    """Blocks of text of a page, in order, and its containers."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, Element, int]] = []  # text, element, characters inside links
        self.containers: list[Element] = []
        self._parts: list[str] = []
        self._linked = 0
        self._open: Counter[str] = Counter()  # open elements by tag: what is not open is not looked for
        root = Element("html", None, "")
        root.container = root
        self.containers.append(root)
        self._stack = [root]
        self._read(source)
        self._flush()
        while self._stack:
            self._close()

    def _read(self, source: str) -> None:
        at = 0
        while True:
            token = TOKEN.search(source, at)
            self._text(source[at : token.start()] if token else source[at:])
            if token is None:
                return
            at = token.end()
            tag = token[2].lower() if token[2] else ""
            if not tag:
                continue
            if token[1]:
                self._end(tag)
                continue
            self._start(tag, token[3])
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(source, at)
                at = close.start() if close else len(source)

    def _text(self, text: str) -> None:
        if text and not self._stack[-1].noise:
            text = html.unescape(text)
            self._parts.append(text)
            if self._stack[-1].linked:
                self._linked += len(text.strip())

    def _flush(self) -> None:
        if self._parts:
            text = SPACE.sub(" ", "".join(self._parts)).strip()
            if text:
                self.blocks.append((text, self._stack[-1], self._linked))
                if (item := self._listed()) is not None:
                    item.lists += max(len(text) - self._linked, 0)
            self._parts = []
        self._linked = 0

    def _listed(self) -> Element | None:
        """The list that the open element is an item of."""
        return list_of(self._stack[-1]) if self._open["li"] else None

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            if self._open["p"]:
                self._pop_to({"p"}, CONTAINERS | {"table", "ul", "ol", "li"})
        elif tag == "br":
            self._parts.append(" ")
        if tag in ENDS:
            self._pop_to(*ENDS[tag])
        if tag in VOID or tag == "html":
            return
        element = Element(tag, self._stack[-1], attributes.rstrip("/"))
        if tag in CONTAINERS:
            element.first = len(self.blocks)
            self.containers.append(element)
        self._stack.append(element)
        self._open[tag] += 1

    def _pop_to(self, tags: set[str], beyond) -> None:
        if not any(self._open[t] for t in tags):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            if self._stack[depth].tag in tags:
                self._flush()
                while len(self._stack) > depth:
                    self._close()
                return
            if self._stack[depth].tag in beyond:
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if not self._open[tag]:
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            if self._stack[depth].tag == tag:
                while len(self._stack) > depth:
                    self._close()
                return
            if tag not in BLOCKS and self._stack[depth].tag in CONTAINERS:
                return

    def _close(self) -> None:
        element = self._stack.pop()
        self._open[element.tag] -= 1
        if element.tag in CONTAINERS or not self._stack:
            element.first, element.last = max(element.first, 0), len(self.blocks)

    def best(self) -> Element | None:
        """The container with the most text of its own: a block counts for the nearest container, and half for the one around it."""
        for text, element, linked in self.blocks:
            near = element.container
            worth = len(text) - 2 * linked + (25 if element.tag == "p" else 0)
            near.score += worth
            if near.parent is not None and near.parent.container is not None:
                near.parent.container.score += worth / 2
        found = max(self.containers, key=lambda e: e.score + 0.25 * e.score * (e.tag in ("article", "main")), default=None)
        return self._whole(found) if found is not None and found.score > 0 else None

    def _whole(self, found: Element) -> Element:
        """The container around the best one that holds an article in parts, else the best one.

        What stands beside it must be paragraphs and headings for the most part, at least one paragraph among them; a box or
        a list of links is none. The page's body is never taken for an article in parts.
        """
        at = found
        while at.parent is not None and (at := at.parent.container) is not None and at.tag not in ("html", "body"):
            rest = self.blocks[at.first : found.first] + self.blocks[found.last : at.last]
            if not rest:
                continue
            spoken = [(len(text) - linked, e.tag if e.tag in SPOKEN else e.parent.tag if e.parent is not None else "") for text, e, linked in rest]
            if not any(tag == "p" for _, tag in spoken) or 2 * sum(n for n, tag in spoken if tag in SPOKEN) < sum(len(text) for text, _, _ in rest):
                break
            found = at
        return found

    def at_path(self, path: str) -> list[Element]:
        """Outermost containers with that path, in page order."""
        place = 0
        for label in path.split(">"):
            place = hash((place, label))
        found: list[Element] = []
        for element in self.containers:
            if element.place == place and not (found and element.last <= found[-1].last) and not element.noise and element.path() == path:
                found.append(element)
        return found

    def text(self, elements: list[Element]) -> str:
        """Blocks inside the elements. Outside an article, lists of several items that all are nothing but links are menus."""
        kept = []
        for element in elements:
            blocks = self.blocks[element.first : element.last]
            items = Counter(id(group) for _, inside, _ in blocks if (group := list_of(inside)) is not None)
            for text, inside, _ in blocks:
                group = list_of(inside)
                if group is None or inside.article or group.lists > 0 or items[id(group)] < 2:
                    kept.append(text)
        return "\n\n".join(kept)


def list_of(element: Element) -> Element | None:
    """The list around an element's nearest list item, if no other container stands between."""
    at: Element | None = element
    while at is not None and at.tag not in CONTAINERS:
        if at.tag == "li":
            return at.parent
        at = at.parent
    return None


def host_of(column: str = "url"):
    """Lower-cased host of an address; an address without one is its own host, a null one the empty host."""
    url = F.coalesce(F.col(column), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host == "", url).otherwise(host)


#: Bytes of winning paths up to which they are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def _votes(batches: Iterator[pa.RecordBatch]):
    for part in text_slices(batches, "_html"):
        found = [Page(h or "").best() for h in part.column("_html").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("_host"), pa.array([e.path() if e else None for e in found], pa.string()), pa.array([e.score if e else 0.0 for e in found], pa.float64())], ["_host", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]):
    for part in text_slices(batches, "_html"):
        texts, paths = [], []
        for source, winner in zip(part.column("_html").to_pylist(), part.column("path").to_pylist()):
            page = Page(source or "")
            found = page.at_path(winner) if winner else []
            text = page.text(found)
            if not text and (own := page.best()) is not None:
                found, text = [own], page.text([own])
            texts.append(text)
            paths.append(found[0].path() if found else None)
        yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string()), pa.array(paths, pa.string())], ["_row", "text", "path"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(``_host``, ``path``): the winning path of each host, by votes, then score, then name. Counted map-side first."""
    voted = (pages.select(host_of(url_col).alias("_host"), F.col(f"`{html_col}`").alias("_html")).mapInArrow(_votes, "_host string, path string, score double")
             .filter("path IS NOT NULL").groupBy("_host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("score").cast("long")).alias("score")))
    order = Window.partitionBy("_host").orderBy(F.desc("votes"), F.desc("score"), "path")
    return voted.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("_host", "path")


def main_text(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per input row: ``id_cols``, ``text`` (blocks joined by an empty line; empty if none), ``n_chars`` and ``path``.

    A null page is empty. Repeated rows stay and each has a vote. Other columns are not read. A host may hold
    most of the pages: votes are counted before the shuffle, and pages meet their host's path by a broadcast
    if all paths together are small (checked), else by a join whose hot hosts Spark splits.
    """
    written = scratch_path(pages.sparkSession, "host-paths")
    host_paths(pages, url_col, html_col).write.parquet(written)
    paths = pages.sparkSession.read.parquet(written)
    size = paths.agg(F.sum(F.octet_length("_host") + F.octet_length("path"))).first()[0] or 0
    winners = F.broadcast(paths) if size <= BROADCAST_BYTES else paths
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in id_cols]).alias("_row"), host_of(url_col).alias("_host"), F.col(f"`{html_col}`").alias("_html"))
    kinds = ",".join(f"`{c}`:{pages.schema[c].dataType.simpleString()}" for c in id_cols)
    found = rows.join(winners, "_host", "left").select("_row", "_html", "path").mapInArrow(_extract, f"_row struct<{kinds}>, text string, path string")
    return found.select("_row.*", "text", F.char_length("text").cast("long").alias("n_chars"), "path")
