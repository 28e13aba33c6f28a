"""Main text of web pages by paths that the pages of a host agree on.

Every page scores its containers by their own text; each container has a generalised path of
tags and classes. Spark adds the scores up per host and path. The path with the most weight wins the host, and
every page of the host is extracted again from the containers on that path.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import stage, texts

#: Tags whose content is never text, and tags that hold what surrounds an article.
RAW = frozenset({"script", "style", "noscript", "template", "textarea", "svg", "iframe", "title"})
AROUND = frozenset({
    "nav", "header", "footer", "aside", "form", "head", "menu", "button", "select", "dialog", "object", "canvas",
    "audio", "video", "map",
})
VOID = frozenset({
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
})
INLINE = frozenset({
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr",
})
CONTAINERS = frozenset({"article", "main", "section", "div", "body", "td", "blockquote"})
#: Words in a class or id that mark what surrounds an article, and words that mark readers' comments.
SURROUND = frozenset({
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo",
    "promotion", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header",
    "masthead", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "share", "sharing", "social", "related", "recommended", "widget", "toolbar",
    "pagination", "pager", "login", "signup", "search", "comment", "comments", "disqus", "respond", "reply", "replies",
    "discussion", "copyright",
})
#: What closes an open paragraph or item that has no end tag.
CLOSES_P = frozenset({
    "p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "header", "footer", "nav", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "pre", "blockquote", "hr", "main", "figure", "fieldset", "address", "details",
})
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)(>|\Z)|<(?=/?[A-Za-z!?])[^<]*\Z", re.S,
)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLASS = re.compile(r"class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Container:
    """An open or closed element that may hold an article, and the blocks directly or deeper in it."""

    path: str
    first: int
    last: int = -1
    letters: int = 0
    linked: int = 0


@dataclass
class Page:
    """The text blocks of a page in order, and its containers."""

    blocks: list[str] = field(default_factory=list)
    containers: list[Container] = field(default_factory=list)


def _words(attributes: str) -> set[str]:
    found = set()
    for groups in _MARK.findall(attributes):
        for word in _SPACE.split("".join(groups).lower()):
            found.update(re.split(r"[-_0-9]+", word))
    return found


def generalised(tag: str, attributes: str) -> str:
    """The tag with its sorted classes; numbers in classes become '#'."""
    if not attributes:
        return tag
    names = {
        re.sub(r"[0-9]+", "#", w) for g in _CLASS.findall(attributes) for w in "".join(g).lower().split()
    }
    return ".".join([tag, *sorted(names)])


class Reader:
    """One pass over a page: blocks of text outside what surrounds an article, and containers."""

    def __init__(self) -> None:
        self.page = Page()
        self.stack: list[tuple[str, bool, Container | None]] = []
        self.hidden = 0
        self.links = 0
        self.open: list[Container] = []
        self.text: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        """End the block in progress."""
        if self.text:
            block = "".join(self.text)
            block = " ".join((html.unescape(block) if "&" in block else block).split())
            if block:
                self.page.blocks.append(block)
                if self.open:
                    self.open[-1].letters += len(block)
                    self.open[-1].linked += min(self.linked, len(block))
            self.text = []
        self.linked = 0

    def add(self, text: str) -> None:
        if not self.hidden and text:
            self.text.append(text)
            if self.links:
                self.linked += len(text.strip())

    def begin(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.add(" ")
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            return
        if tag in CLOSES_P:
            self.end_inside("p", {"p"}, stop=frozenset({"article", "section", "div", "td", "li", "body", "main"}))
        if tag in SAME:
            self.end_inside(tag, SAME[tag], stop=frozenset({"ul", "ol", "dl", "table", "select"}))
        if tag not in INLINE:
            self.flush()
        hides = tag in AROUND or (tag not in ("body", "html", "article") and bool(
            attributes and SURROUND & _words(attributes)
        ))
        held = None
        if tag in CONTAINERS and not hides and not self.hidden:
            above = self.open[-1].path + "/" if self.open else ""
            held = Container(above + generalised(tag, attributes), len(self.page.blocks))
            self.page.containers.append(held)
            self.open.append(held)
        self.hidden += hides
        self.links += tag == "a"
        self.stack.append((tag, hides, held))

    def pop(self) -> None:
        tag, hides, held = self.stack.pop()
        if tag not in INLINE:
            self.flush()
        self.hidden -= hides
        self.links -= tag == "a"
        if held is not None:
            held.last = len(self.page.blocks)
            self.open.pop()

    def end_inside(self, tag: str, same: set[str], stop: frozenset[str]) -> None:
        """Close an open element of these tags, unless a ``stop`` tag is opened inside it."""
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in same:
                while len(self.stack) > k:
                    self.pop()
                return
            if name in stop:
                return

    def end(self, tag: str) -> None:
        """Close up to the matching open tag; an end tag without one is left out."""
        if tag == "br":
            return self.add(" ")
        if any(name == tag for name, _, _ in self.stack):
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()
        elif tag not in INLINE and not any(name in RAW for name, _, _ in self.stack):
            self.flush()
        return None

    def read(self, source: str) -> Page:
        at, size = 0, len(source)
        while at < size:
            token = _TOKEN.search(source, at)
            if token is None:
                self.add(source[at:])
                break
            self.add(source[at : token.start()])
            at = token.end()
            name = (token[2] or "").lower()
            if not name:
                continue
            if token[1]:
                self.end(name)
            elif token[4] != ">":
                break
            elif name in RAW:
                done = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = done.end() if done else size
            elif not token[3].rstrip().endswith("/") or name not in VOID:
                self.begin(name, token[3])
            elif name in VOID:
                self.begin(name, token[3])
        while self.stack:
            self.pop()
        self.flush()
        return self.page


def read_page(source: str) -> Page:
    return Reader().read(source)


def scores(page: Page) -> list[tuple[str, float]]:
    """(path, score): text that is no link, its own in full, half of that of containers right
    inside and a quarter one deeper. Article and main count twice, the whole body half."""
    own: dict[str, float] = {}
    for container in page.containers:
        own[container.path] = own.get(container.path, 0.0) + container.letters - 2 * container.linked
    out = dict(own)
    for path, worth in own.items():
        for share in (0.5, 0.25):
            path = path.rpartition("/")[0]
            if path in out:
                out[path] += share * max(worth, 0.0)
    weigh = {"article": 2.0, "main": 2.0, "body": 0.5}
    return [
        (path, worth * weigh.get(path.rpartition("/")[2].partition(".")[0], 1.0))
        for path, worth in out.items() if worth > 0
    ]


def text_on(page: Page, path: str | None) -> str | None:
    """The blocks of the containers on the path, in page order; None if there is no such text."""
    ranges = [(c.first, c.last) for c in page.containers if c.path == path]
    blocks: list[str] = []
    done = 0
    for first, last in ranges:
        blocks += page.blocks[max(first, done) : last]
        done = max(done, last)
    return "\n\n".join(blocks) if blocks else None


def extract_one(source: str, path: str | None) -> str:
    """By the host's path; else by the page's own best container; else all blocks."""
    page = read_page(source)
    text = text_on(page, path)
    if text is None:
        own = max(scores(page), key=lambda x: (x[1], x[0]), default=(None, 0))[0]
        text = text_on(page, own)
    return "\n\n".join(page.blocks) if text is None else text


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the largest sum of scores over the host's pages.

    Each page gives weight 1, dealt over its paths by score. Ties go to the first path in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, weights = [], [], []
            for host, source in zip(batch.column("host").to_pylist(), texts(batch, "html"), strict=True):
                found = scores(read_page(source))
                total = sum(w for _, w in found)
                for path, weight in found:
                    hosts.append(host), paths.append(path), weights.append(round(weight / total * 1_000_000))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(weights, pa.int64())],
                names=["host", "path", "weight"],
            )

    votes = (
        pages.mapInArrow(run, "host string, path string, weight bigint").groupBy("host", "path")
        .agg(F.sum("weight").alias("weight"))
    )
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("weight"), "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty page, or one without text, gives ''. A page whose url has no host (or is
    null) belongs to the host ''. Where the host's path holds no text on a page, the page's own best container
    does. Repeated rows are extracted each; other columns are not read.
    """
    rows = pages.select(
        "page_id", "url", "html",
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"),
    )
    winners = stage(host_paths(rows.select("host", "html")))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                extract_one(source, path)
                for source, path in zip(texts(batch, "html"), batch.column("path").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(found, pa.string()),
                 pa.array(list(map(len, found)), pa.int64())], schema=schema,
            )

    return (
        rows.join(winners, "host", "left").select(F.col("page_id").cast("bigint"), "url", "html", "path")
        .mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
    )


