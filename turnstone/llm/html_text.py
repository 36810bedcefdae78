"""Main text of web pages by two-pass block rules.

A page is cut into blocks at the borders of block elements. The first pass decides blocks by themselves: blocks inside
boilerplate elements, and short ones that are mostly links, are bad; long blocks with enough stop words are good; the
others are ambiguous. Inside an article element only links and boilerplate speak against a block, and three words are
long enough. The second pass lets ambiguous blocks inherit the label of the nearest decided block.

Each page is read once, from left to right, in time proportional to its length, inside a narrow Arrow transformation:
no shuffle.

Rules: a null html is empty, and an empty page has an empty text. Nothing is dropped or cut for its length. Rows that
repeat a page, or have no id or url, are rows like all others. Markup that ends in the middle of a tag, comment, script or
style loses that rest; unknown character references stay as they are.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he are this or his from at which but have an had they you "
    "were one all we can her has there been if more when will would who so no "
    "der die das und ist in den von zu mit sich dem des nicht ein eine als auch auf für im am es war er sie wir "
    "le la les de du des et est en un une dans que qui par pour au aux sur pas ne ce il elle nous se plus "
    "el los las del y no por con su para es al lo como más pero sus una fue ha".split())
#: Raw text elements, read up to their end tag; and elements whose content is shown in a paragraph, but no part of its text.
RAW = "script|style|textarea|title|iframe"
SILENT = frozenset("svg canvas audio video object select datalist button noscript template".split())
#: Elements that never hold main text, and landmarks of the main text.
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
#: Names (id, class or role) of elements that are landmarks too.
LANDMARKS = frozenset("main article content maincontent main-content article-body articlebody article-content post post-body "
                      "post-content entry entry-content story story-body".split())
#: Words in class, id, role and aria-label that name boilerplate; the second list also counts on article elements.
HINTS = frozenset(
    "banner popup modal overlay cookie cookies consent gdpr notice notices alert disclaimer nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside share sharing social footer header masthead topbar toolbar pagination pager newsletter subscribe "
    "subscription signup login search searchform copyright complementary contentinfo alertdialog skip".split())
STRONG_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion widget related recommended comment "
    "comments commentlist reply replies respond disqus".split())
#: Words that turn a name into its opposite, or only tell of a layout: has-sidebar, ad-free.
NEGATIONS = frozenset("has with no not without free".split())
#: Elements that hold blocks; those without a number of their own hold blocks beside each other in the element above.
BESIDE = frozenset("p li dt dd tr td th tbody thead tfoot".split())
HOLDERS = BOILERPLATE | ARTICLE | BESIDE | frozenset("div section ul ol dl table blockquote figure details center address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SEPARATORS = HOLDERS | HEADINGS | frozenset("html body pre hr caption figcaption summary legend option optgroup hgroup".split())
#: Elements that end an open element of these kinds.
CELLS = frozenset("td th".split())
IMPLIED = {"li": frozenset(["li"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "td": CELLS, "th": CELLS, "tr": CELLS | {"tr"}}
#: Bounds of the first pass: share of link characters, share of stop words, words of a long block.
LINK_SHARE, STOP_SHARE, LONG_WORDS, ARTICLE_WORDS = 0.5, 0.2, 12, 3

TOKEN = re.compile(
    r"(?P<skipped><!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>" + RAW + r")(?=[\s/>]).*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*(?:>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attributes>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>"
    r"|(?P<cut></?[a-z].*\Z)|(?P<text>[^<]+|<)",
    re.IGNORECASE | re.DOTALL | re.ASCII)
NAMING = re.compile(r"(?:^|[\s\"'/])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|[\s\"'])hidden(?:$|[\s=/])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NO_WORD = re.compile(r"[^a-z0-9]+")
GOOD, BAD = True, False


@dataclass
class Block:
    """A block's text and what the rules look at."""

    text: str
    linked: int
    holder: int
    article: int
    boilerplate: bool
    heading: bool


def named(name: str, attributes: str) -> tuple[bool, bool]:
    """(boilerplate, landmark) by the words of class, id, role and label, or by not being shown at all."""
    if "=" not in attributes:
        return "hidden" in attributes.lower().split(), False
    bad, landmark = HIDDEN.search(attributes) is not None, False
    hints = STRONG_HINTS if name in ARTICLE else HINTS | STRONG_HINTS
    for m in NAMING.finditer(attributes):
        for value in (m[2] or m[3] or m[4] or "").split():
            landmark |= value.lower() in LANDMARKS
            words = set(NO_WORD.split(CAMEL.sub(" ", value).lower()))
            bad |= bool(words & hints) and not words & NEGATIONS
    return bad, landmark and not bad


@dataclass
class _Open:
    """An open element: the element its blocks are counted to, the article it stands in (0: none), what it is."""

    name: str
    holder: int = 0
    article: int = 0
    boilerplate: bool = False
    silent: bool = False


class _Page:
    """Reads markup from left to right: the open elements, and the block that is being gathered."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.open = [_Open("")]
        self.count: Counter[str] = Counter()
        self.numbers = self.links = 0
        self.heading = False
        self.parts: list[str] = []
        self.link_parts: list[str] = []

    def cut(self) -> None:
        """Ends the block that is being gathered."""
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            linked = len(" ".join(html.unescape("".join(self.link_parts)).split()))
            top = self.open[-1]
            self.blocks.append(Block(text, linked, top.holder, top.article, top.boilerplate, self.heading))
        self.parts, self.link_parts, self.heading = [], [], False

    def push(self, element: _Open) -> None:
        self.open.append(element)
        self.count[element.name] += 1

    def pop(self) -> str:
        name = self.open.pop().name
        self.count[name] -= 1
        return name

    def start(self, name: str, attributes: str) -> None:
        top = self.open[-1]
        if name == "a":
            self.links += 1
        elif name == "br":
            self.text(" ")
        elif name in SILENT and not attributes.endswith("/"):
            self.push(_Open(name, top.holder, top.article, top.boilerplate, True))
        if name not in SEPARATORS:
            return
        self.cut()
        if self.open[-1].name == "p":
            self.pop()
        while self.open[-1].name in IMPLIED.get(name, ()):
            self.pop()
        self.heading = name in HEADINGS
        if name in HOLDERS and not attributes.endswith("/"):
            self.hold(name, attributes)

    def hold(self, name: str, attributes: str) -> None:
        top = self.open[-1]
        bad, landmark = named(name, attributes)
        if top.article and name == "header" or bad and top.article and not landmark and self.only_header(attributes):
            bad = False
        elif name in BOILERPLATE:
            bad = True
        bad |= top.boilerplate
        if name not in BESIDE:
            self.numbers += 1
        holder = top.holder if name in BESIDE else self.numbers
        article = 0 if bad else top.article or (holder if name in ARTICLE or landmark and name not in BESIDE else 0)
        self.push(_Open(name, holder, article, bad, top.silent))

    @staticmethod
    def only_header(attributes: str) -> bool:
        """Whether the only word for boilerplate is `header`, which inside an article names its own head."""
        words = {w for m in NAMING.finditer(attributes) for w in NO_WORD.split(CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower())}
        return words & (HINTS | STRONG_HINTS) == {"header"} and not HIDDEN.search(attributes)

    def end(self, name: str) -> None:
        if name == "a":
            self.links = max(0, self.links - 1)
        if name in SEPARATORS:
            self.cut()
        if self.count[name]:
            while self.pop() != name:
                pass
            if name in HOLDERS:
                self.links = 0

    def text(self, value: str) -> None:
        if not self.open[-1].silent:
            self.parts.append(value)
            if self.links:
                self.link_parts.append(value)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that hold text, in order."""
    state = _Page()
    for m in TOKEN.finditer(page):
        if m["text"] is not None:
            state.text(m["text"])
        elif m["name"] is not None:
            if m["end"]:
                state.end(m["name"].lower())
            else:
                state.start(m["name"].lower(), m["attributes"])
    state.cut()
    return state.blocks


def first_pass(block: Block) -> bool | None:
    """GOOD, BAD or None for ambiguous, from the block alone."""
    if block.boilerplate:
        return BAD
    words = block.text.lower().split()
    if block.linked > LINK_SHARE * len(block.text):
        return None if block.article and len(words) >= LONG_WORDS else BAD
    if block.article:
        return GOOD if block.heading or len(words) >= ARTICLE_WORDS else None
    if "©" in block.text:
        return BAD
    if block.heading or len(words) < LONG_WORDS:
        return None
    stops = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words)
    return GOOD if stops >= STOP_SHARE * len(words) else None


def _beside(labels: list[bool | None], keys: list[int]) -> list[list[tuple[int, bool]]]:
    """For each ambiguous block the decided blocks before and after it with the same key: (distance, label)."""
    out: list[list[tuple[int, bool]]] = [[] for _ in labels]
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last: dict[int, int] = {}
        for k in order:
            if labels[k] is not None:
                last[keys[k]] = k
            elif keys[k] in last:
                out[k].append((abs(last[keys[k]] - k), labels[last[keys[k]]]))
    return out


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Ambiguous blocks inherit the label of the nearest decided block: in their element, else in their article, and
    outside articles on the whole page. A tie, or no decided block, makes a block good in an article, before a good
    block if it is a heading, and bad elsewhere."""
    near = _beside(labels, [b.holder for b in blocks])
    wide = _beside(labels, [b.article for b in blocks])
    page = _beside(labels, [0] * len(blocks))
    out = []
    for k, (block, label) in enumerate(zip(blocks, labels, strict=True)):
        if label is None:
            found = near[k] or wide[k] or ([] if block.article else page[k])
            least = min((d for d, _ in found), default=0)
            votes = [x for d, x in found if d == least]
            if len(set(votes)) == 1:
                label = votes[0]
            else:
                label = bool(block.article) or block.heading and bool(votes) and votes[-1]
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The good blocks of a page, a line each."""
    blocks = blocks_of(page) if page else []
    labels = second_pass(blocks, [first_pass(b) for b in blocks])
    return "\n".join(b.text for b, good in zip(blocks, labels, strict=True) if good)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text, n_chars), one row per row."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
