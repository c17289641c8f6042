"""Main text of web pages from flat text blocks and a decision tree.

A page is read as a flat row of text blocks: a block ends at every block-level tag.  Each block has its number of words, its
link density (share of its words inside links), the same of its neighbours, and two
marks from the tags around it: whether it stands in page furniture (menus, headers, footers, sidebars, notices,
adverts, forms, comments, by tag, role, class or id; a part of a class name such as sidebar-left does not count on the first article or main
element and on those around it) and whether it stands
in an article or main element (1), beside the one of its page (-1), or on a page without (0).  A decision
tree, fitted on the small table EXAMPLES, tells text from the rest.  Scripts, styles and other elements that show no text make no
blocks; one that is never closed ends at its own tag, a script or style at the next block-level tag.  Character references are decoded, white space inside a block becomes one space, blocks are joined by an
empty line.  Pages are read in one pass, without a shuffle.

Defined cases: null and empty html give an empty text; equal pages are each extracted; a page that ends inside
a tag or comment ends there; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

from creditspark.llm.common import pieces

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "article")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)"
    r"|<(?P<dark>script|style|noscript|template|title|iframe|object|svg|math|canvas|select|button|textarea|option|datalist)\b"
    r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[a-z]+")
#: Those of them whose elements hold articles of others.
_OTHERS = frozenset("comment comments disqus recommended related replies respond".split())
#: Parts of a class name after which the others tell of something else on the page.
_WITH = re.compile(r"(?:^|[^a-z])(?:with|without|has|no|not)[^a-z].*")

_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul caption".split())
#: Elements whose extent is followed; the others only end a block.
_FOLLOWED = _BLOCKS - frozenset("dt dd hr h1 h2 h3 h4 h5 h6 th tr tbody thead tfoot html head body".split())
#: Tags that end an element whose end tag may be left out, that element, and the elements up to which it is looked for.
_ENDED = {"li": ("li", frozenset("ul ol menu".split()))} | {
    tag: ("td", frozenset(["table"])) for tag in "td th tr tbody thead tfoot".split()}
_NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(_BLOCKS, key=len, reverse=True))})(?=[\s/>])", re.I)
_FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog fieldset search".split())
_FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar note".split())
#: Words in class or id that mark page furniture (fixed values of this module).
_FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notification paywall popup promo promotion recommended related respond replies search share sharing sidebar signup social "
    "sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split())


@dataclass
class Text:
    """A block under construction, then its features."""

    furniture: bool
    article: bool
    parts: list[str] = field(default_factory=list)
    text: str = ""
    words: int = 0
    linked: float = 0


def _dark_end(page: str, dark: str, at: int, ends: dict[str, int]) -> int:
    """Where a dark element ends whose tag ends at `at`; `ends` keeps where its kind is closed next, -1 for nowhere."""
    if ends.get(dark, 0) >= 0:
        m = re.compile(rf"</{dark}\s*>", re.I).search(page, at)
        ends[dark] = m.end() if m else -1
    if ends[dark] >= 0:
        return ends[dark]
    if dark not in ("script", "style"):
        return at  # never closed: it ends at its own tag
    m = _NEXT_BLOCK.search(page, at)
    return m.start() if m else len(page)


def blocks(page: str) -> list[Text]:
    """The text blocks of a page in order."""
    out: list[Text] = []
    # followed elements: tag, furniture by tag, role or whole class name, by part of one (0 to 2), article
    stack: list[tuple[str, bool, int, bool]] = []
    here = Text(False, False)
    links = 0
    wrapped: set[str] = set()  # article and main, once seen
    ends: dict[str, int] = {}

    def finish() -> None:
        nonlocal here
        text = " ".join("".join(here.parts).split())
        if text:
            here.text, here.words = text, text.count(" ") + 1
            out.append(here)
        here = Text(stack[-1][1] or stack[-1][2] > 0, stack[-1][3]) if stack else Text(False, False)

    def add(raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            here.parts.append(text)
            if links:
                here.linked += len(text.split())

    def end(tag: str, limits: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return
            if stack[i][0] in limits:
                return

    at = 0
    while m := _TOKEN.search(page, at):
        add(page[at:m.start()])
        at = m.end()
        if m["raw"] is not None:
            here.parts.append(m["raw"])
            continue
        if m["dark"]:
            at = _dark_end(page, m["dark"].lower(), at, ends)
            if m["dark"].lower() == "title":
                finish()
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing = m["close"] or m["close2"]
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            here.parts.append(" ")
        elif tag in _BLOCKS:
            if closing:
                end(tag, _ENDED[tag][1] if tag in ("li", "td") else frozenset())
                if tag in ("th", "tr", "tbody", "thead", "tfoot"):
                    end(*_ENDED[tag])
                links = 0
                finish()
            else:
                rest = m["rest"] or m["rest2"] or ""
                if stack and stack[-1][0] == "p":
                    stack.pop()
                if tag in _ENDED:
                    end(*_ENDED[tag])
                least = 1
                if tag in ("article", "main") and tag not in wrapped:
                    # the first one and the elements around it are no furniture for a part of a class name
                    wrapped.add(tag)
                    least = 2 if any(b.article and not b.furniture for b in out) else 3
                    stack[:] = [(t, hard, soft * (soft >= least), article) for t, hard, soft, article in stack]
                if tag in _FOLLOWED and not rest.endswith("/"):
                    hard, soft, article = stack[-1][1:] if stack else (False, 0, False)
                    own_hard, own_soft = _is_furniture(tag, rest)
                    stack.append((tag, hard or own_hard, max(soft, own_soft * (own_soft >= least)), article or tag in ("article", "main")))
                finish()
    add(page[at:])
    finish()
    return out


def _is_furniture(tag: str, rest: str) -> tuple[bool, int]:
    """Whether an element is page furniture by tag, role or whole class name, and by parts of one: 2 for others' articles."""
    if tag in _FURNITURE_TAGS:
        return True, 0
    soft = 0
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        value = (a or b or c).lower()
        if name.lower() == "role" and value in _FURNITURE_ROLES or name.lower() == "hidden":
            return True, 0
        if name.lower() == "aria-hidden" and value == "true":
            return True, 0
        if name.lower() in ("class", "id"):
            whole = value.split()
            if not _FURNITURE_WORDS.isdisjoint(whole):
                return True, 0
            for part in (x for w in whole for x in _PART.findall(_WITH.sub("", w))):
                if part in _FURNITURE_WORDS:
                    soft = max(soft, 2 if part in _OTHERS else 1)
    return False, soft


def features(row: list[Text]) -> list[tuple[float, ...]]:
    """One tuple of FEATURES per block; beyond the ends there are empty blocks."""
    plain = [(float(b.words), b.linked / b.words if b.words else 0.0) for b in row]
    around = [(0.0, 0.0), *plain, (0.0, 0.0)]
    outside = -1.0 if any(b.article for b in row) else 0.0
    return [(*around[i + 1], *around[i], *around[i + 2], float(b.furniture), 1.0 if b.article else outside)
            for i, b in enumerate(row)]


#: The labelled table: small pages, block by block, as (words, link density).  N furniture, A text of an article or main element,
#: F furniture inside one, O other blocks beside one, T text and B other blocks of pages without such elements.
EXAMPLES = (
    "N1:1 N1:1 N1:1 N2:1 N9:0 A8:0 A55:0 A1:0 A70:0 A2:0 A9:0 A120:0 N7:0",
    "N2:1 N1:1 N40:0 A3:0 A14:0 A1:0 A33:0.1 F6:0 A44:0 A5:0.4 A2:1 A61:0 N12:0.3",
    "N25:0 N90:0 A6:0 A2:0 N3:1",
    "N1:1 N60:0.1 A1:0 A1:0 A12:0 A5:0 A200:0 F4:1 F30:0 A18:0 A7:0 N33:0",
    "A11:0 A88:0 F18:0 F120:0 F2:0.5 F45:0 N5:0",
    "N4:0.5 A37:0 A29:0 A3:0 A150:0 A66:0 F1:1 F9:0 F75:0 F3:0 N15:0.2",
    "N150:0 A2:0 A20:0.8 A95:0.05 A4:0 N1:0 N50:0",
    "N1:0 N10:0.9 A300:0 N80:0 N35:0",
    "N3:0 A5:0 A1:1 A16:0 A48:0 A9:0.2 A3:0 F55:0.4 A27:0 N2:0",
    "N2:1 N1:1 N8:0 A42:0 N110:0 N9:0.1 N28:1",
    "B1:1 B2:1 B1:1 T60:0 T35:0 T22:0.1 T45:0 B2:1 B3:0",
    "B2:1 B3:1 T18:0 T45:0 T150:0.2 T30:0 B4:1 B5:1 B7:0",
    "B4:0.5 B1:1 T80:0 T9:0 T75:0 T38:0 T6:0 T52:0 B20:0.8 B15:0.9",
    "B3:1 B40:0.7 B9:1 B30:0.6 T70:0 T33:0 T12:0 T41:0.1 B2:1 B5:0.2",
    "N2:1 N1:1 T90:0 T28:0 T64:0 B1:1 B3:0.5 N6:0",
    "T2:0 T4:0 T12:0 T5:0 T1:0 T4:0 B2:1", "T2:0 T1:0", "T3:0", "T1:0",
    "B1:1 B1:1 T2:0 T60:0", "B2:1 T3:0 T45:0", "B4:1 B5:1 T3:0 T30:0", "B6:1 T2:0 T25:0", "B4:1 T9:0 T30:0", "B1:1 T1:0 T20:0",
    "B1:1 B2:0", "B3:1 B2:0", "B5:1 B4:0", "B1:1 B8:0", "B5:1 B6:0", "B2:1 B1:0",
    "B1:1 B1:1 T5:0 T60:0 T4:0 T50:0 B2:1", "B1:1 T4:0 T30:0 T2:0 T1:0", "B2:1 B3:0", "B1:1 B1:1 T25:0", "B1:1 T15:0", "B2:1 T90:0", "B1:1 B1:1 T6:0 T70:0 B1:1 B2:0",
    "B1:1 B6:1 T25:0 T19:0 T55:0 B12:1 B14:0.6 N44:0",
    "N1:1 N2:1 A8:0 A30:0", "A9:0", "A3:0 A1:0", "A1:0 A40:0 A60:0 A2:0", "N20:0 A4:0 A5:1", "A2:1",
    "O12:0 A8:0 A40:0 O30:0", "O9:0 N4:0 A2:0 A70:0 A25:0 O60:0 O3:1", "O45:0.1 A15:0 A80:0 O8:0 N11:0",
    "T40:0 T60:0", "T30:0", "B2:1 T50:0 T20:0", "T25:0 T15:0", "T8:0 T45:0 T16:0",
)


def table(examples: tuple[str, ...] = EXAMPLES) -> list[tuple[float, ...]]:
    """FEATURES and label of every block of the labelled pages."""
    rows = []
    for page in examples:
        marks = page.split()
        made = []
        for mark in marks:
            words, links = mark[1:].split(":")
            made.append(Text(mark[0] in "NF", mark[0] in "AF", text=mark, words=int(words), linked=float(links) * int(words)))
        rows += [(*x, float(m[0] in "AT")) for x, m in zip(features(made), marks)]
    return rows


@dataclass(frozen=True)
class Tree:
    """A fitted tree as nested tuples (feature, threshold, low side, high side), leaves 0 or 1."""

    root: object

    def judge(self, row: tuple[float, ...]) -> bool:
        node = self.root
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node == 1


def fit(spark: SparkSession, examples: tuple[str, ...] = EXAMPLES) -> Tree:
    """The decision tree of the labelled table (under 300 rows, whatever the size of the pages)."""
    rows = spark.createDataFrame(table(examples), [*FEATURES, "label"]).coalesce(1)
    points = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = DecisionTreeClassifier(maxDepth=12, maxBins=512, minInstancesPerNode=1, seed=1).fit(points)

    def read(node):
        if node.numDescendants() == 0:
            return int(node.prediction())
        split = node.split()
        return (split.featureIndex(), split.threshold(), read(node.leftChild()), read(node.rightChild()))

    return Tree(read(model._call_java("rootNode")))


def main_text(page: str | None, tree: Tree) -> str:
    row = blocks(page or "")
    return "\n\n".join(b.text for b, x in zip(row, features(row)) if tree.judge(x))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = fit(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            texts = [main_text(h.as_py(), tree) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
