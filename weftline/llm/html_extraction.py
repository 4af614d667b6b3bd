"""Main text of web pages by tag-path ratios.

A page is read as a list of text nodes, each with its root-to-leaf path of tags. Per path there are two ratios: the text length
of all its nodes and that of one, each weighed by the punctuation of a node. What stands on paths of little text, as
single adverts do, is far below the article by the first, menus and clouds of tags by the second, however many entries
they have. Both are smoothed over the page order, fused with those of the enclosing container (and,
within an article or main element, of that element) and with a factor of ``LOW`` in elements whose kind or names speak
of menus, adverts and the like. Nodes whose ratios are both over their share of the page's best are the content.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table"
    " tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article body div html main section table td".split())
ASIDE = frozenset("aside dialog footer form header label menu nav search".split())
#: Elements whose text isn't on the page, or is part of a control.
UNREAD = frozenset("button head iframe noscript object select svg template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Which open elements an opening tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# fixed values: words in class, id or role that name what is not the article
NOT_ARTICLE = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist complementary consent"
    " contentinfo cookie cookies dialog disqus footer form gdpr header login masthead menu modal nav navbar navigation"
    " newsletter notice notices overlay pager pagination popup promo promotion recommended related replies reply search"
    " share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)

#: Names by which an article is a reader's comment; such articles often carry a number.
COMMENT = frozenset("comment comments commentlist disqus reply replies".split())
#: Words in a name after which it tells what else is on the page: has-sidebar, page-with-header.
ELSEWHERE = frozenset("has is no not with without".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|select|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PARTS = re.compile(r"[^a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: Share of the page's best fused ratio from which a node is content; weights of the neighbours in page order.
THRESHOLD, KERNEL = 0.5, np.array([1.0, 2.0, 4.0, 2.0, 1.0])
#: The share for the ratio of a single node to that of all nodes of a path, as lengths of paragraphs differ more.
DENSITY = 0.3
#: Characters and marks from which on a node counts as a whole paragraph, however long it is.
LONG, MARKS = 200, 3
#: Weight of a node in an element that is named as no article: its path must be so many times better to be content.
LOW = 0.05


def is_other(tag: str, attributes: str) -> bool:
    """Whether an element is a menu, header, advert or the like, by its kind or its names."""
    if tag in ASIDE:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return any(name.rstrip("0123456789-_") in COMMENT for found in NAMES.findall(attributes) for name in "".join(found).lower().split())
    return not NOT_ARTICLE.isdisjoint(name_parts(attributes))


def name_parts(attributes: str) -> set[str]:
    """The words of class, id and role, each name up to a word that speaks of other elements."""
    names = (PARTS.split(name) for found in NAMES.findall(attributes) for name in "".join(found).lower().split())
    return {part for parts in names for part in takewhile(lambda p: p not in ELSEWHERE, parts)}


class Region:
    """An open element whose kind or names say that it isn't the article, with what was read within it."""

    def __init__(self, parent: Region | None, container: bool, comment: bool):
        self.parent, self.container, self.comment = parent, container, comment
        self.chars, self.nested, self.core = 0, False, False


class Reader:
    """Reads a page into text nodes; what is known of the open elements is kept in a tree, so depth costs nothing."""

    def __init__(self):
        self.nodes: list[tuple] = []
        self.regions: list[Region] = []
        self.free_core = False
        self.ids: dict[tuple, int] = {}
        self.tags: list[str] = []
        self.count: Counter = Counter()
        #: Per open element: path, nearest container's path, nearest article or main's, nearest container's but tables, region, hidden, heading.
        self.open: list[tuple] = [(0, 0, None, 0, None, False, False)]
        self.held: list[str] = []

    def flush(self) -> None:
        if self.held:
            path, container, core, outer, region, hidden, heading = self.open[-1]
            if not hidden and (text := " ".join(html.unescape("".join(self.held)).split())):
                wider = () if core is None else (core, outer)
                self.nodes.append((path, container, text, wider, region, heading))
                if region:
                    region.chars += len(text)
            self.held.clear()

    def text(self, s: str) -> None:
        if s and not self.open[-1][5]:
            self.held.append(s)

    def close(self, tag: str) -> None:
        """End the innermost element of a tag, with all within it."""
        while self.count[tag]:
            last = self.tags[-1]
            if last in BLOCK:
                self.flush()
            self.tags.pop()
            self.open.pop()
            self.count[last] -= 1
            if last == tag:
                break

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            if tag != "hr" and tag not in ("html", "body", "head", "title"):
                self.close("p")
            self.flush()
        if tag == "body":
            self.close("head")
        if ended := ENDS.get(tag):
            last = next((t for t in reversed(self.tags) if t in ended or t in ("ul", "ol", "dl", "table", "select")), None)
            if last in ended:
                self.close(last)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            self.text(" " if tag in ("br", "img", "wbr", "input") else "")
            return
        parent, container, core, outer, region, hidden, heading = self.open[-1]
        path = self.ids.setdefault((parent, tag), len(self.ids) + 1)
        if not hidden and tag in CONTAINER:
            self.mark(region, "nested")
        if tag in CONTAINER:
            container = path
            outer = outer if tag in ("table", "td") else path
        other = is_other(tag, attributes)
        if tag in ("article", "main"):
            core = path
            if not other and not hidden:
                self.mark(region, "core")
                self.free_core = self.free_core or region is None
        if other and tag not in BLOCK:
            hidden = True  # a phrase within a block is no node of its own
        elif other and not hidden:
            region = Region(region, tag == "form" or tag in CONTAINER and tag != "article", tag == "article" or not COMMENT.isdisjoint(name_parts(attributes)))
            self.regions.append(region)
        self.tags.append(tag)
        self.count[tag] += 1
        self.open.append((path, container, core, outer, region, hidden or is_hidden(tag, attributes), heading or tag in HEADINGS))

    @staticmethod
    def mark(region: Region | None, what: str) -> None:
        while region and not getattr(region, what):
            setattr(region, what, True)
            region = region.parent

    def weights(self) -> list[float]:
        """1 for each node, or LOW within a region that isn't the page's own wrapper.

        A container or form that holds all articles or, comments aside, containers with more than half of the text
        wraps the page, whatever its names.
        """
        total = sum(len(n[2]) for n in self.nodes)
        for region in reversed(self.regions):
            if region.parent:
                region.parent.chars += region.chars
        for region in self.regions:  # parents come first
            wraps = region.container and (region.core and not self.free_core or region.nested and not region.comment and 2 * region.chars > total)
            region.weight = (region.parent.weight if region.parent else 1.0) if wraps else LOW
        return [n[4].weight if n[4] else 1.0 for n in self.nodes]


def is_hidden(tag: str, attributes: str) -> bool:
    return tag in UNREAD or bool(attributes) and tag not in ("html", "body", "main", "article") and bool(HIDDEN.search(attributes))


def read_page(page: str) -> Reader:
    """The blocks of a page as nodes (path, container path, text, wider paths, region, heading), in page order.

    Within an article or main the wider paths are those of this element and of the nearest container that is no table.
    """
    reader, at = Reader(), 0
    for m in TOKEN.finditer(page):
        reader.text(page[at : m.start()])
        at = m.end()
        if (tag := m[3] or m[6]) is None:
            continue
        tag = tag.lower()
        if not (m[2] or m[5]):
            reader.start(tag, m[4] or m[7] or "")
        elif reader.count[tag]:
            reader.close(tag)
        elif tag in BLOCK:
            reader.flush()
    reader.text(page[at:])
    reader.flush()
    return reader


def main_text(page: str, threshold: float = THRESHOLD) -> str:
    """Blocks of the content paths of one page, joined by newlines; empty if there are none."""
    reader = read_page(page)
    nodes = reader.nodes
    if not nodes:
        return ""
    sums: dict[tuple[int, bool], list[float]] = {}
    for path, container, text, *_ in nodes:
        marks = len(PUNCTUATION.findall(text))
        for key in ((path, False), (container, True)):
            one = sums.setdefault(key, [0.0, 0.0, 0.0])
            one[0], one[1], one[2] = one[0] + len(text), one[1] + marks, one[2] + 1
    weight = np.array(reader.weights())
    kept = np.ones(len(nodes), bool)
    # by path the text as a whole, and the text of a node; both by the punctuation of a node
    for per_node, least in ((False, threshold), (True, threshold * DENSITY)):
        ratio = {k: (min(chars / n, LONG) if per_node else chars) * (1 + min(marks / n, MARKS)) for k, (chars, marks, n) in sums.items()}
        own = np.array([ratio[n[0], False] for n in nodes])
        around = np.array([max(ratio.get((key, True), 0.0) for key in (n[1], *n[3])) for n in nodes])
        padded = np.pad(own * weight, 2, mode="edge")
        smooth = np.convolve(padded, KERNEL / KERNEL.sum(), mode="valid")
        fused = np.maximum(np.sqrt(own * smooth), around)
        for i in range(len(nodes) - 2, -1, -1):  # a heading goes with what it heads
            if nodes[i][5] and weight[i] == weight[i + 1]:
                fused[i] = max(fused[i], fused[i + 1])
        # the best is that of a node without a name against it; where there is none, nothing is content
        kept &= fused * weight >= least * max(fused[weight == 1], default=np.inf)
    return "\n".join(n[2] for n, k in zip(nodes, kept, strict=True) if k)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages(page_id, url, html)``; no shuffle.

    A null html is an empty one and gives an empty text, as does a page without content. Ids and urls may be null
    and come back as they are; repeated rows give repeated results, other columns are ignored.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(extract, SCHEMA)
