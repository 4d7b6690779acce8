"""Main text of HTML pages by tree scoring.

The page becomes a tree of elements (one scan with one pattern; unclosed and
misnested tags are closed as browsers do for the elements that matter here).
Elements that never hold the article are dropped: scripts, styles, forms,
navigation, headers, footers, asides, dialogs, hidden parts, and whatever its
class, id or role names as menu, notice, advert, sidebar, comments and so on.

Every paragraph-like block earns points for its length and its commas and passes
them to its ancestors: all to the parent, half to the grandparent, a quarter to
the next, and so on, summed from the leaves up. A container's points are
discounted by its link density. Where the page has an ``article`` or ``main``
with text of its own, the best of those is the container; else the best scored
element is kept, and those of its siblings that score near it, or are plain
paragraphs with few links, are kept with it, in page order.

A class or id drops an element only if it names one of the kinds that never hold
article text (:data:`NAMED`); names that merely make it unlikely (:data:`UNLIKELY`)
lower its score, and drop it only if it is mostly links. Every step is one pass
over the elements, so deep and long pages cost time in proportion to their size.

Defined results: null or blank html gives an empty text; a page without any
paragraph gives the text of its body outside dropped parts unless that is mostly
links; cut-off pages and tags are read as far as they go; a quote in a tag opens a
value only after ``=``, and a value that is never closed ends with its tag; repeated
rows give repeated results; white space inside a block becomes one space, blocks are joined by one newline; character references
are decoded, unknown ones stay as they are. Memory is bounded by the page. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names by what they mean for extraction.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "noscript", "template", "title", "xmp", "iframe", "noembed", "noframes", "plaintext")
DROPPED = frozenset("""script style textarea noscript template title xmp iframe noembed noframes head nav footer aside form
button select option input label fieldset dialog menu menuitem object embed applet canvas svg audio video map datalist
output progress meter""".split())
BLOCK = frozenset("""html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table caption thead
tbody tfoot tr td th header footer nav aside form address center details summary figcaption fieldset hr hgroup search""".split())
PARAGRAPH = frozenset("p pre blockquote td li dd dt h1 h2 h3 h4 h5 h6".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("html body article main section div td blockquote center".split())
CLOSES_P = BLOCK - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}
INLINE_FORMAT = frozenset("a b i u s em strong small big font span code tt q cite abbr sub sup mark del ins strike kbd samp var time".split())
CROSSING = frozenset("table tr tbody article main body html section div".split())
LIMITS = frozenset("td th article main body".split())
# Words in a class or id. The first names what is never article text, the second what seldom is.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|crumbs?|sidebar\w*|footer|masthead|topbar|header"
    r"|cookies?|consent|gdpr|notices?|popup|newsletter|subscribe|subscription|signup|login"
    r"|comments?|commentlist|replies|respond|disqus|pagination|pager)(?:$|[\s_\d-])",
    re.IGNORECASE,
)
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:side|rail|foot|alert|notification|modal|overlay|share|sharing|social|related|recommend\w*|reply|discussion|skip|toolbar|widget\w*|search\w*"
    r"|hidden|copyright|legal|disclaimer)(?:$|[\s_\d-])",
    re.IGNORECASE,
)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|main|story|body|text|page)(?:$|[\s_-])", re.IGNORECASE)
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar note".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)(?:>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


class Node:
    """An element: ``chars`` and ``links`` count the text below it and that in links, ``points`` and ``score`` rate it."""

    __slots__ = ("tag", "parent", "children", "attrs", "dropped", "within", "unlikely", "kept", "chars", "links", "points", "score")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node | str] = []
        self.dropped = self.unlikely = self.kept = False
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))
        self.chars = self.links = 0
        self.points = self.score = 0.0


def attributes(raw: str) -> dict[str, str]:
    """Attribute names in lower case, first value wins."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def judge(node: Node) -> None:
    """Mark an element that never holds article text as dropped, one that seldom does as unlikely."""
    tag = node.tag
    if tag in DROPPED:
        node.dropped = True
        return
    if tag == "header":
        # the header of an article may hold its title; a page's own header does not
        node.dropped = not node.within
        return
    if not node.attrs.strip() or tag in ("html", "body"):
        return
    attrs = attributes(node.attrs)
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.IGNORECASE):
        node.dropped = True
        return
    if attrs.get("role", "").lower() in ROLES:
        node.dropped = True
        return
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if tag in ("article", "main"):
        node.dropped = bool(re.search(r"comment|reply|related|promo", named, re.IGNORECASE))
        return
    if not named.strip():
        return
    surely = re.search(r"comment|sidebar|foot|nav|menu|\bads?\b|advert|cookie|share|related", named, re.IGNORECASE)
    likely = LIKELY.search(named) and not surely
    node.dropped = bool(NAMED.search(named)) and not likely
    node.unlikely = bool(UNLIKELY.search(named)) and not likely


def parse(page: str) -> tuple[Node, list[Node]]:
    """The element tree, judged, and its elements in page order (parents before children)."""
    root = Node("#root", None)
    nodes = [root]
    open_: dict[str, int] = {}  # open elements by name, so that a tag that closes nothing costs no search
    at, end, here = 0, len(page), root

    def leave(to: Node) -> Node:
        nonlocal here
        while here is not to:
            open_[here.tag] -= 1
            here = here.parent
        return here

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if open_.get(tag):
                leave(_close(here, tag))
            continue
        if (tag in CLOSES_P and any(map(open_.get, CLOSED))) or (tag in IMPLIED and any(map(open_.get, IMPLIED[tag][0]))):
            leave(_implied_close(here, tag))
        node = Node(tag, here, m[3] or "")
        judge(node)
        node.dropped = node.dropped or here.dropped
        here.children.append(node)
        nodes.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        here = node
        open_[tag] = open_.get(tag, 0) + 1
    return root, nodes


def _close(here: Node, tag: str) -> Node:
    """The open element after ``</tag>``: inline tags do not close blocks, blocks do not close a cell or article."""
    node = here
    while node.parent is not None and node.tag != tag:
        if tag in INLINE_FORMAT and node.tag in BLOCK:
            return here
        if node.tag in LIMITS and tag not in CROSSING:
            return here
        if node.tag in ("article", "main") and tag in ("div", "section"):
            return here
        node = node.parent
    return here if node.parent is None else node.parent


# An opening tag closes an open one of these, up to the given limits.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ("html",))}


CLOSED = ("p", *sorted(HEADING))  # what the start of a block may close


def _implied_close(here: Node, tag: str) -> Node:
    if tag in CLOSES_P:
        node = here
        while node.parent is not None and (node.tag == "p" or node.tag in INLINE_FORMAT or node.tag in HEADING):
            if node.tag == "p" or (node.tag in HEADING and tag in HEADING):
                return node.parent
            node = node.parent
    if tag in IMPLIED:
        ends, limits = IMPLIED[tag]
        node = here
        while node.parent is not None and node.tag not in limits:
            if node.tag in ends:
                return node.parent
            node = node.parent
    return here


def blocks_of(node: Node) -> list[tuple[str, Node, int]]:
    """(text, block element, characters in links) of every block below, in page order."""
    out: list[tuple[str, Node, int]] = []
    text: list[str] = []
    linked = 0
    owner = node

    def flush() -> None:
        nonlocal text, linked
        joined = SPACE.sub(" ", "".join(text)).strip()
        if joined:
            out.append((joined, owner, min(linked, len(joined))))
        text, linked = [], 0

    stack: list[tuple[Node, int, bool, Node]] = [(node, 0, False, node)]
    while stack:
        here, at, in_link, block = stack.pop()
        children = here.children
        descended = False
        while at < len(children):
            child = children[at]
            at += 1
            if isinstance(child, str):
                child = html.unescape(child) if "&" in child else child
                text.append(child)
                if in_link:
                    linked += len(child)
                continue
            if child.dropped:
                if child.tag in BLOCK:
                    flush()
                continue
            if child.tag in ("br", "hr"):
                if child.tag == "hr":
                    flush()
                else:
                    text.append(" ")
                continue
            stack.append((here, at, in_link, block))
            if child.tag in BLOCK:
                flush()
                owner = child
                stack.append((child, 0, in_link, child))
            else:
                stack.append((child, 0, in_link or child.tag == "a", block))
            descended = True
            break
        if not descended and (here.tag in BLOCK or here is node):
            flush()
            owner = stack[-1][3] if stack else node
    flush()
    return out


def points_of(text: str, block: Node, links: int) -> float:
    """What a block earns; short ones earn nothing unless they are headings."""
    if len(text) < 25 and block.tag not in HEADING:
        return 0.0
    return (1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3)) * (1 - links / len(text))


def score(blocks: list[tuple[str, Node, int]], nodes: list[Node]) -> None:
    """Points, text sizes and scores of all elements, summed from the last element to the first."""
    for text, block, links in blocks:
        block.chars += len(text)
        block.links += links
        to = block if block.tag in CONTAINER or block.parent is None else block.parent
        to.points += points_of(text, block, links)
    for n in reversed(nodes):  # children come after their parents
        bonus = 1.25 if n.tag in ("article", "main") or (n.attrs and LIKELY.search(n.attrs)) else 1.0
        n.score = n.points * bonus * (0.25 if n.unlikely else 1.0) * (1 - n.links / max(1, n.chars))
        if n.parent is not None:
            n.parent.points += n.points / 2
            n.parent.chars += n.chars
            n.parent.links += n.links


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page or not page.strip():
        return ""
    root, nodes = parse(page)
    blocks = blocks_of(root)
    own: dict[int, tuple[int, int]] = {}  # (characters, those in links) of the blocks an element owns itself
    for text, block, links in blocks:
        chars, linked = own.get(id(block), (0, 0))
        own[id(block)] = (chars + len(text), linked + links)
    score(blocks, nodes)
    for n in nodes:
        n.dropped = n.dropped or (n.unlikely and n.chars > 0 and 2 * n.links >= n.chars) or (n.parent is not None and n.parent.dropped)
    blocks = [b for b in blocks if not b[1].dropped]
    if not blocks:
        return ""
    scored = [n for n in nodes if n.points > 0 and not n.dropped]
    main = [n for n in nodes if n.tag in ("article", "main") and not n.dropped and n.chars > 2 * n.links]
    if not scored and not main:
        chars, links = sum(len(b[0]) for b in blocks), sum(b[2] for b in blocks)
        return "" if links > chars / 2 else "\n".join(b[0] for b in blocks)
    if main:
        best = max([n for n in main if n.tag == "article"] or main, key=lambda n: n.score)
        outer = best.parent
        while outer is not None:  # an article in an article is a part of it
            best = outer if outer.tag == "article" else best
            outer = outer.parent
    else:
        best = max(scored, key=lambda n: n.score)  # the first of equals, which page order decides
    best.kept = True
    if best.parent is not None and best.tag not in ("article", "main", "body", "html", "#root"):
        limit = max(10.0, best.score * 0.2)
        for n in best.parent.children:
            if isinstance(n, str) or n.dropped:
                continue
            chars, links = own.get(id(n), (0, 0))
            n.kept = n.kept or n.score >= limit or (n.tag in HEADING and chars > 0 and not links) or (n.tag in PARAGRAPH and chars > 0 and links / chars < 0.25)
    for n in nodes:
        n.kept = n.kept or (n.parent is not None and n.parent.kept)
    return "\n".join(text for text, block, _ in blocks if block.kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    fields = [T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [f.name for f in fields])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, T.StructType(fields))


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
