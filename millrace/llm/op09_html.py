"""Main text of web pages by tree scoring.

The markup is read into a tree. Each paragraph earns points for its length and its commas and passes them to its
ancestors, less at each level up; a container's points are discounted by the share of its text that stands in links.
The best container and those of its siblings that look like more of the same are kept, in page order.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import small_batches

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed values of HTML: elements without content, elements whose content isn't markup, blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
CLOSES_P = BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SELF_CLOSING = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
# Elements whose content is no text of the page, and those that never hold the article.
NO_TEXT = frozenset("script style noscript template textarea title xmp noembed noframes iframe head".split())
DROPPED = NO_TEXT | frozenset("nav footer aside form button select option input label svg canvas object embed dialog menu audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Words in class or id that mark what isn't the article; the second list gives way to a word of the third.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist disqus reply replies respond cookie cookies consent gdpr nav navbar navigation menu breadcrumb breadcrumbs footer newsletter subscribe signup login popup modal social share sharing pagination pager skip".split()
)
SELDOM = frozenset("sidebar side aside header masthead banner notice notices alert widget related recommended recommendations toolbar search meta tags tagcloud".split())
CONTENT = frozenset("article content main body post entry story text column page wrapper container layout with".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd figcaption h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WEIGHT = {"article": 25, "main": 10, "section": 3, "div": 5, "blockquote": 3, "pre": 3, "td": 3, "ul": -3, "ol": -3, "dl": -3, "address": -3, "body": 0, "html": -10}


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "score", "size", "linked", "commas")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list = []  # nodes and strings
        self.score = 0.0
        self.size = self.linked = self.commas = 0


def parse(html: str) -> Node:
    """A tree from any markup: unclosed and stray tags are mended the way browsers do for common cases."""
    root = at = Node("#root")
    pos, end = 0, len(html)
    while pos < end:
        m = _TAG.search(html, pos)
        if not m:
            at.kids.append(unescape(html[pos:]))
            break
        if m.start() > pos:
            at.kids.append(unescape(html[pos : m.start()]))
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            node = at
            while node.parent and node.tag != tag:
                node = node.parent
            if node.parent:
                at = node.parent
            continue
        if tag in CLOSES_P:
            at = _close(at, ("p",), {"button", "td", "th", "table", "article"})
        if tag in SELF_CLOSING:
            names, within = SELF_CLOSING[tag]
            at = _close(at, names.split(), within)
        node = Node(tag, m[3], at)
        at.kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, pos)
            pos = close.end() if close else end
        elif tag not in VOID and not m[3].endswith("/"):
            at = node
        elif tag not in VOID:
            at = node  # a slash on other elements says nothing
    return root


def _close(at: Node, names, within) -> Node:
    node = at
    while node.parent and node.tag not in within:
        if node.tag in names:
            return node.parent if node.tag != "tr" or "tr" in names else at
        node = node.parent
    return at


def unwanted(node: Node) -> bool:
    tag = node.tag
    if tag in DROPPED:
        return True
    if tag == "header":
        up = node.parent
        while up and up.tag not in ("article", "main"):
            up = up.parent
        return up is None
    if not node.attrs or tag in ("html", "body"):
        return False
    names: list[set[str]] = []
    for m in _ATTR.finditer(node.attrs):
        name = (m[1] or m[5]).lower()
        value = next((g for g in m.group(2, 3, 4) if g is not None), "")
        if name in ("class", "id"):
            names += [{w.lower() for w in _PART.findall(x)} for x in value.split()]
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    # A name that says nothing else decides; in a longer one (has-comments) it gives way to a name of content.
    content = any(n and n <= CONTENT for n in names)
    if any(n and n <= NEVER for n in names) or not content and any(n & NEVER for n in names):
        return True
    return tag not in ("article", "main") and any(n & SELDOM for n in names) and not any(n & CONTENT for n in names)


def prune(root: Node, by_names: bool = True, elements: frozenset = DROPPED) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        node.kids = [k for k in node.kids if isinstance(k, str) or not (unwanted(k) if by_names else k.tag in elements)]
        for k in node.kids:
            if by_names and not isinstance(k, str) and k.tag == "header":
                k.kids = [h for h in ordered(k) if h.tag in HEADINGS]  # of an article's own header, its title
        todo += [k for k in node.kids if not isinstance(k, str)]


def ordered(root: Node) -> list[Node]:
    """Nodes, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return out


def score(root: Node) -> list[Node]:
    nodes = ordered(root)
    for node in nodes:
        node.score = WEIGHT.get(node.tag, 0)
    for node in reversed(nodes):
        own = [k for k in node.kids if isinstance(k, str)]
        node.size += sum(len(k.strip()) for k in own)
        node.commas += sum(k.count(",") for k in own)
        if node.tag == "a":
            node.linked = node.size
        if node.parent:
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.commas += node.commas
    for node in nodes:
        direct = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        if node.tag in PARAGRAPHS and node.size or node.tag in ("div", "section", "article", "main", "body") and direct >= 25:
            points = 1 + node.commas + min(node.size / 100, 3) if node.tag in PARAGRAPHS else 1 + min(direct / 100, 3)
            points *= 1 - node.linked / max(1, node.size)
            up, level = node if node.tag not in PARAGRAPHS else node.parent, 0
            while up is not None and level < 5:
                up.score += points / (1 if level == 0 else 2 if level == 1 else level * 3)
                up, level = up.parent, level + 1
    for node in nodes:
        if node.score > 0:
            node.score *= 1 - node.linked / max(1, node.size)
    return nodes


def flatten(node: Node, out: list[str]) -> None:
    todo: list = [node]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag in BLOCKS:
            out.append(" ")
            todo.append(" ")
            todo += reversed(k.kids)
        else:
            todo += reversed(k.kids)


def extract(html: str | None) -> str:
    """The main text, blocks joined by single spaces; empty for a null or empty page or one without text."""
    if not html:
        return ""
    # Where names hide all of the text, only elements decide.
    return _extract(html, True) or _extract(html, False)


def extract_by_score(html: str | None) -> str:
    """The same by the scores alone: nothing but scripts, styles and the like is taken out before."""
    return _extract(html or "", False, NO_TEXT)


def _extract(html: str, by_names: bool, elements: frozenset = DROPPED) -> str:
    root = parse(html)
    prune(root, by_names, elements)
    nodes = score(root)
    places = [n for n in nodes if n.tag in ("article", "main", "section", "div", "body", "td", "blockquote", "pre", "center", "html", "#root")]
    best = max(places, key=lambda n: n.score)  # the first of equals
    kept = [best]
    if best.parent:
        least = max(10.0, 0.2 * best.score)
        kept = []
        for k in best.parent.kids:
            if isinstance(k, str):
                continue
            density = k.linked / max(1, k.size)
            if k is best or k.score >= least and k.tag in ("article", "section", "div", "main") or k.tag in ("p", "pre", "blockquote") and (k.size > 80 and density < 0.25 or 0 < k.size <= 80 and not density and k.commas):
                kept.append(k)
    out: list[str] = []
    for k in kept:
        flatten(k, out)
        out.append(" ")
    return " ".join("".join(out).split())


def main_text(pages: DataFrame, html: str = "html", **keep: str) -> DataFrame:
    """pages with `text` (main text of html) and `n_chars` (its code points); html itself is dropped.

    A null or empty page gives an empty text; a page may be of any length. Pages stay rows of their own, whatever they
    repeat, and where scores are equal the first container counts. An empty table gives no rows. Columns named text or
    n_chars are replaced, all others stay.
    """
    small_batches(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            texts = [extract(h) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*others, "text", "n_chars"],
            )

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "text string", "n_chars long"])
    return pages.select(*others, html).mapInArrow(run, schema)


def op9_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html")))
