"""Main text of web pages, without the template of their site.

Each page becomes a tree of elements. Every element outside the text blocks has the hash of its subtree (tags, classes and text). Spark
counts for each host on how many pages with different text a subtree occurs; one that is on ``PAGES`` of them or more, and on ``SHARE`` of the
host's, is part of the template and goes, with all that is in it. So do elements whose kind, role or class says that they are
navigation, headers, footers, sidebars, notices, adverts, forms or reader comments, which also catches templates whose text
changes from page to page and hosts of few pages. What is left of the article (``main``, else ``article``, else the body) is the text:
its blocks in order, one per line.

Inside the article a recurring subtree goes so if most of its text is links. Other blocks and paragraphs there must be on ``INNER_SHARE``
of the host's pages, since passages that several pages quote are content; copies of a whole page have the same text, so they count
once. Headings, list items and table cells go with the block they are in, not alone: they are labels that pages share. Without an
article the page's blocks count as outside one, and single paragraphs stay.

Defined cases: null and empty pages have empty text; broken markup is read as browsers do in the common cases (open elements end
with their parents, paragraphs and list items end where the next one begins); a url without a host, or null, is a host of its own;
rows without an id keep none; equal rows give equal results; very deep markup is read without recursion; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as markup
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import NO_ID, own_id, short_batches, table
from vigil.llm.registry import query
from vigil.streaming.storage import written

#: A subtree of the template is on so many pages of its host, and on this share of them.
PAGES = 5
SHARE = 0.02
#: Inside the article, unless it is mostly links, on this share.
INNER_SHARE = 0.5

# fixed values: element and class names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption".split())
DROPPED = frozenset(
    "head script style noscript template iframe object svg canvas audio video map nav footer aside form button input select option textarea "
    "label fieldset dialog menu title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription signup login sidebar side widget widgets nav navbar navigation menu menus breadcrumb "
    "breadcrumbs pagination pager footer foot masthead topbar comment comments commentlist disqus respond reply replies share sharing social "
    "related recommended recommendations toolbar search searchform skip toc".split()
)
HEADS = frozenset("header head".split())
ROOTS = frozenset("html body main article".split())
#: What an opening tag ends if it is open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS |= {name: {"p"} for name in BLOCKS if name not in ("body", "html", "option", "optgroup", "tbody", "thead", "tfoot", "tr", "td", "th", "dt", "dd", "li")}
#: Elements beyond which such an end doesn't reach.
HOLDS = frozenset("ul ol dl table td th div section article main aside nav header footer form body button".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s>/]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s>/]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"']+)))?")
PART = re.compile(r"[A-Za-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("children", "hash", "linked", "name", "parent", "size", "words")

    def __init__(self, name: str, parent: Node | None, attributes: dict[str, str]):
        self.name, self.parent, self.children = name, parent, []
        self.words = attributes
        self.hash = self.size = self.linked = 0


def tree(page: str) -> Node:
    root = at = Node("", None, {})
    place, end = 0, len(page)
    while place < end:
        found = TOKEN.search(page, place)
        # a sign that opens no tag is text; the pattern itself goes on behind it
        start = found.start() if found else end
        if start > place:
            at.children.append(markup.unescape(page[place:start]))
        if not found:
            break
        place = found.end()
        if found[1]:
            name, node = found[1].lower(), at
            if name == "br":
                at.children.append(" ")
            while node is not None and node.name != name:
                # the end of an inline element doesn't end the block around it
                node = None if name not in BLOCKS and node.name in BLOCKS else node.parent
            if node is not None and node.parent is not None:
                at = node.parent
        elif found[2]:
            name = found[2].lower()
            attributes = {}
            if found[3] and not found[3].isspace():
                for m in ATTRIBUTE.finditer(found[3]):
                    attributes.setdefault(m[1].lower(), markup.unescape(m[2] or m[3] or m[4] or ""))
            if name in ("html", "body") and any(x == name for x in _open(at)):
                continue
            closes = ENDS.get(name)
            if closes:
                node = at
                while node.parent is not None and node.name not in closes and node.name not in HOLDS:
                    node = node.parent
                if node.name in closes:
                    at = node.parent
            node = Node(name, at, attributes)
            at.children.append(node)
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s>/]|\Z)[^>]*>?", re.I).search(page, place)
                place = stop.end() if stop else end
            elif name not in VOID and not (found[3] or "").endswith("/"):
                at = node
    return root


def _open(node: Node | None):
    while node is not None:
        yield node.name
        node = node.parent


def hashed(root: Node) -> None:
    """Hash, size of the text and size of the linked text of each subtree, from the leaves up."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        parts = [node.name, node.words.get("class", ""), node.words.get("id", "")]
        for child in node.children:
            if isinstance(child, Node):
                parts.append(str(child.hash))
                node.size += child.size
                node.linked += child.size if child.name == "a" else child.linked
            elif text := " ".join(child.split()):
                parts.append(text)
                node.size += len(text)
        node.hash = xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def unwanted(node: Node, inside: bool) -> bool:
    """Whether the kind, role or class of an element says that it isn't part of an article."""
    if node.name in DROPPED:
        return True
    if node.name == "header":
        return not inside
    if not node.words or node.name in ROOTS and node.name != "article":
        return False
    words = node.words
    if "hidden" in words or words.get("aria-hidden", "").lower() == "true" or HIDDEN.search(words.get("style", "")):
        return True
    if words.get("role", "").lower() in ROLES:
        return True
    names = {x.lower() for x in PART.findall(f"{words.get('class', '')} {words.get('id', '')}")}
    return bool(names & NAMES) or (not inside and bool(names & HEADS))


def articles(root: Node) -> list[Node]:
    """``main`` elements, else outermost articles, else the page."""
    found: dict[str, list[Node]] = {"main": [], "article": []}
    stack = [(root, False, False)]
    while stack:
        node, main, article = stack.pop()
        if node.parent is not None and unwanted(node, main or article):
            continue
        is_main = node.name == "main" or node.words.get("role", "").lower() == "main"
        if is_main and not main:
            found["main"].append(node)
        if node.name == "article" and not article:
            found["article"].append(node)
        stack += [(c, main or is_main, article or node.name == "article") for c in reversed(node.children) if isinstance(c, Node)]
    return found["main"] or found["article"] or [root]


def candidates(root: Node, tops: list[Node]) -> list[tuple[int, bool]]:
    """Hashes of the subtrees that may belong to a template; whether only by ``INNER_SHARE``."""
    found, inner = [], {id(t) for t in tops}
    around = {id(x) for t in tops for x in _around(t)}
    whole = root is tops[0]
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or id(node) in inner
        if node.parent is not None and id(node) not in around:
            if _may_go(node, inside and not whole):
                found.append((node.hash, False))
            elif inside and not whole and _may_recur(node):
                found.append((node.hash, True))
        stack += [(c, inside) for c in node.children if isinstance(c, Node) and c.name not in RAW]
    return found


def _around(node: Node):
    while node is not None:
        yield node
        node = node.parent


def _may_go(node: Node, inside: bool) -> bool:
    if node.name in TEXT_BLOCKS or node.name not in BLOCKS or not node.size:
        return False
    return not inside or 2 * node.linked > node.size


def _may_recur(node: Node) -> bool:
    return bool(node.size) and (node.name == "p" or node.name in BLOCKS and node.name not in TEXT_BLOCKS)


def main_text(root: Node, tops: list[Node], template: set[int], common: set[int] | frozenset = frozenset()) -> str:
    """``common``: subtrees that go inside the article although they aren't mostly links."""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    whole = tops[0] is root
    for top in tops:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif x.name == "br":
                line.append(" ")
            elif x is not top and (unwanted(x, not whole) or (x.hash in template and _may_go(x, not whole)) or (x.hash in common and not whole and _may_recur(x))):
                # what goes may have stood between two blocks
                if x.name in BLOCKS:
                    end()
            else:
                block = x.name in BLOCKS
                if block:
                    end()
                    stack.append(None)
                stack += reversed(x.children)
        end()
    return "\n".join(blocks)


def host(url: str) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url)
    return m[1].lower() if m else ""


def extracted(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``page_id``, ``url``, ``text`` of each page. ``pages``: page_id, url, html."""
    short_batches(pages.sparkSession)
    rows = pages.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("crc", F.crc32(F.col("html").cast("binary")))

    def survey(batches):
        """(host, subtree, whether inside the article, text of the page) once per page."""
        for batch in batches:
            out = []
            for page, crc, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "crc", "url", "html")), strict=True):
                root = tree(html)
                hashed(root)
                tops = articles(root)
                text = xxhash.xxh3_64_intdigest(main_text(root, tops, set())) - (1 << 63)
                out += [(page, crc, host(url or ""), h, inner, text) for h, inner in dict.fromkeys([(0, False), *candidates(root, tops)])]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "crc", "host", "subtree", "inner", "text"])

    seen = written(rows.mapInArrow(survey, "page_id long, crc long, host string, subtree long, inner boolean, text long"), "subtrees")
    # subtree 0 stands for the page: how many different texts the host has
    counts = seen.select("host", "subtree", "inner", "text").distinct().groupBy("host", "subtree", "inner").agg(F.count("*").alias("n"))
    counts = written(counts.where(F.col("n") >= PAGES), "counts")
    whole = counts.where("subtree = 0").select("host", F.col("n").alias("pages"))
    least = F.col("pages") * F.when(F.col("inner"), INNER_SHARE).otherwise(SHARE)
    template = counts.where("subtree <> 0").join(whole, "host").where(F.col("n") >= least).select("host", "subtree", "inner")
    of_page = seen.join(template, ["host", "subtree", "inner"]).groupBy("page_id", "crc").agg(
        F.collect_set(F.when(~F.col("inner"), F.col("subtree"))).alias("template"), F.collect_set(F.when(F.col("inner"), F.col("subtree"))).alias("common")
    )
    told = rows.join(written(of_page, "templates"), ["page_id", "crc"], "left")

    def extract(batches):
        for batch in batches:
            out = []
            for html, template, common in zip(*(batch.column(c).to_pylist() for c in ("html", "template", "common")), strict=True):
                root = tree(html)
                if template or common:
                    hashed(root)
                out.append(main_text(root, articles(root), set(template or ()), set(common or ())))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return told.select("page_id", "url", "html", "template", "common").mapInArrow(extract, "page_id long, url string, text string")


@query("op2_template_removal")
def template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's main text and its length."""
    return extracted(table(spark, sf_dir, "pages")).select(own_id("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
