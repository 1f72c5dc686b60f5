"""HTML extraction by composite text density.

The page becomes a tree of elements. An element's density is its characters per tag, adjusted for
links: C/T * log_{ln(C*LC/(C-LC) + LCb*C/Cb + e)}(C*T/(LC*LT)), where C, T, LC and LT are the characters, tags, link characters
and link tags below it and Cb, LCb those of the body. The density sum of an element adds up its
children's densities. The path from the body to the densest element gives the threshold (the least
density on it); among the elements at or above it, the one with the greatest sum holds the article.

Formatting inside a block (b, span, br, ...) is no tag of its own here: it would make a bold paragraph denser
than the article around it. Where every other part of the parent is at the threshold too (an article in
sections), the parent is taken instead, as often as that holds.

Elements that never hold article text (scripts, navigation, ...; by tag or ARIA role) are taken out of the tree
beforehand, and so are footers, asides and headers, but for the header of an article that holds a heading. A form, or an element
with a class or an id that names such a part, is taken out unless it can be a wrapper of the article: at most ``LINKED`` of its
characters are in links, and it holds a main element or h1 (the first article where the page has neither) or, where no main or
article stands outside it, ``BULK`` of the page's text. Bulk alone does not keep comments. A class or id names a part if all its words
do, or say where or what kind of box it is (``related-posts``, ``sidebar-left``, but not ``related-work`` or ``side-effects``).

The page is read in one pass that never goes back: tags end at the first > outside quoted values, at the first > at all once
quotes do not pair up, and without any > the rest is text.

Defined results: a null or empty page, or one without text, gives an empty text; broken markup is read
leniently (a missing end tag ends with its parent, a stray end tag is dropped); repeated rows answer
row by row; null ids and urls pass through; pages are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the HTML standard and of common page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
FURNITURE = frozenset(
    "script style noscript template iframe noembed noframes svg math object canvas audio video head title nav footer aside button select "
    "textarea input option label fieldset dialog menu".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption br".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
#: Words that name furniture, and words that stand beside them.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice popup modal newsletter subscribe signup login nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar side widget widgets footer header masthead comment comments commentlist disqus respond replies share sharing social related recommended pagination pager "
    "tags copyright skiplink".split()
)
BESIDE = frozenset(
    "site page main left right top bottom box block container wrapper wrap inner outer list links link bar area section primary secondary global button buttons item items post posts story stories articles form "
    "panel slot unit media icons icon global fixed sticky mobile desktop thread cloud skip".split()
) - {"main", "post"}
WORDS = re.compile(r"[a-z]+")
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A wrapper holds at least BULK of the page's characters, and at most LINKED of its own are in links.
BULK, LINKED = 0.5, 0.5
#: A start tag of these ends an open element of those (before it was closed).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag, without going back: a quote opens a value only after =, and only if it is closed.
REST = re.compile(r"(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+>")
#: One attribute: its whole name, and a value if = follows. Taken one after the other from the left, so nothing inside a value is read as a name.
ATTR = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
ASKED = frozenset("class id role hidden aria-hidden style".split())


#: Elements that count as nodes; all others are formatting of the block that they stand in.
COUNTED = (BLOCKS | {"a"}) - {"br", "hr"}


class Node:
    __slots__ = ("tag", "kids", "out", "named", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, out: bool = False, named: str = ""):
        self.tag, self.kids, self.out, self.named = tag, [], out, named


def names_part(name: str) -> bool:
    """Whether a class or id as a whole names page furniture."""
    words = WORDS.findall(name)
    return any(w in PARTS for w in words) and all(w in PARTS or w in BESIDE for w in words)


def _furniture(tag: str, attrs: str) -> tuple[bool, str]:
    """Whether the element is out at all events, and what names it as furniture."""
    if tag in FURNITURE:
        return True, ""
    named = tag if tag in ("form", "header") else ""
    if not attrs or tag in ("html", "body", "main", "article"):
        return False, named
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name not in ASKED:
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True, ""
        if name == "role" and value.lower() in ROLES:
            return True, ""
        if name in ("class", "id"):
            named += "".join(f" {one}" for one in value.lower().split() if names_part(one))
    return False, named


def prune(root: Node) -> None:
    """Take out the named elements that are no wrapper of the article."""
    nodes = _order(root)
    if not any(x.named for x in nodes):
        return
    heads = {id(x) for x in nodes if x.tag in ("main", "h1")} or {id(x) for x in [x for x in nodes if x.tag == "article"][:1]}
    proper = sum(x.tag in ("main", "article") for x in nodes)
    own = {id(root)}  # what stands in an article or main element
    for x in nodes:
        for k in x.kids:
            if type(k) is Node and (x.tag in ("main", "article") or id(x) in own and x is not root):
                own.add(id(k))
    holds, inner, headed = set(), {}, set()
    for x in reversed(nodes):
        x.chars = x.link_chars = 0
        inner[id(x)] = (x.tag in ("main", "article")) + sum(inner[id(k)] for k in x.kids if type(k) is Node and not k.out)
        for k in x.kids:
            if type(k) is str:
                x.chars += len("".join(k.split()))
            elif not k.out:
                x.chars += k.chars
                x.link_chars += k.chars if k.tag == "a" else k.link_chars
                if id(k) in heads or id(k) in holds:
                    holds.add(id(x))
                if k.tag in HEADINGS or id(k) in headed:
                    headed.add(id(x))
    for x in nodes:
        if x.tag == "header":
            keep = inner[id(x)] > 0 or id(x) in own and id(x) in headed
        elif x.named:
            bulk = x.chars >= BULK * root.chars and inner[id(x)] == proper and not COMMENTS.intersection(WORDS.findall(x.named))
            keep = id(x) in heads or id(x) in holds or bulk
        else:
            continue
        x.out = not keep or x.link_chars > LINKED * x.chars


class Stack:
    """The open elements, with what is open inside the innermost block and inside the innermost list or table."""

    LISTS = frozenset(("ul", "ol", "dl", "table", "select", "menu"))

    def __init__(self, root: Node):
        self.nodes, self.open = [root], {}
        self.blocks, self.in_block, self.in_list = [], [{}], [{}]

    def push(self, node: Node) -> None:
        tag = node.tag
        self.nodes.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in self.LISTS:
            self.in_list.append({})
        else:
            self.in_list[-1][tag] = self.in_list[-1].get(tag, 0) + 1
        if tag in BLOCKS:
            self.blocks.append(len(self.nodes) - 1)
            self.in_block.append({})
        else:
            self.in_block[-1][tag] = self.in_block[-1].get(tag, 0) + 1

    def close(self, tags) -> None:
        """Close elements up to the innermost of these tags, which is open."""
        while True:
            tag = self.nodes.pop().tag
            self.open[tag] -= 1
            if tag in BLOCKS:
                self.blocks.pop()
                self.in_block.pop()
            else:
                self.in_block[-1][tag] -= 1
            if tag in self.LISTS:
                self.in_list.pop()
            else:
                self.in_list[-1][tag] -= 1
            if tag in tags:
                return


def parse(page: str) -> Node:
    """The element tree; text is kept as strings among the children."""
    root = Node("html")
    stack, at, n = Stack(root), 0, len(page)
    nodes, last, paired = stack.nodes, page.rfind(">"), True
    while at < n:
        start = page.find("<", at)
        if start < 0 or last < start:
            nodes[-1].kids.append(page[at:])
            break
        if start > at:
            nodes[-1].kids.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", start):
            end = page.find("]]>", start)
            end = n if end < 0 else end
            nodes[-1].kids.append(page[start + 9 : end])
            at = end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            at = page.find(">", start) + 1
            continue
        m = NAME.match(page, start + 1)
        if m is None:
            nodes[-1].kids.append("<")
            at = start + 1
            continue
        rest = REST.match(page, m.end()) if paired else None
        paired = rest is not None
        at = rest.end() if rest else page.find(">", m.end()) + 1
        attrs = page[m.end() : at - 1]
        tag = m[2].lower()
        if m[1]:
            # A stray end tag is dropped; an inline one doesn't close the blocks around it.
            if stack.open.get(tag) and (tag in BLOCKS or stack.in_block[-1].get(tag)):
                stack.close((tag,))
            continue
        if tag in ("html", "body") and stack.open.get(tag):
            continue
        if tag in ENDS:
            if any(stack.in_list[-1].get(t) for t in ENDS[tag]):
                stack.close(ENDS[tag])
        elif tag in ENDS_P and stack.blocks and nodes[stack.blocks[-1]].tag == "p":
            stack.close(("p",))
        node = Node(tag, *_furniture(tag, attrs))
        nodes[-1].kids.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*+>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        stack.push(node)
    prune(root)
    return root


def _order(root: Node) -> list[Node]:
    """Nodes that can hold text, parents before children."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [k for k in reversed(x.kids) if type(k) is Node and not k.out]
    return out


def main_node(root: Node) -> Node | None:
    """The element with the greatest density sum at or above the threshold of the body path."""
    nodes = _order(root)
    for x in reversed(nodes):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        for k in x.kids:
            if type(k) is str:
                x.chars += len("".join(html.unescape(k).split()))
            elif not k.out:
                x.chars += k.chars
                x.tags += k.tags + (k.tag in COUNTED)
                x.link_chars += k.chars if k.tag == "a" else k.link_chars
                x.link_tags += k.link_tags + (k.tag == "a")
    body = next((x for x in nodes if x.tag == "body"), root)
    if not body.chars:
        body = root
    if not body.chars:
        return None
    share = body.link_chars / body.chars
    for x in nodes:
        c, lc = x.chars, x.link_chars
        if not c:
            x.density = 0.0
            continue
        t, lt = max(x.tags, 1), max(x.link_tags, 1)
        base = math.log(c * lc / max(c - lc, 1) + share * c + math.e)
        ratio = c * t / (max(lc, 1) * lt)
        x.density = c / t * math.log(max(ratio, 1.0)) / max(math.log(base) if base > 1 else 0.0, 1.0)
    for x in reversed(nodes):
        x.total = sum(k.density if k.tag in COUNTED else k.total for k in x.kids if type(k) is Node and not k.out)
    # The body path: from the body down to the densest element.
    up = {id(k): x for x in nodes for k in x.kids if type(k) is Node}
    inside, todo = [], [body]
    while todo:
        x = todo.pop()
        if x.tag in COUNTED or x is body:
            inside.append(x)
        todo += [k for k in x.kids if type(k) is Node and not k.out]
    densest = max(inside, key=lambda x: x.density)
    threshold, x = densest.density, densest
    while x is not body:
        x = up[id(x)]
        threshold = min(threshold, x.density)
    fit = [x for x in inside if x.density >= threshold]
    best = max(fit, key=lambda x: x.total)
    if not best.total:
        return body
    while best is not body:
        outer = up[id(best)]
        if any(k.chars and k.density < threshold for k in outer.kids if type(k) is Node and not k.out and k is not best):
            break
        best = outer
    return best


def blocks(node: Node) -> list[str]:
    """Text of the blocks below a node in page order, white space joined, empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif type(x) is str:
            run.append(x)
        elif not x.out:
            if x.tag in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(x.kids)
    flush()
    return out


def extract(page: str | None) -> str:
    node = main_node(parse(page or ""))
    return "\n".join(blocks(node)) if node else ""


def text_of(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of every page; one pass without a shuffle."""
    chosen = pages.select(*keep, page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py()) for p in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"]
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{kept}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    from ..plans.base import spread
    from .common import table

    return text_of(spread(table(spark, sf_dir, "pages")))
