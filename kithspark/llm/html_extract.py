"""Main text of web pages by composite text density.

A lenient parse gives a tree. What is no text by its kind (scripts, forms, navigation, asides, ...) or by a name that
says so (adverts, cookie notices, sidebars, reader comments) is cut off; the rest is decided by density. For every other
element the text density is its characters per tag, adjusted by the share of link characters and link tags; a density sum
adds the densities of its children. The element with the greatest sum is the main text, whole. The threshold is the
least density on the path from it up to the body: any other subtree at or above it, which holds elements of its own, is
main text too, by the element with the greatest sum in it. No tag or name makes an element main text. Inline elements but
links aren't counted as tags: what they hold belongs to the block around them.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from kithspark.llm.common import small_batches

#: The attributes of a tag up to its end. Quantifiers are possessive, so that a tag without end costs one pass.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_SPACE = re.compile(r"\s+")
_NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
# Names of HTML elements, by how a page's text uses them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr img br picture source".split())
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th")}
WALLS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select", "datalist"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "p": ("table", "td", "th", "caption", "button", "object")}
NEVER_TEXT = RAW | frozenset("head nav footer aside form button select option input datalist svg math canvas audio video object embed applet map dialog menu progress meter frameset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
# Words of class and id names that mark boilerplate. A name counts if it is made of them and of FILLERS alone, so that
# "related-work" or "has-sidebar" don't. Those in AMBIGUOUS also name parts of articles: they never cut off a section or
# heading, and other elements only where at least half of the characters are links, or the text is a line.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored comment comments disqus cookie cookies consent gdpr"
    " sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar newsletter subscribe subscription signup login popup modal".split()
)
AMBIGUOUS = frozenset("promo promotion banner notice notices social share sharing related recommended recommendations reply replies respond widget toolbar skip disclaimer copyright overlay header".split())
FILLERS = frozenset("a the main site page web global top bottom left right user reader readers post posts article articles story stories bar box block list links link area section wrapper container content unit slot form button buttons text item items more by".split())
TOPICAL = frozenset("section h1 h2 h3 h4 h5 h6".split())
LINE = 200
#: Those of them that layouts also give to a wrapper of the whole page: such a wrapper is spared.
LAYOUT = frozenset("ad ads sidebar nav navbar menu header footer widget toolbar social share sharing related topbar masthead promo banner".split())
HARD, SOFT, MAYBE = 1, 2, 3


class Node:
    __slots__ = ("tag", "parent", "items", "cut", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, cut: int = 0):
        self.tag, self.parent, self.items, self.cut = tag, parent, [], cut


def _boilerplate(tag: str, attributes: str, inside: bool) -> int:
    """inside: within an article or the main part, where a header belongs to the text."""
    if tag in NEVER_TEXT or tag == "header" and not inside:
        return HARD
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    out = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return HARD
        if name == "role" and value.lower() in ROLES or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HARD
        if name in ("class", "id"):
            for word in value.split():
                parts = {p.lower() for p in _NAME_PART.findall(word)}
                known = parts & BOILERPLATE
                maybe = parts & AMBIGUOUS if tag not in TOPICAL else frozenset()
                if not known and not maybe or parts - known - maybe - FILLERS:
                    continue
                if known - LAYOUT:
                    return HARD
                out = SOFT if known else out or MAYBE
    return out


def parse(page: str) -> Node:
    """A tree of elements and strings; end tags that are left out or wrong are made up for as browsers do."""
    root = now = Node("html", None)
    at, low = 0, None
    inside = 0
    for_close = ("article", "main")
    stack_has: dict[str, int] = {}

    def leave() -> None:
        nonlocal now, inside
        stack_has[now.tag] -= 1
        inside -= now.tag in for_close
        now = now.parent

    def close_to(tags: tuple[str, ...], walls: tuple[str, ...]) -> None:
        """Leave the nearest open element of these tags, unless a wall stands before it."""
        if not any(stack_has.get(t) for t in tags):
            return
        x = now
        while x.parent is not None and x.tag not in tags:
            if x.tag in walls:
                return
            x = x.parent
        if x.parent is None:
            return
        stop = x.parent
        while now is not stop:
            leave()

    text_from, last = 0, page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), start):
            end = page.find("-->", start + 4) + 3 if page.startswith("<!--", start) else page.find(">", start) + 1
            if end < 3 and not page.startswith("<!--", start):
                at = start + 1
                continue
            own, attributes = "", ""
            end = end if end >= 3 else len(page)
        else:
            name = _NAME.match(page, start + 1)
            rest = _REST.match(page, name.end()) if name and name.end() <= last else None
            if rest is None:
                at = start + 1
                continue
            own, attributes, end = name[0].lower(), rest[1], rest.end()
        if start > text_from:
            now.items.append(page[text_from:start])
        at = text_from = end
        if not own:
            continue
        tag = own.lstrip("/")
        if own[0] == "/":
            if tag in ("html", "body") or not stack_has.get(tag):
                if tag == "p":
                    now.items.append("\n")
                    now.items.append(Node("p", now))
                continue
            x = now
            while x.tag != tag:
                if tag in INLINE and x.tag not in INLINE or x.tag in ("table", "td", "th") and tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot") and x.tag != tag and tag in INLINE | {"p", "li"}:
                    break
                x = x.parent
            else:
                stop = x.parent
                while now is not stop:
                    leave()
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", close.end()) + 1 if close else 0
            at = text_from = end or len(page)
            continue
        if tag == "html":
            continue
        if tag in P_ENDS:
            close_to(("p",), WALLS["p"])
        if tag in OWN_KIND:
            close_to(OWN_KIND[tag], WALLS[tag])
        if tag == "body":
            close_to(("head",), ())
        node = Node(tag, now, _boilerplate(tag, attributes, bool(inside)))
        now.items.append(node)
        if tag not in VOID and not (attributes.endswith("/") and tag not in INLINE | P_ENDS):
            now = node
            stack_has[tag] = stack_has.get(tag, 0) + 1
            inside += tag in for_close
    if text_from < len(page):
        now.items.append(page[text_from:])
    return root


def _spare(root: Node) -> None:
    """Of what names have cut off: a wrapper of an article or of most of the page's text isn't boilerplate after all, nor
    is an element of an ambiguous name that holds more than links or a line of text."""
    every, todo = [], [root]
    while todo:
        x = todo.pop()
        every.append(x)
        if x.tag in ("article", "main"):
            up = x.parent
            while up is not None:
                if up.tag not in NEVER_TEXT:
                    up.cut = 0
                up = up.parent
        todo += [y for y in x.items if isinstance(y, Node)]
    if not any(x.cut in (SOFT, MAYBE) for x in every):
        return
    for x in every:
        x.chars = sum(len(y) for y in x.items if isinstance(y, str))
        x.link_chars = 0
    for x in reversed(every):
        if x.tag == "a":
            x.link_chars = x.chars
        if x.parent is not None and x.cut != HARD:
            x.parent.chars += x.chars
            x.parent.link_chars += x.link_chars
    for x in every:
        wrapper = 2 * x.chars > root.chars and any(isinstance(y, Node) and y.tag not in INLINE for y in x.items)
        if x.cut and x.cut != HARD and wrapper or x.cut == MAYBE and x.chars > LINE and 2 * x.link_chars < x.chars:
            x.cut = 0


def _in_order(root: Node) -> list[Node]:
    """Every element that isn't cut off, parents first."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if not x.cut:
            out.append(x)
            todo += [y for y in reversed(x.items) if isinstance(y, Node)]
    return out


def _measure(root: Node) -> list[Node]:
    nodes = _in_order(root)
    for x in nodes:
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        x.chars = sum(len(_SPACE.sub(" ", y).strip()) for y in x.items if isinstance(y, str))
    for x in reversed(nodes):
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1
        if p := x.parent:
            p.chars += x.chars
            p.tags += x.tags + (x.tag == "a" or x.tag not in INLINE)
            p.link_chars += x.link_chars
            p.link_tags += x.link_tags
    body = next((x for x in nodes if x.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for x in nodes:
        c, t, lc, lt = x.chars, max(1, x.tags), x.link_chars, x.link_tags
        if not c:
            x.density = 0.0
            continue
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        x.density = c / t * (math.log(max(1.0, c / max(1, lc) * (t / max(1, lt)))) / base if lc else math.log(max(math.e, c * t)) / base)
    for x in reversed(nodes):
        x.total = sum(y.total if y.tag in INLINE else y.density for y in x.items if isinstance(y, Node) and not y.cut)
    return nodes


def _content(root: Node) -> list[Node]:
    """The elements that hold the main text, in page order; none of them inside another."""
    nodes = _measure(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    if not body.chars:
        return []
    under = _in_order(body)
    best: dict[Node, Node] = {}
    for x in reversed(under):  # of each subtree the element with the greatest sum, the outer one on ties
        top = x
        for y in x.items:
            if isinstance(y, Node) and not y.cut and best[y].total > top.total:
                top = best[y]
        best[x] = top
    top = best[body]
    threshold, x = top.density, top
    above = dict.fromkeys(under, False)  # whether the element holds top
    while x is not body:
        x = x.parent
        above[x] = True
        threshold = min(threshold, x.density)
    chosen, todo = [], [body]
    while todo:
        x = todo.pop()
        if x is top:
            chosen.append(x)
        elif x is not body and x.density >= threshold and best[x].total > 0 and not above[x]:
            chosen.append(best[x])
        else:
            todo += [y for y in reversed(x.items) if isinstance(y, Node) and not y.cut]
    return chosen


def _blocks(tops: list[Node]) -> list[str]:
    out: list[str] = []
    own: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(own))).strip()
        own.clear()
        if text:
            out.append(text)

    for top in tops:
        flush()
        todo: list = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                own.append(x)
            elif x is None:
                flush()
            elif not x.cut:
                block = x.tag not in INLINE
                if block:
                    flush()
                    todo.append(None)
                if x.tag in ("br", "wbr") and x.tag == "br":
                    own.append("\n")
                todo += reversed(x.items)
        flush()
    return out


def extract(page: str | None) -> str:
    """The main text: blocks in page order, joined by an empty line; "" where there is none."""
    if not page:
        return ""
    root = parse(page)
    _spare(root)
    return "\n\n".join(_blocks(_content(root)))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars of every page, from its whole html.

    Null and empty html gives an empty text. Null ids and repeated rows keep a row each. Other columns aren't read. An
    empty table gives no rows. Elements are walked without recursion, so depth and length are free.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    out = pages.select(id_col, url_col, html_col).mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
