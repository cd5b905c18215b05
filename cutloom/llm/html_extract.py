"""Main text of web pages by composite text density.

A page becomes a small element tree (unclosed and misnested tags are closed as browsers do for paragraphs, list items and table
parts).  Scripts, styles, the head and hidden elements show nothing and are not in it.

1. Every element has a composite density: its characters per tag, scaled by how little of them stand in links, relative to the
   page's share of link text.  A hint (an element such as nav or form, a role, a word of class or id) never removes
   anything: it multiplies the density of its element, and of all in it, by ``HINT``, and so what the element adds to those around it.
2. An element's sum is that of its children's densities, its own text being one child.  The element with the largest sum
   is the core.  Hints on the way from the root to the core are wrong then; they are dropped and densities taken anew.
3. The smallest density on that way is the threshold.  Inside the core only hinted elements below the threshold go.  Outside, what
   hangs off the way is kept where its density reaches the threshold, where it is a heading, or where it has no hint and no link
   and stands between kept ones.

Text: character references decoded, white space inside a block one space, blocks joined by two newlines in page order.
A null or empty page, or one without text, gives an empty text.  Rows are extracted alone; repeated rows give equal
results.  Null page_ids and urls stay null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names, and the words that hint at what is not the article.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HINTED = {"nav", "footer", "aside", "form", "button", "select", "option", "input", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "fieldset"}
HINT = 0.001
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
MARKS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "sidebar", "side", "widget", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "share", "sharing", "social", "related", "recommended", "toolbar", "skip", "login", "search"}
CLOSES = {
    **{t: {"p"} for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = {"article", "aside", "blockquote", "body", "button", "div", "dl", "footer", "form", "header", "html", "main", "nav", "ol", "section", "table", "td", "th", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?/][^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
LOOSE = {"side", "search", "notice", "notices", "alert", "skip", "share", "social", "related", "reply", "respond", "overlay", "menu"}  # marks as a whole class only


class Element:
    """``hint`` is its own factor, ``factor`` that of its ancestors and itself; counts are of the subtree,
    with hints inside it applied; ``written`` is its characters without hints.  A density falls with the share of its text that is hinted."""

    __slots__ = ("tag", "parent", "items", "hint", "factor", "chars", "link_chars", "tags", "link_tags", "written", "density", "sum", "depth")

    def __init__(self, tag: str, parent: Element | None, hint: float = 1.0):
        self.tag, self.parent, self.hint = tag, parent, hint
        self.items: list[Element | str] = []
        self.factor, self.depth = hint, 0
        self.chars = self.link_chars = self.tags = self.link_tags = self.written = self.density = self.sum = 0.0


def attribute_pairs(attributes: str) -> list[tuple[str, str]]:
    """(name in lower case, value) of a start tag's attributes; the first of a name counts, as in browsers."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name:
            found.setdefault(name.lower(), unescape("".join(values)))
    return [*found.items()]


def _marked(name: str) -> bool:
    """Whether a class or id names what is never article text: as a whole, or by a first word that means little else."""
    first = _WORDS.match(name)
    return name.lower() in MARKS or first is not None and first[0].lower() in MARKS - LOOSE


def hinted(tag: str, attributes: str, parent: Element) -> float | None:
    """An element's own factor; None if it shows nothing."""
    if tag == "head":
        return None
    hint = HINT if tag in HINTED else 1.0
    if tag == "header":
        above: Element | None = parent
        while above and above.tag not in ("article", "main"):
            above = above.parent
        hint = 1.0 if above else HINT
    if attributes and tag not in ("html", "body"):
        for name, value in attribute_pairs(attributes):
            if name == "hidden":
                return None
            if name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
                hint = HINT
            elif name in ("class", "id") and any(_marked(x) for x in value.split()):
                hint = HINT
    return hint


def tree(html: str) -> Element:
    """The page's elements; texts are strings among an element's items.  What shows nothing has no place among its parent's."""
    root = at = Element("html", None)
    opened: dict[str, list[Element]] = defaultdict(list)  # open elements by tag, innermost last; the root is none of them
    where, end, last = 0, len(html), html.rfind(">")
    while where < end:
        start = html.find("<", where)
        if start < 0:
            start = end
        if start > where:
            at.items.append(html[where:start])
        if start == end:
            break
        found = _TOKEN.match(html, start) if start < last or html.startswith("<!--", start) else None
        if not found:
            at.items.append("<")
            where = start + 1
            continue
        where = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            node = opened[tag][-1] if opened[tag] else None
            if node is not None and not (tag in INLINE and _deepest(opened, SCOPES - {tag}) > node.depth):
                at = _shut(opened, at, node)
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, where)
            where = html.find(">", close.start()) + 1 or end if close else end
            continue
        if tag in ("html", "body") and at is root:
            if tag == "html":
                continue
        if shut := CLOSES.get(tag):
            depth = _deepest(opened, shut)
            if depth > 0 and depth > _deepest(opened, SCOPES - shut):
                at = _shut(opened, at, next(opened[t][-1] for t in shut if opened[t] and opened[t][-1].depth == depth))
        hint = hinted(tag, found[3], at)
        child = Element(tag, at, hint or 1.0)
        if hint is not None:
            at.items.append(child)
        if tag not in VOID and not found[3].endswith("/"):
            at = child
            child.depth = child.parent.depth + 1
            opened[tag].append(child)
    return root


def _deepest(opened: dict[str, list[Element]], tags: frozenset[str] | set[str]) -> int:
    """How deep the innermost open element with one of these tags lies; 0 without one."""
    return max((opened[t][-1].depth for t in tags if opened[t]), default=0)


def _shut(opened: dict[str, list[Element]], at: Element, node: Element) -> Element:
    """Closes ``node`` and all that is open in it; an element is closed once, so all ends of a page take time in proportion to its tags."""
    while at is not node:
        opened[at.tag].pop()
        at = at.parent
    opened[node.tag].pop()
    return node.parent


def composite(chars: float, link_chars: float, tags: float, link_tags: float, share: float) -> float:
    """Characters per tag, higher the fewer of them are in links; ``share`` is the page's share of link text."""
    if chars <= 0:
        return 0.0
    plain = max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + share * chars + math.e)
    ratio = max(chars, 1) / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * (math.log(ratio) / math.log(base) if base > 1 + 1e-9 else math.log(ratio + 1))


def _in_order(root: Element) -> list[tuple[Element, bool]]:
    """(element, whether it is in a link), parents first."""
    order, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag == "a"
        order.append((node, inside))
        todo += [(x, inside) for x in node.items if not isinstance(x, str)]
    return order


def measure(order: list[tuple[Element, bool]]) -> None:
    """Counts from the leaves up, then factors, densities and sums."""
    own: list[tuple[float, float, float, float]] = []  # text of an element that is in no block inside it
    run: dict[Element, list[float]] = {}
    for node, _ in order:
        node.chars = node.link_chars = node.written = node.sum = 0.0
        node.tags, node.link_tags = (0.0 if node.tag == "br" else 1.0), float(node.tag == "a")
        run[node] = [0.0, 0.0, 0.0, 0.0]
    for node, inside in reversed(order):
        mine, text = run[node], float(sum(len(x.strip()) for x in node.items if isinstance(x, str)))
        node.chars += text
        node.written += text
        mine[0] += text
        if inside:
            node.link_chars += text
            mine[1] += text
        up, hint = node.parent, node.hint
        if up is not None:
            up.chars += hint * node.chars
            up.written += node.written
            up.link_chars += hint * node.link_chars
            up.tags += hint * node.tags
            up.link_tags += hint * node.link_tags
            if node.tag in INLINE or node.tag == "br":
                above = run[up]
                above[0] += hint * mine[0]
                above[1] += hint * mine[1]
                above[2] += hint * (mine[2] + (node.tag != "br"))
                above[3] += hint * (mine[3] + (node.tag == "a"))
    root = order[0][0]
    share = root.link_chars / max(root.chars, 1)
    for node, _ in order:
        node.factor = min(node.hint, node.parent.factor) if node.parent is not None else node.hint
        node.density = node.factor * node.chars / max(node.written, 1) * composite(node.chars, node.link_chars, node.tags, node.link_tags, share)
        node.sum += node.factor * composite(*run[node], share)
        if node.parent is not None and node.tag not in INLINE:
            node.parent.sum += node.density


def core_of(order: list[tuple[Element, bool]]) -> tuple[Element, float]:
    """The element with the largest sum (of equals the outermost), and the threshold; hints on the way to it are dropped."""
    measure(order)
    core = max((node for node, _ in order), key=lambda x: x.sum)
    way, wrong = core, False
    while way is not None:
        wrong |= way.hint < 1
        way.hint, way = 1.0, way.parent
    if wrong:
        measure(order)
    low, node = math.inf, core
    while node is not None:
        low, node = min(low, node.density), node.parent
    return core, low


def _off_the_way(node: Element, way: set[Element], low: float) -> list[bool]:
    """Which items of an element on the way to the core are kept."""
    kept = []
    for x in node.items:
        if isinstance(x, str):
            kept.append(len(y := x.strip()) > 0 and node.factor * composite(len(y), 0, 1, 0, 0.0) >= low)
        else:
            kept.append(x in way or x.chars > 0 and x.density >= low or x.tag in HEADINGS and x.hint == 1)
    some = [i for i, k in enumerate(kept) if k]
    for i in range(some[0], some[-1]) if some else ():
        x = node.items[i]
        kept[i] = kept[i] or isinstance(x, str) or x.hint == 1 and not x.link_chars
    return kept


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = tree(html)
    order = _in_order(root)
    core, low = core_of(order)
    way, node = {core}, core.parent
    while node is not None:
        way.add(node)
        node = node.parent
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            if text := " ".join(unescape("".join(run)).split()):
                blocks.append(text)
            run.clear()

    todo: list = [root]
    whole = {core}
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif item.tag == "br":
            run.append(" ")
        else:
            if item in whole:
                items = [x for x in item.items if isinstance(x, str) or x.hint == 1 or x.density >= low]
                whole.update(x for x in items if not isinstance(x, str))
            else:
                items = [x for x, k in zip(item.items, _off_the_way(item, way, low), strict=True) if k]
                whole.update(x for x in items if not isinstance(x, str) and x not in way)
            if item.tag not in INLINE:
                flush()
                todo.append(None)
            todo += reversed(items)
    flush()
    return "\n\n".join(blocks)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
