"""Main text of web pages by composite text density.

Every DOM node gets a density: its characters for each tag, less where many of them stand in links. The node whose
children have the largest sum of densities is the core; the least density on its path to the body is the threshold
that content anywhere else under the body must reach. Page furniture is dropped by element and role.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from leadlens.llm.common import slices, tidy

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: The rest of a tag; quoted attribute values may hold ">".
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WHITE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Elements in which any other can be self-closed.
FOREIGN = ("svg", "math")
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that close an open paragraph.
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An opening tag closes an open one of its set, up to the nearest of the limits.
SAME = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
FURNITURE = frozenset("nav aside footer form script style noscript template iframe svg button select textarea input dialog menu head title object embed canvas audio video".split())
#: Words of a class, id or role that mark furniture; whole words between "-", "_" and case changes.
ROLES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus respond reply replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social related recommended recirc widget pagination pager skip search complementary contentinfo".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that win where two nodes have the same sum.
MARKED = frozenset(["article", "main"])
#: Furniture that a page doesn't show as text.
UNSEEN = frozenset("head title script style noscript template iframe svg object embed canvas audio video".split())


class Node:
    __slots__ = ("blocks", "children", "density", "drop", "heads", "own", "parent", "peak", "shown", "sum", "tag")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False):
        self.tag, self.parent, self.drop, self.children = tag, parent, drop, []
        self.blocks = self.heads = False
        self.peak, self.density, self.sum = self, 0.0, 0.0


def _furniture(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not inside_article):
        return True
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if tag not in ("html", "body", "article", "main") and name in ("class", "id", "role"):
            if not ROLES.isdisjoint(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower().replace("-", " ").replace("_", " ").split()):
                return True
    return False


class Markup:
    """The tags, comments and declarations of a page, in time linear in its length.

    A quote that is never closed would have the rest of the page read again for every tag before it. At the first such
    tag the ends of all tags are found at once, from the back: ``>`` ends a tag outside of quotes.
    """

    def __init__(self, page: str):
        self.page = page
        self.places: list[int] | None = None
        self.ends: list[int] = []

    def _find_ends(self) -> None:
        self.places = [m.start() for m in _SPECIAL.finditer(self.page)]
        outside = double = single = -1
        for at in reversed(self.places):
            ch = self.page[at]
            if ch == ">":
                outside = at + 1
            elif ch == '"':
                outside, double = double, outside
            else:
                outside, single = single, outside
            self.ends.append(outside)
        self.ends.reverse()

    def _end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` ends; -1 if it doesn't."""
        if self.places is None:
            m = _REST.match(self.page, at)
            if m:
                return m.end()
            self._find_ends()
        k = bisect_left(self.places, at)
        return self.ends[k] if k < len(self.ends) else -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, is an end tag, name, attributes) of the first markup from ``at`` on; comments have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), False, "", ""
            if page[start + 1 : start + 2] in ("!", "?"):
                end = page.find(">", start)
                if end < 0:
                    return None
                return start, end + 1, False, "", ""
            m = _NAME.match(page, start)
            end = self._end(m.end()) if m else -1
            if end >= 0:
                return start, end, bool(m[1]), m[2].lower(), page[m.end() : end - 1]
            at = start + 1
        return None


def parse(page: str) -> Node:
    """A tolerant tree: unclosed paragraphs and items end where the next begins, stray end tags are ignored."""
    root = here = Node("#root", None)
    open_tags: dict[str, int] = {}
    at, articles = 0, 0
    markup = Markup(page)

    def close(to: Node) -> Node:
        nonlocal here, articles
        while here is not to:
            open_tags[here.tag] -= 1
            articles -= here.tag in ("article", "main")
            here = here.parent
        return here

    while found := markup.next(at):
        start, end, ends, tag, attributes = found
        if start > at:
            here.children.append(page[at:start])
        at = end
        if not tag:
            continue
        if ends:
            if open_tags.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                close(node.parent)
            continue
        foreign = next((x for x in FOREIGN if open_tags.get(x)), None)
        if foreign and tag in BLOCK and not open_tags.get("foreignobject"):  # a drawing or formula that was never closed ends here
            node = here
            while node.tag != foreign:
                node = node.parent
            close(node.parent)
            foreign = None
        if tag in ENDS_P and open_tags.get("p"):
            node = here
            while node.tag != "p":
                node = node.parent
            close(node.parent)
        elif tag in SAME and any(open_tags.get(x) for x in SAME[tag][0]):
            same, limits = SAME[tag]
            node = here
            while node is not root and node.tag not in same and node.tag not in limits:
                node = node.parent
            if node.tag in same:
                close(node.parent)
        node = Node(tag, here, here.drop or _furniture(tag, attributes, articles > 0))
        here.children.append(node)
        if tag in RAW and not (foreign and attributes.endswith("/")):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag in ("textarea", "title"):
                node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            here = node
            open_tags[tag] = open_tags.get(tag, 0) + 1
            articles += tag in ("article", "main")
    if at < len(page):
        here.children.append(page[at:])
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes, parents first; without recursion, as pages may nest deeply."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _density(counts: list[int], share: float) -> float:
    """Composite text density of [characters, tags, characters in links, links]; share is that of link characters in the body."""
    c, t, lc, lt = counts[0], *(max(1, x) for x in counts[1:])
    if not c:
        return 0.0
    base = log(c / max(1, c - counts[2]) * counts[2] + share * c + e)
    return c / t * log(max(1.0, c / lc * t / lt)) / max(1.0, log(base))


def _counts(children: list[Node | str]) -> tuple[list[int], list[int]]:
    """The counts of children together: without furniture, and as the page shows them."""
    own, shown = [0] * 4, [0] * 4
    for c in children:
        if isinstance(c, str):
            n = len(_WHITE.sub(" ", c).strip())
            own[0] += n
            shown[0] += n
        elif not (c.drop and c.tag in UNSEEN):
            link = c.tag == "a"
            for out, x in ((shown, c.shown),) if c.drop else ((shown, c.shown), (own, c.own)):
                out[0] += x[0]
                out[1] += x[1] + 1
                out[2] += x[0] if link else x[2]
                out[3] += x[3] + link
    return own, shown


def _parts(node: Node) -> Iterator[Node | list[Node | str]]:
    """The children of a node: blocks, and runs of the text and inline elements between them."""
    run: list[Node | str] = []
    for c in node.children:
        if isinstance(c, str) or not (c.tag in BLOCK or c.blocks):
            run.append(c)
        else:
            if run:
                yield run
                run = []
            if not c.drop:
                yield c
    if run:
        yield run


def densities(root: Node) -> tuple[list[Node], float]:
    """Fill in counts, density and peak (the node below with the largest sum of its children's densities) of every node.

    Returns the nodes, parents first, and the body's share of link characters. Text between blocks counts as a child.
    """
    nodes = _walk(root)
    for node in reversed(nodes):
        node.own, node.shown = _counts(node.children)
        inner = [c for c in node.children if isinstance(c, Node) and not c.drop]
        node.blocks = any(c.tag in BLOCK or c.blocks for c in inner)
        node.heads = node.tag in HEADINGS or (bool(inner) and all(c.heads for c in inner) and not any(isinstance(c, str) and c.strip() for c in node.children))
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.shown[2] / max(1, body.shown[0])
    for node in reversed(nodes):
        if node.drop:
            continue
        node.density = total = _density(node.own, share)
        node.peak, node.sum = node, 0.0
        if node.blocks:
            total = 0.0
            for x in _parts(node):
                if isinstance(x, list):
                    total += _density(_counts(x)[0], share)
                else:
                    total += x.density
                    if x.sum > node.peak.sum or (x.sum == node.peak.sum and x.peak.tag in MARKED):
                        node.peak, node.sum = x.peak, x.sum
        if node.peak is node or total > node.sum or (total == node.sum and node.peak.tag not in MARKED):
            node.peak, node.sum = node, total
    return nodes, share


def core(root: Node) -> tuple[Node, float, float]:
    """(node with the largest sum of its children's densities, least density on its path to the body, share of link characters).

    Furniture isn't text, but it thins out the nodes on the path, as the method has it.
    """
    nodes, share = densities(root)
    body = next((n for n in nodes if n.tag == "body" and not n.drop), root)
    best = up = body.peak if body.peak.sum else root.peak
    threshold = min(up.density, _density(up.shown, share))
    while up.parent is not None and up.tag != "body":
        up = up.parent
        threshold = min(threshold, up.density, _density(up.shown, share))
    return best, threshold, share


def main_text(page: str) -> str:
    """The page's main text, one block a line.

    From the body down, each node that reaches the threshold gives the densest node below it, on the core's path or off it.
    A heading is too short for a density of its own and goes with the block or the text that follows it.
    """
    root = parse(page)
    best, threshold, share = core(root)
    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        line = _WHITE.sub(" ", html.unescape("".join(words))).strip()
        words.clear()
        if line:
            blocks.append(line)

    path = set()
    up: Node | None = best
    while up is not None:
        path.add(up)
        up = up.parent
    marked = {best}
    stack: list[tuple[Node | str | None, bool]] = [(root, best is root)]
    while stack:
        node, whole = stack.pop()
        if node is None:
            flush()
            continue
        if isinstance(node, str):
            words.append(node)
            continue
        if node.drop:
            continue
        if not whole and node not in path and node.density >= threshold:
            marked.add(node.peak)
        whole = whole or node in marked
        if node.tag == "br":
            words.append(" ")
            continue
        if whole:
            if node.tag in BLOCK:
                flush()
                stack.append((None, False))
            stack.extend((c, True) for c in reversed(node.children))
            continue
        below: list[tuple[Node | str | None, bool]] = []
        kept = False
        for x in reversed(list(_parts(node))):
            run = isinstance(x, list)
            counts = _counts(x)[0] if run else x.own
            if not counts[0]:
                continue
            if run or not x.heads:
                kept = (not run and x in path) or _density(counts, share) >= threshold
            if run:
                below += [(None, False), *((c, True) for c in reversed(x)), (None, False)] if kept else []
            else:
                below.append((x, x.heads and kept))
        flush()
        stack.append((None, False))
        stack.extend(below)
    flush()
    return "\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html", 4 << 20):
            texts = [main_text(p or "") for p in part.column("html").to_pylist()]
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of pages (page_id, url, html); other columns are dropped.

    A null or empty page, or one that is furniture alone, has an empty text. Pages of any length and however broken are
    read whole, in time linear in their length. Where sums of densities tie, ``article`` and ``main`` win, then the outer
    node. Repeated rows and rows without an id stay. An empty table gives no rows.
    """
    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")
