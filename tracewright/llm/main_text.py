"""Main text of web pages by minimum cut.

A page becomes a list of text blocks. A classifier gives each block a cost of being called content and one of being called
boilerplate; these are its capacities to the two terminals. Smoothness edges join neighbouring blocks in page order
and blocks that hang on the same element (through a node for that element, so k siblings need k edges). The smallest cut
between the terminals, found by maximum flow, is the labelling of least total cost.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ends

#: Elements of HTML by what they do to text (fixed names of the standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select title xmp noembed noframes canvas video audio map".split())
CODE = frozenset(("script", "style"))  # of RAW: without an end tag all that follows is code, as browsers take it
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: An element of the key ends an open one of the value, up to the element that holds both.
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table tbody thead tfoot menu body div article section main".split())

#: Costs of boilerplate elements and of names in class, id or role.
BAD_ELEMENT = {"nav": 6, "footer": 6, "aside": 6, "form": 6, "button": 6, "menu": 6, "dialog": 6, "header": 6, "fieldset": 6}
PAGE = frozenset(("html", "body", "main", "article"))  # named after what they hold besides
GOOD_ELEMENT = {"article": 4, "main": 3}
BAD_NAME = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|adbox|adslot|banner|promo\w*|sponsor\w*|comments?|commentlist|disqus|respond|reply|replies|"
    r"sidebar\w*|side|widget\w*|nav\w*|menu\w*|breadcrumbs?|footer\w*|foot|header|masthead|topbar|toolbar|cookie\w*|consent|gdpr|notice\w*|"
    r"alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|"
    r"pagination|pager|tags?|copyright|legal|disclaimer|skip|hidden|contentinfo|navigation|complementary)(?:$|[-_\s\d])",
    re.I,
)
GOOD_NAME = re.compile(r"(?:^|[-_\s])(?:article\w*|content|main|post|entry|story|body|text|prose)(?:$|[-_\s])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: A quote opens a value right behind the equals sign only, and <!--> is a whole comment, as in browsers.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|[^\s/>][^\s/>=]*+(?>\s*+=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?)*+)>|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLANKS = re.compile(r"\s+")
NEXT, SAME = 1.0, 1.5


def tokens(page: str):
    """Matches of TOKEN in order, without RAW elements: what they hold is no markup, so their own end tag is looked for.

    One without an end tag loses its tag only, unless it is CODE.
    """
    ends, place = Ends(page), 0
    while place is not None:
        start, place = place, None
        for m in TOKEN.finditer(page, start):
            tag = m[2] and not m[1] and m[2].lower()
            if tag not in RAW:
                yield m
            elif not m[3].endswith("/"):
                place = ends.behind(tag, m.end())
                if place is not None:
                    break
                if tag in CODE:
                    return


class Element:
    __slots__ = ("tag", "parent", "cost", "article")

    def __init__(self, tag: str, parent, cost: float, article: bool):
        self.tag, self.parent, self.cost, self.article = tag, parent, cost, article


def opened(tag: str, attributes: str, parent: Element) -> Element:
    """An element with what it and those around it add to the cost of being content (negative: of boilerplate)."""
    cost, article = parent.cost - GOOD_ELEMENT.get(tag, 0), parent.article or tag in GOOD_ELEMENT
    headed = parent.article and tag == "header"  # the header of an article holds its heading
    if tag in BAD_ELEMENT and not headed:
        cost = max(0, cost) + BAD_ELEMENT[tag]  # the good of what is around it doesn't count any more
    if attributes and not attributes.isspace():
        found = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
        names = " ".join(found.get(a, "") for a in ("class", "id", "role"))
        bad = None if tag in PAGE or headed else BAD_NAME.search(names)
        if bad and not (parent.article and bad[0].strip("-_ ").lower() == "header"):
            cost = max(0, cost) + 8
        elif GOOD_NAME.search(names):
            cost -= 2
        if "hidden" in found or HIDDEN.search(found.get("style", "")) or found.get("aria-hidden") == "true":
            cost += 8
    return Element(tag, parent, cost, article)


def blocks(page: str) -> list[tuple[str, Element, int]]:
    """(text, element, letters inside links) of the blocks of a page, in order; markup, scripts and styles are gone.

    Unclosed and wrongly nested elements are closed as browsers do it in the common cases. The tags of a head only end a
    block: what may stand in a head has no text, and anything else closes it.
    """
    top = Element("", None, 0.0, False)
    at, stack, out = top, [top], []
    parts, linked, links = [], 0, 0

    def flush():
        nonlocal parts, linked
        text = BLANKS.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            holder = at
            while holder.tag in INLINE and holder.parent is not None:
                holder = holder.parent
            out.append((text, holder, min(linked, len(text))))
        parts, linked = [], 0

    for m in tokens(page):
        tag = m[2]
        if tag is None:
            text = m[0]
            if not text.startswith(("<!", "<?")):
                parts.append(text)
                linked += len(text) * (links > 0)
            continue
        tag, closing = tag.lower(), m[1]
        if tag == "head":
            flush()
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                flush()
            elif tag == "br":
                parts.append(" ")
            if any(e.tag == tag for e in stack):
                while stack[-1].tag != tag:
                    stack.pop()
                stack.pop()
                at = stack[-1]
            continue
        if tag not in INLINE:
            flush()
            if tag in ENDS_P and any(e.tag == "p" for e in stack):
                while stack[-1].tag != "p":
                    stack.pop()
                stack.pop()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ENDS_SAME.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k].tag in HOLDS:
                    break
            at = stack[-1]
        elif tag == "br":
            parts.append(" ")
        if tag not in VOID and not m[3].endswith("/"):
            links += tag == "a"
            at = opened(tag, m[3], at)
            stack.append(at)
    flush()
    return out


def costs(text: str, element: Element, linked: int) -> tuple[float, float]:
    """(cost of calling the block content, cost of calling it boilerplate)."""
    share = linked / len(text)
    words = text.count(" ") + 1
    content, boilerplate = 0.5 + 5 * share, 0.5 + min(words, 40) / 10
    if element.tag in ("h1", "h2", "h3", "h4", "p", "pre", "blockquote"):
        boilerplate += 1
    if text[-1] in ".!?;:\"…。！？":
        boilerplate += 0.5
    if text.startswith(("©", "Copyright")):
        content += 4
    content += max(0.0, element.cost)
    boilerplate += max(0.0, -element.cost)
    return content, boilerplate


def minimum_cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are content in the labelling of least cost (the larger such set on a tie).

    Flow runs from the content terminal over a node's ``boilerplate`` capacity and out by its ``content`` capacity. What can
    pass a single node is sent at once; the rest is sent by blocking flows, all shortest ways of a length in one pass.
    """
    n = len(content)
    excess = [b - c for c, b in zip(content, boilerplate)]  # over 0: capacity left from the source, under 0: to the sink
    if min(excess, default=0) >= 0 or max(excess, default=0) < 0:
        return [e >= 0 for e in excess]
    to, cap, out = [], [], [[] for _ in range(n)]
    for u, v, c in edges:
        out[u].append(len(to))
        to.append(v)
        cap.append(c)
        out[v].append(len(to))
        to.append(u)
        cap.append(c)
    tiny = 1e-9
    while True:
        # Distances from the nodes with surplus; then flow along edges that lead one step on, until no such way is left.
        level, queue, met = [-1] * n, deque(u for u in range(n) if excess[u] > tiny), False
        for u in queue:
            level[u] = 0
        while queue:
            u = queue.popleft()
            met = met or excess[u] < -tiny
            for e in out[u]:
                if level[to[e]] < 0 and cap[e] > tiny:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if not met:
            break
        turn = [0] * n  # the edge of each node that is looked at next
        for start in range(n):
            path = []
            while level[start] == 0 and excess[start] > tiny:
                u = to[path[-1]] if path else start
                if excess[u] < -tiny:
                    flow = min(excess[start], -excess[u], *(cap[e] for e in path))
                    excess[start] -= flow
                    excess[u] += flow
                    for e in path:
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                    full = next((k for k, e in enumerate(path) if cap[e] <= tiny), len(path))
                    del path[full:]
                    continue
                edges_of = out[u]
                while turn[u] < len(edges_of) and not (cap[edges_of[turn[u]]] > tiny and level[to[edges_of[turn[u]]]] == level[u] + 1):
                    turn[u] += 1
                if turn[u] < len(edges_of):
                    path.append(edges_of[turn[u]])
                elif path:
                    turn[to[path.pop() ^ 1]] += 1
                else:
                    break
    # Content: all that can't reach what is left of the sink's capacity.
    sink, queue = [e < -tiny for e in excess], deque(u for u in range(n) if excess[u] < -tiny)
    while queue:
        v = queue.popleft()
        for e in out[v]:
            u = to[e]
            if not sink[u] and cap[e ^ 1] > tiny:
                sink[u] = True
                queue.append(u)
    return [not s for s in sink]


def main_text(page: str | None) -> str:
    """The blocks of a page that are content, joined by line feeds."""
    found = blocks(page) if page else []
    if not found:
        return ""
    content, boilerplate = map(list, zip(*(costs(*b) for b in found)))
    # Alike neighbours of one element are one node: their costs add up, and a cut between them would only cost more.
    node, nodes, holder = [], [], []
    for k, (_, element, _) in enumerate(found):
        alike = nodes and holder[-1] is element.parent and (content[k] < boilerplate[k]) == (nodes[-1][0] < nodes[-1][1])
        if not alike:
            nodes.append([0.0, 0.0])
            holder.append(element.parent)
        nodes[-1][0] += content[k]
        nodes[-1][1] += boilerplate[k]
        node.append(len(nodes) - 1)
    edges = [(k, k + 1, NEXT) for k in range(len(nodes) - 1)]
    groups: dict[int, list[int]] = {}
    for k, h in enumerate(holder):
        groups.setdefault(id(h), []).append(k)
    for members in groups.values():
        if len(members) > 1:
            nodes.append([0.0, 0.0])
            edges += [(k, len(nodes) - 1, SAME) for k in members]
    kept = minimum_cut([c for c, _ in nodes], [b for _, b in nodes], edges)
    return "\n".join(text for (text, _, _), k in zip(found, node) if kept[k])


def extract(pages: DataFrame, page: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with a column of main text: never null, empty for a null or empty page or one without content.

    Pages are parsed whole, in Arrow batches; a page is one row and nothing is shuffled. Repeated rows and other columns
    stay as they are, but a column called ``name`` is replaced.
    """

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in column], pa.string())

    return pages.withColumn(name, texts(F.col(page)))
