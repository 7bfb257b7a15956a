"""Operator 4: main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A linear classifier gives each block the cost of
calling it content or boilerplate: these are the capacities of its edges to the
two terminals. Its features are what the elements around the block say, its length and
punctuation, its links, and *cues*: words of adverts, notices, and remarks around readers'
comments, by their share of the block. Neighbours in page order, and successive blocks under one parent,
are joined by smoothness edges whose capacity falls with their distance in the
tree. The minimum cut, found by maximum flow, is the labelling of least cost.

Cases: null and empty pages have empty text; unclosed, misnested and truncated
markup is read as far as it goes; very long and very deep pages take memory for themselves and
time in proportion, but for blocks that their neighbours leave undecided; repeated
rows get equal texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

from pyspark.sql import DataFrame, SparkSession

from .common import per_row, table

# The elements of HTML by their use.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head button select option datalist iframe object canvas svg math audio video".split())
BOILER = frozenset("nav footer aside form dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# An open element of the first kind ends where one of the second begins.
ENDS = {"p": CLOSES_P, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|newsletter|subscribe|signup|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widgets?|footer|masthead|topbar|header|share|social|related"
    r"|recommended|toolbar|pagination|pager|login|disclaimer|copyright|skip-link)(?:$|[\s_-])"
)
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|respond|replies|reply|discussion)(?:$|[\s_-])")
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body-?text)(?:$|[\s_-])")

PART = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|xmp|noembed|noframes)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)

#: Elements that hold no article: one that opens inside them shows that their end is missing.
SOFT = frozenset("nav header form menu footer".split())
#: Weights of the classifier, in units of capacity. Marks around a block add to its
#: features and stay within reach of its edges (240 at most): they don't settle it alone.
#: A mark of content is worth less than the form of a line of text: what has none of
#: that form is content for its neighbours' sake only.
STRUCTURE, LENGTH, LINKS, HEADING, PLAIN = {1: 110, 0: 0, -1: -300, -3: -300}, 120, 400, 60, -60
#: The most that cues count, and the shares of a block's words from which they do, and do in full.
CUES, CUE_FROM, CUE_FULL = 700, 0.12, 0.36
#: Links of an article that name a source (a year, or this many words) are text.
SOURCE_WORDS = 4
YEAR = re.compile(r"(?<![0-9])(?:1[5-9]|20)[0-9]{2}(?![0-9])")
#: Words without punctuation that make a line of text where no mark says anything.
RUNNING = 12
#: What adverts, notices, and the lines around comments say.
CUE = re.compile(
    r"(?<!\w)(?:advert(?:isement)?s?|sponsored|promoted|buy now|order now|shop now|on sale|sale|[0-9]+\s?% off|discounts?|free (?:trial|shipping)|limited (?:time )?offer"
    r"|special offer|best (?:price|deal)s?|coupons?|click here|sign up|subscribe(?: now| today)?|newsletter|download (?:now|our app)"
    r"|(?:we |this site |our site )?uses? cookies|cookies?|accept(?: all)?|decline|consent|privacy policy|terms of (?:use|service)"
    r"|[0-9]+ comments?|comments?(?: \([0-9]+\))?|leave a (?:reply|comment)|repl(?:y|ies)|says|wrote|posted (?:by|on|at)|[0-9]+ (?:minutes?|hours?|days?|weeks?) ago|log ?in to|report abuse|upvote|likes?"
    r"|anzeige|werbung|jetzt (?:kaufen|bestellen)|kommentare?|antworten|publicité|commentaires?|répondre|achetez|publicidad|comentarios?|responder|compra ahora)(?!\w)",
    re.IGNORECASE,
)
#: Capacity of an edge between neighbours, and its share at each step in the tree.
SMOOTH, DECAY = 80, 2
STOP = re.compile(r"[.!?:;,。！？：；，、،؛؟।]")


class Node:
    __slots__ = ("attrs_say", "chars", "depth", "parent", "summed", "tag")

    def __init__(self, tag: str, parent: Node | None, attrs_say: str):
        self.tag, self.parent, self.attrs_say, self.summed = tag, parent, attrs_say, False
        self.depth = parent.depth + 1 if parent else 0
        self.chars = 0


class Block:
    __slots__ = ("chars", "links", "node", "text")

    def __init__(self, node: Node, text: str, links: int):
        self.node, self.text, self.links = node, text, links
        self.chars = len(text)


def _said(attrs: str) -> str:
    """What an element's attributes say: hidden, boiler, hint, comment, content."""
    names = ""
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "hidden"
        if key == "role":
            if value in ROLES:
                return "boiler"
            if value in ("main", "article"):
                return "content"
        elif key in ("class", "id"):
            names += " " + value
    if not names:
        return ""
    if COMMENT.search(names):
        return "comment"
    if HINT.search(names):
        return "hint"
    return "content" if CONTENT.search(names) else ""


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order."""
    root = node = Node("html", None, "")
    out: list[Block] = []
    parts: list[str] = []
    links = in_link = at = 0
    opened: dict[str, int] = {}  # elements that are open, by tag

    def leave():
        nonlocal node
        opened[node.tag] -= 1
        node = node.parent

    def finish():
        nonlocal parts, links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(Block(node, text, min(links, len(text))))
        parts, links = [], 0

    for m in PART.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            parts.append(piece)
            if in_link:
                links += len(piece)
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m["end"] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        finish()
        if m["end"]:
            if opened.get(tag):  # else a stray end
                while node.tag != tag:
                    leave()
                leave()
                in_link = 0
            continue
        while node.parent and tag in ENDS.get(node.tag, ()):
            leave()
        if tag in ("html", "body") or tag in VOID or m["attrs"].endswith("/") and tag not in CLOSES_P:
            if tag == "body":  # a head that was left open ends here
                node = root
                opened.clear()
            continue
        node = Node(tag, node, _said(m["attrs"]))
        opened[tag] = opened.get(tag, 0) + 1
    parts.append(html[at:])
    finish()
    return out


def shares(found: list[Block]) -> int:
    """Add up the characters under each node, once, from the deepest up; returns those of the page."""
    nodes: list[Node] = []
    for b in found:
        b.node.chars += b.chars
        node: Node | None = b.node
        while node and not node.summed:
            node.summed = True
            nodes.append(node)
            node = node.parent
    for node in sorted(nodes, key=lambda n: -n.depth):
        if node.parent:
            node.parent.chars += node.chars
    return sum(b.chars for b in found)


def side(node: Node | None, total: int, known: dict) -> int:
    """What the elements around a block say: -2 not shown, -1 boilerplate, -3 boilerplate
    that an article ends, 1 content, 0 nothing. Marks of boilerplate prevail over marks of
    content, but a mere name, a header or a form says nothing where it holds most of the
    page's text."""
    path = []
    while node is not None and node not in known:
        path.append(node)
        node = node.parent
    state = known[node] if node is not None else 0
    for n in reversed(path):
        most = 2 * n.chars > total
        if state == -2 or n.tag in HIDDEN or n.attrs_say == "hidden":
            state = -2
        elif state == -1 or n.attrs_say in ("boiler", "comment") or n.attrs_say == "hint" and not most:
            state = -1
        elif n.tag in BOILER and n.tag not in SOFT:
            state = -1
        elif n.tag in ("article", "main"):
            state = 1
        elif state == -3 or n.tag in SOFT and not (n.tag == "form" and most or n.tag == "header" and (most or state == 1)):
            state = -3
        elif n.attrs_say == "content":
            state = 1
        known[n] = state
    return state


#: One of these is in any cue: most blocks have none.
CUE_PARTS = (
    "advert sponsored promoted now sale off discount free offer best coupon click sign subscribe newsletter download cookie accept decline consent privacy terms"
    " comment reply replies says wrote posted ago log report upvote like anzeige werbung jetzt kommentar antworten publicit répondre achetez comentario responder compra"
).split()


def cues(text: str) -> float:
    """The share of a block's words that are cues."""
    lower = text.lower()
    if not any(part in lower for part in CUE_PARTS):
        return 0.0
    n = len(text.split())
    return sum(len(m[0].split()) for m in CUE.finditer(text)) / n if n else 0.0


def score(block: Block, around: int) -> int:
    """The classifier: over zero for content."""
    density = block.links / block.chars
    out = STRUCTURE[around]
    words = len(block.text.split())
    if around == 1 and block.node.tag in ("h1", "h2"):  # an article's headings may link to it
        density /= 2
    if around == 1 and block.node.tag in ("li", "p", "dd") and words >= SOURCE_WORDS and YEAR.search(block.text):
        density = 0.0  # a source
    sentence = STOP.search(block.text) or around == 0 and density == 0 and words >= RUNNING
    out += int(LENGTH * min(1.0, block.chars / 80) * (1 if sentence else -1)) - int(LINKS * density)
    if block.node.tag in ("h1", "h2", "h3"):
        out += HEADING
    elif block.node.tag not in ("p", "blockquote", "pre", "li", "dd", "td"):
        out += PLAIN
    share = cues(block.text)
    return out - int(CUES * min(1.0, (share - CUE_FROM) / (CUE_FULL - CUE_FROM))) if share > CUE_FROM else out


def distance(a: Node, b: Node) -> int:
    """Steps in the tree, up to where an edge's capacity has no more to lose."""
    steps = 0
    while a is not b and steps < 10:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Block]) -> dict[tuple[int, int], int]:
    """Smoothness edges between blocks, by their indexes."""
    out: dict[tuple[int, int], int] = {}
    last: dict[Node, int] = {}
    for j, b in enumerate(found):
        if j:
            c = SMOOTH // DECAY ** min(8, max(0, distance(found[j - 1].node, b.node) - 1))
            out[j - 1, j] = out.get((j - 1, j), 0) + c
        parent = b.node.parent or b.node
        if parent in last:
            i = last[parent]
            out[i, j] = out.get((i, j), 0) + SMOOTH // DECAY
        last[parent] = j
    return {k: c for k, c in out.items() if c}


def minimum_cut(unary: list[int], pairs: dict[tuple[int, int], int]) -> list[bool]:
    """Labels of least cost: -unary for True on each node if it is negative and
    unary for False if positive, plus the capacity of each pair set apart. A node whose
    terminal edge outweighs all its other edges takes that side in some minimum
    cut; it is fixed, and its edges become terminal capacities of its neighbours.
    Maximum flow settles the rest."""
    n = len(unary)
    weight = list(unary)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), c in pairs.items():
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if label[v] is not None or abs(weight[v]) < sum(near[v].values()):
            continue
        label[v] = weight[v] > 0
        for w, c in near[v].items():
            del near[w][v]
            weight[w] += c if label[v] else -c
            todo.append(w)
        near[v] = {}
    rest = [v for v in range(n) if label[v] is None]
    if rest:
        for v, is_content in zip(rest, _flow(rest, weight, near), strict=True):
            label[v] = is_content
    return label


def _flow(rest: list[int], weight: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Dinic's algorithm; True for what the source still reaches."""
    index = {v: k for k, v in enumerate(rest)}
    n = len(rest)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def add(a: int, b: int, forth: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(forth)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for v in rest:
        k = index[v]
        if weight[v] > 0:
            add(source, k, weight[v], 0)
        elif weight[v] < 0:
            add(k, sink, -weight[v], 0)
        for w, c in near[v].items():
            if v < w:
                add(k, index[w], c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if not cap[e])
                v = to[path[k] ^ 1]
                path = path[:k]
                continue
            while turn[v] < len(head[v]):
                e = head[v][turn[v]]
                if cap[e] and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            else:
                if v == source:
                    break
                level[v] = -1
                v = to[path.pop() ^ 1]
                continue
            path.append(e)
            v = to[e]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found = blocks(html)
    total = shares(found)
    known: dict[Node, int] = {}
    around = [side(b.node, total, known) for b in found]
    shown = [k for k, s in enumerate(around) if s != -2]
    found = [found[k] for k in shown]
    labels = minimum_cut([score(b, around[k]) for b, k in zip(found, shown, strict=True)], edges(found))
    return " ".join(b.text for b, content in zip(found, labels, strict=True) if content)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""

    def rows(batch):
        return [(i, u, t, len(t)) for i, u, t in ((i, u, main_text(h)) for i, u, h in batch)]

    return per_row(pages, "page_id long, url string, text string, n_chars long", rows, [page_id, url, html])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
