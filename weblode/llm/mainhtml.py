"""Main text of web pages by a minimum cut.

A page is cut into blocks of text with the elements around them.  A small classifier (element names, class and id words, link density, length) gives each
block a cost for either label: its capacity from the source (content) or to the sink (boilerplate).  Edges join blocks that follow
each other and blocks that are close in the DOM; cutting one costs its weight.  The minimum cut labels the blocks: what the source still reaches is
content.  Blocks whose own cost outweighs all their edges are settled before the flow starts, which changes no minimum cut.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<odd>/?[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)(?P<shut>>|\Z)", re.S
)
ATTR = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
#: Elements whose text is no text of the page.
RAW = {"script", "style", "title", "template", "iframe", "svg", "math", "object", "textarea", "xmp", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: A start tag on the left ends an open element on the right, within the nearest of the bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

#: A start tag of any other block ends an open paragraph, unless one of these stands between.
PARAGRAPH_ENDS = {"table", "div", "section", "article", "li", "td", "th", "blockquote", "body", "main", "aside", "nav", "form"}

#: Leanings of elements and of class and id words: below 0 boilerplate, above 0 content.
TAGS = {
    "nav": -8, "footer": -8, "aside": -8, "form": -8, "menu": -8, "button": -8, "select": -8, "dialog": -8, "header": -3, "noscript": -3, "label": -3, "figcaption": -1, "article": 5, "main": 4,
    "h1": 2, "h2": 0.7, "h3": 0.7, "h4": 0.5, "blockquote": 0.5, "pre": 0.5,
}
BAD = set(
    "nav navbar navigation menu submenu footer sidebar aside cookie cookies consent gdpr notice notices alert banner ad ads adv advert adverts advertisement advertising sponsor sponsored "
    "promo promotion share sharing social related recommended comment comments commentlist respond replies disqus newsletter subscribe subscription signup login breadcrumb breadcrumbs "
    "pagination pager popup modal overlay copyright widget toolbar skip toc outbrain taboola paywall masthead topbar contentinfo complementary reply discussion search logo".split()
)
#: Words that name a topic as well where a word beside them is none of layout (related-work, logo-history): inside the page's own article they need a
#: second sign, an element of links or of little text.
TOPICS = set("related search logo social share sharing copyright reply navigation menu advertising advertisement sponsor subscription notice notices alert".split())
BOXES = set(
    "box list item items bar link links button buttons icon icons form field input wrapper container block section area panel inner outer row col posts articles stories news slot top bottom left right "
    "title results result img image this page site more".split()
)
#: Characters and share of linked text from and up to which an element is prose.
PROSE, LINKED = 80, 0.3
#: What a doubtful word says of prose, and what hidden elements say.
DOUBT, UNSHOWN = -1.5, -3.0
#: Weights of smoothness edges: neighbours that are one element, blocks of one parent, of one grandparent.  Their size is that of a block's own evidence.
NEXT, PARENT, GRANDPARENT = 3.0, 1.0, 0.4
#: A class name that begins so tells of the page's layout, not of the element.
LAYOUT = {"has", "with", "no", "without", "is", "js"}
WEAK = {"header": -3, "tags": -3, "meta": -2, "byline": -1, "caption": -1}
GOOD = {"article": 3, "articlebody": 4, "content": 2, "post": 1.5, "entry": 2, "story": 2, "main": 2, "body": 1, "text": 1, "prose": 2}
#: Form fields, and characters of text a field up to which a form is no more than a form.
FIELDS, FIELD_TEXT = {"input", "select", "textarea", "button"}, 100
#: Shares of text that make an article the page's own, and one inside it the one that is meant.
OF_PAGE, OF_ARTICLE = 0.25, 0.5
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
UNSEEN = re.compile(r"type\s*+=\s*+[\"']?hidden", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
STOP = (".", "!", "?", ":", "…", '"', "”", "»", "。")


class Node:
    __slots__ = ("tag", "up", "own", "lean", "depth", "hidden", "number", "body", "outer", "chars", "fields", "linked", "doubt", "para")

    def __init__(self, tag: str, up: Node | None, attrs: str, number: int):
        self.tag, self.up, self.number = tag, up, number
        self.depth = up.depth + 1 if up else 0
        self.hidden = bool(up and up.hidden)
        self.lean, self.chars, self.fields, self.linked, self.doubt = (0.0, 0.0), 0, 0, 0, False
        # The nearest paragraph that a block element here would end.
        self.para = self if tag == "p" else None if tag in PARAGRAPH_ENDS or not up else up.para
        self.body = tag in ("article", "main")
        self.outer = (up if up.body else up.outer) if up else None
        # The document's own elements say nothing.
        own = [TAGS.get(tag, 0)]
        firm = own[0] <= -8
        if attrs and tag not in ("html", "body"):
            for m in ATTR.finditer(attrs):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id", "itemprop", "role"):
                    for words in ([w.lower() for w in WORDS.findall(x)] for x in value.split()):
                        if words and words[0] not in LAYOUT:
                            own += [-8 if w in BAD else WEAK.get(w, GOOD.get(w, 0)) for w in words]
                            topic = words == ["discussion"] or any(w not in BAD and w not in GOOD and w not in WEAK and w not in BOXES and not w.isdigit() for w in words)
                            bad = [w for w in words if w in BAD]
                            firm = firm or bool(bad) and not (topic and all(w in TOPICS or w == "discussion" for w in bad))
                    if "articlebody" in value.lower():
                        own.append(4)
                        self.body = True
                    elif name == "role" and value.strip().lower() == "main":
                        self.body = True
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
                    self.hidden = True
        self.own = own
        self.doubt = min(own) <= -8 and not firm
        # An article that is called a comment, an advertisement and so on is none.
        self.body = self.body and min(own) > -8


def weigh(nodes: list[Node]) -> None:
    """Set the leanings: the strongest either way, of an element and all around it.  The page's own article leaves those around it behind."""
    for x in reversed(nodes):
        if x.up:
            x.up.chars += x.chars
            x.up.fields += x.fields
            x.up.linked += x.linked
    inner: dict[int | None, Node] = {}
    for x in nodes:
        outer = x.outer.number if x.outer else None
        if x.body and not x.hidden and (outer not in inner or x.chars > inner[outer].chars):
            inner[outer] = x
    articles, x, least = set(), inner.get(None), OF_PAGE * nodes[0].chars
    while x and x.chars >= least:
        articles.add(x.number)
        x, least = inner.get(x.number), OF_ARTICLE * x.chars
    within = set()
    for x in nodes:
        bad, good = x.up.lean if x.up else (0.0, 0.0)
        if x.number in articles:
            bad = 0.0
        own = x.own
        if x.number in articles or x.up and x.up.number in within:
            within.add(x.number)
            if x.doubt and x.chars >= PROSE and x.linked <= LINKED * x.chars:
                own = [max(v, DOUBT) for v in own]
        if x.tag == "form" and x.chars >= FIELD_TEXT * x.fields:
            own = [0, *own[1:]]
        inside = good > 0 or bad < 0
        low, high = min(own), max(own)
        if x.tag == "header" and inside:
            low = -1
        x.lean = (min(bad, low), max(good, high) if high > good else good)


class Block:
    __slots__ = ("text", "node", "links")

    def __init__(self, text: str, node: Node, links: int):
        self.text, self.node, self.links = text, node, links


def page_blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in order, white space collapsed and references decoded."""
    root = Node("", None, "", 0)
    at, out, pieces, linked, nodes = root, [], [], [], [root]
    opened: Counter[str] = Counter()  # open elements by tag, so that an end tag without one costs nothing

    def leave(to: Node) -> Node:
        x = at
        while x is not to:
            opened[x.tag] -= 1
            x = x.up
        return to

    def close() -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            links = sum(len(x.strip()) for x in linked)
            out.append(Block(text, owner, links))
            owner.chars += len(text)
            owner.linked += links
        pieces.clear()
        linked.clear()

    pos, link, owner = 0, 0, root
    for m in TOKEN.finditer(page):
        if m.start() < pos:
            continue
        if m.start() > pos:
            piece = page[pos : m.start()]
            pieces.append(piece)
            if link:
                linked.append(piece)
        pos = m.end()
        tag = m["tag"] or m["odd"]
        if tag is None or m["shut"] == "":
            continue
        tag = tag.lower()
        end = m["end"] if m["tag"] else "/" if tag[0] == "/" else ""
        tag = tag.lstrip("/")
        if end:
            if tag == "a":
                link = max(0, link - 1)
            if tag in INLINE:
                continue
            if opened[tag] > 0:
                x = at
                while x.tag != tag:
                    x = x.up
                close()
                at = owner = leave(x.up)
            elif tag == "p":
                close()
            continue
        attrs = (m["attrs"] if m["tag"] else m["rest"]) or ""
        if tag in FIELDS and not UNSEEN.search(attrs):
            at.fields += 1
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, pos)
            pos = stop.start() if stop else len(page)
            continue
        if tag == "a":
            link += 1
        if tag == "br" or tag == "wbr" or tag == "img":
            pieces.append(" " if tag == "br" else "")
        if tag in INLINE:
            continue
        close()
        if tag in VOID:
            continue
        if tag not in CLOSES:
            if at.para:
                at = leave(at.para.up)
        else:
            which, bound = CLOSES[tag]
            x = at
            while x.up and x.tag not in bound and any(opened[w] > 0 for w in which):
                if x.tag in which:
                    at = leave(x.up)
                    break
                x = x.up
        at = owner = Node(tag, at, attrs, len(nodes))
        opened[tag] += 1
        nodes.append(at)
    if pos < len(page):
        # An unfinished tag at the very end is markup, not text.
        rest = page[pos:]
        pieces.append(rest)
    close()
    weigh(nodes)
    return out


def leaning(b: Block) -> float:
    """Above 0: content."""
    n = len(b.text)
    bad, good = b.node.lean
    own = -1.0 + 1.5 * min(1.0, b.text.count(" ") / 19) + (1.0 if b.text.endswith(STOP) else 0.0) - 4.0 * min(1.0, b.links / n)
    if b.text.startswith("©") or n < 200 and "all rights reserved" in b.text.lower() and not good:
        own -= 2.0
    return own + bad + good + (UNSHOWN if b.node.hidden else 0.0)


def edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours on the page, heavier the closer they are in the DOM, and the last block of the same parent and grandparent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            x, y, steps = blocks[i - 1].node, b.node, 0
            while x is not y and steps < 6:
                if x.depth >= y.depth and x.up:
                    x = x.up
                else:
                    y = y.up or y
                steps += 1
            out.append((i - 1, i, NEXT / (1 + steps)))
        for node, w in ((b.node.up, PARENT), (b.node.up and b.node.up.up, GRANDPARENT)):
            if node and node.up:
                j = last.get((node.number, w))
                if j is not None and j < i - 1:
                    out.append((j, i, w))
                last[node.number, w] = i
    return out


def settled(lean: list[float], links: list[tuple[int, int, float]]) -> tuple[list[int], list[float]]:
    """Labels (1, 0, or -1 for open) of blocks whose own cost outweighs their open edges, and the costs with the edges to such blocks folded in."""
    near: list[dict[int, float]] = [{} for _ in lean]
    for i, j, w in links:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label, cost = [-1] * len(lean), list(lean)
    weight = [sum(x.values()) for x in near]
    queue = deque(range(len(lean)))
    while queue:
        i = queue.popleft()
        if label[i] < 0 and abs(cost[i]) > weight[i]:
            label[i] = int(cost[i] > 0)
            for j, w in near[i].items():
                if label[j] < 0:
                    weight[j] -= w
                    cost[j] += w if label[i] else -w
                    queue.append(j)
    return label, cost


def levels(room: list[dict[int, float]]) -> dict[int, int]:
    """Steps from the source over edges with room."""
    came, queue = {0: 0}, deque([0])
    while queue:
        x = queue.popleft()
        for y, c in room[x].items():
            if c > 1e-12 and y not in came:
                came[y] = came[x] + 1
                queue.append(y)
    return came


def push(room: list[dict[int, float]], level: dict[int, int]) -> None:
    """A blocking flow from 0 to 1 along growing levels: no edge is tried again once it leads nowhere."""
    tries = {x: list(room[x]) for x in level}
    path = [0]
    while path:
        x = path[-1]
        if x == 1:
            steps = list(zip(path, path[1:], strict=False))
            flow = min(room[a][b] for a, b in steps)
            for a, b in steps:
                room[a][b] -= flow
                room[b][a] += flow
            # Go on from before the first edge that is full.
            del path[next(k for k, (a, b) in enumerate(steps) if room[a][b] <= 1e-12) + 1 :]
            continue
        while tries[x]:
            y = tries[x][-1]
            if room[x][y] > 1e-12 and level.get(y) == level[x] + 1:
                path.append(y)
                break
            tries[x].pop()
        else:
            path.pop()
            if path:
                tries[path[-1]].pop()


def cut(lean: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Content or not, by the minimum cut; blocks that the flow leaves undecided are boilerplate."""
    label, cost = settled(lean, links)
    free = [i for i, x in enumerate(label) if x < 0]
    if not free:
        return [x == 1 for x in label]
    number = {i: k + 2 for k, i in enumerate(free)}
    room: list[dict[int, float]] = [{} for _ in range(len(free) + 2)]  # 0 is the source, 1 the sink
    for i, k in number.items():
        if cost[i] > 0:
            room[0][k], room[k][0] = cost[i], 0.0
        elif cost[i] < 0:
            room[k][1], room[1][k] = -cost[i], 0.0
    for i, j, w in links:
        if i in number and j in number:
            a, b = number[i], number[j]
            room[a][b] = room[a].get(b, 0.0) + w
            room[b][a] = room[b].get(a, 0.0) + w
    came = levels(room)
    while 1 in came:
        push(room, came)
        came = levels(room)
    return [x == 1 if x >= 0 else number[i] in came for i, x in enumerate(label)]


def main_blocks(page: str | None) -> list[str]:
    blocks = page_blocks(page or "")
    keep = cut([leaning(b) for b in blocks], edges(blocks))
    return [b.text for b, k in zip(blocks, keep, strict=True) if k]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks of the main content, one a line), n_chars.

    Hidden elements and ``noscript`` are evidence against a block, not a reason to drop it.
    Null, empty and text-free pages have an empty text.  Null ids and urls stay, repeated rows come out repeated, an empty table
    gives no rows, other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = ["\n".join(main_blocks(x.as_py())) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
