"""Main text of HTML pages by minimum-cut labelling.

A page is read once into text blocks.  A small classifier over each block's
text and the elements around it gives the cost of calling it content or
boilerplate; these costs are the capacities to the two terminals.  Blocks next
to each other, and blocks of one parent element, are joined by edges whose
capacity falls with their distance in the element tree.  The minimum cut labels
all blocks of the page at once.  Pages are independent: Spark maps over batches
of them and nothing is shuffled.

No tag or class name decides alone.  Text evidence is bounded to two either
way, what elements say to three, and two full edges weigh as much as a typical
block, so an undecided block goes with its surroundings.  How far a boilerplate
name is trusted depends on the text below the element: a form that holds the
page's prose, or a "widget" with the title and most of the prose, says little.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>", re.S)  # a quote opens a value only after "="
_ATTR = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")

# What elements and names mean.
RAW = frozenset("script style noscript template textarea title iframe svg select option object head".split())
#: elements that, left open, lose only their start tag: what follows is the page
MAY_STAY_OPEN = frozenset("noscript template svg select option object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form button menu dialog fieldset label input".split())
BOILERPLATE_ROLES = frozenset(
    "navigation contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adslot adsense banner breadcrumb breadcrumbs byline comment "
    "comments commentlist consent cookie cookies copyright disclaimer disqus feedback footer form gdpr login masthead "
    "menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pagination pager "
    "popup promo promotion recommended related replies reply respond rss search share sharing sidebar signup skip "
    "social sponsor sponsored subscribe taboola teaser toolbar topbar widget widgets".split())
SOFT_NAMES = frozenset("header meta tags tag author date".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_NAMES = frozenset("article articlebody body content entry main post story text".split())
WRAPPER_WORDS = frozenset(
    "has with no without page layout wrapper wrap container open closed enabled disabled".split())
CONTROLS = frozenset("input textarea select button".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


NONE, CONTENT, SOFT, BOILERPLATE, HIDDEN = range(5)


class Element:
    """An element: what it says of the text below it, and what that text is."""

    __slots__ = ("tag", "parent", "depth", "kind", "region", "doubt", "link", "head", "prose", "controls", "title")

    def __init__(self, tag: str, parent: "Element | None", attrs: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or bool(parent and parent.link)
        self.head = tag in HEADINGS or bool(parent and parent.head)
        self.prose = self.controls = 0  # below: characters outside links, form controls
        self.title = tag in ("h1", "main")  # below or itself
        self.kind = self._kind(attrs)
        #: the nearest element that says something else than those around it
        above = parent.region if parent else self
        self.region = self if self.kind != NONE and self.kind != above.kind else above
        self.doubt = 1.0  # 1 minus the trust in boilerplate around the element, set by ``weigh``

    def _kind(self, attrs: str) -> int:
        tag = self.tag
        if attrs and not attrs.isspace():
            names, role = self._names(attrs)
            if names is None:
                return HIDDEN
        else:
            names, role = [], ""
        if tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES:
            return BOILERPLATE
        if tag not in ("html", "body", "main") and not BOILERPLATE_NAMES.isdisjoint(names):
            return BOILERPLATE
        if tag in CONTENT_TAGS or role in ("main", "article"):
            return CONTENT
        if tag in ("html", "body"):
            return NONE
        if tag == "header" or role == "banner" or not SOFT_NAMES.isdisjoint(names):
            # a header inside an article is part of it
            return NONE if self.parent and self.parent.region.kind == CONTENT else SOFT
        return NONE if CONTENT_NAMES.isdisjoint(names) else CONTENT

    @staticmethod
    def _names(attrs: str) -> tuple[list[str] | None, str]:
        """Name parts of class and id, and the role; None for hidden elements."""
        names: list[str] = []
        role = ""
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                for name in value.split():
                    parts = [p.lower() for p in _NAME_PART.findall(name)]
                    if len(parts) == 1 or WRAPPER_WORDS.isdisjoint(parts):
                        names += parts
            elif key == "role":
                role = value.lower()
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                return None, role
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return None, role
            elif key == "itemprop" and value.lower() == "articlebody":
                names.append("articlebody")
        return names, role


def weigh(elements: list[Element]) -> None:
    """Text counts of all elements (listed parents first), then how far the
    boilerplate around each is to be doubted."""
    for e in reversed(elements):
        if e.parent:
            e.parent.prose += e.prose
            e.parent.controls += e.controls
            e.parent.title = e.parent.title or e.title
    page = max(1, elements[0].prose)
    for e in elements:
        e.doubt = e.parent.doubt if e.parent else 1.0
        if e.kind == BOILERPLATE:
            trust = 1 - e.prose / page if e.title else 1.0
            if e.tag == "form":
                trust = min(trust, FORM_CHARS * max(e.controls, 1) / (e.prose + 1))
            e.doubt = min(e.doubt, 1 - trust)


class Block:
    __slots__ = ("text", "home", "links", "chars")

    def __init__(self, text: str, home: Element, links: int):
        self.text, self.home, self.links, self.chars = text, home, links, len(text)


def read_blocks(page: str) -> list[Block]:
    """Text blocks of a page, in page order: character references decoded,
    white space collapsed, empty blocks left out.

    Malformed pages: a quote opens a value only after ``=``; a tag without
    ``>`` is text; an element of ``MAY_STAY_OPEN`` without an end tag before
    the next of its kind loses its start tag alone, any other raw element
    without one hides the rest of the page, as in a browser."""
    top = Element("html", None, "")
    here, blocks, elements = top, [], [top]
    last_tag_end, unclosed = page.rfind(">"), set()
    parts: list[str] = []
    linked = 0
    home = top

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append(Block(text, home, min(linked, len(text))))
            home.prose += len(text) - min(linked, len(text))
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked, home
        if not parts:
            if raw.isspace():
                return
            home = here
            while home.tag not in BLOCK and home.parent:
                home = home.parent
        parts.append(raw)
        if here.link:
            linked += len(raw.strip())

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at) if at <= last_tag_end else None
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in BLOCK:
                close()
            e = here
            while e.parent and e.tag != tag:
                e = e.parent
            if e.parent:
                here = e.parent
            continue
        if tag in BLOCK:
            close()
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag in CONTROLS and not re.search(r"type\s*=\s*[\"']?hidden", m.group(3), re.I):
            here.controls += 1
        if tag in VOID:
            continue
        if tag in RAW:
            if tag != "head" and not m.group(3).endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if tag not in MAY_STAY_OPEN:
                    at = end.end() if end else n
                elif end is None:
                    unclosed.add(tag)
                elif not re.compile(rf"<{tag}[\s/>]", re.I).search(page, at, end.start()):
                    at = end.end()
            continue
        if tag in ("html", "body") and here.parent is None:
            continue
        for closes in (CLOSES.get(tag, ()), ("p",) if tag in BLOCK else ()):
            e = here
            while e.parent and e.tag not in closes and (e.tag not in BLOCK or e.tag == "p"):
                e = e.parent
            if e.parent and e.tag in closes:
                here = e.parent
        e = Element(tag, here, m.group(3))
        elements.append(e)
        if not m.group(3).endswith("/"):
            here = e
    close()
    weigh(elements)
    return blocks


#: weights of the classifier (positive: content).  Chosen by hand so that prose
#: of any length inside trusted boilerplate costs one (2 - 3), a link list inside
#: an article stays just positive (2.2 - 2), and prose in unnamed elements two.
WEIGHTS = {"bias": -1.2, "words": 0.55, "links": -4.5, "sentence": 0.7, "paragraph": 0.9, "heading": 0.6,
           "item": -0.5, "content": 2.2, "soft": -2.2, "boilerplate": -3.0, "hidden": -9.0}
TEXT_BOUND = 2.0
NEAR = 0.9  # capacity between neighbours of one parent
ACROSS = 0.25  # share of it left across the border of a region
FORM_CHARS = 100  # prose a form may hold per control before its tag is doubted


def content_score(b: Block) -> float:
    """Log odds that a block is content."""
    w, e = WEIGHTS, b.home
    n = b.text.count(" ") + 1
    s = w["bias"] + w["words"] * min(n, 60) ** 0.5 + w["links"] * b.links / b.chars
    if b.text[-1] in ".!?…。:;\"'”»)":
        s += w["sentence"]
    if e.tag in ("p", "blockquote", "pre"):
        s += w["paragraph"]
    if e.head:
        s += w["heading"]
    if e.tag in ("li", "td", "th", "dt", "dd"):
        s += w["item"]
    return TEXT_BOUND * math.tanh(s / TEXT_BOUND) + surroundings(e)


def surroundings(e: Element) -> float:
    """What the elements around a block say: boilerplate as far as it is
    trusted, the nearest other region for the rest."""
    w = WEIGHTS
    region = e.region
    while region.kind == BOILERPLATE and region.parent:
        region = region.parent.region
    if region.kind == HIDDEN:
        return w["hidden"]
    other = w["content"] if region.kind == CONTENT else w["soft"] if region.kind == SOFT else 0.0
    return (1 - e.doubt) * w["boilerplate"] + e.doubt * other


def tree_distance(a: Element, b: Element) -> int:
    n = 0
    while a is not b:
        n += 1
        if a.depth >= b.depth and a.parent:
            a = a.parent
        elif b.parent:
            b = b.parent
        else:
            break
    return n


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: page neighbours, and the last earlier block of the
    same parent element; weaker the further apart in the tree, and across the
    border of a region."""
    def near(a: Element, b: Element) -> float:
        return NEAR if a.region is b.region and a.doubt == b.doubt else NEAR * ACROSS

    out, last = [], {}
    for i, b in enumerate(blocks):
        parent = id(b.home.parent)
        if i:
            before = blocks[i - 1].home
            out.append((i - 1, i, near(before, b.home) / (1 + 0.5 * max(0, tree_distance(before, b.home) - 2))))
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, near(blocks[last[parent]].home, b.home) / 2))
        last[parent] = i
    return out


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Content labels of least total cost: a block pays ``|unary|`` for the
    label against its sign, an edge its capacity if its ends differ.

    Blocks whose own cost outweighs all their edges are settled first (their
    label is the same in every minimum cut) and add to their neighbours'
    costs; the rest is solved by augmenting paths.
    """
    n = len(unary)
    cost, near = list(unary), [dict() for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(cost[i]) >= sum(near[i].values()):
            label[i] = cost[i] > 0
            for j, c in near[i].items():
                cost[j] += c if label[i] else -c
                near[j].pop(i)
                todo.append(j)
            near[i] = {}
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        for i in _source_side(open_, cost, near):
            label[i] = True
    return [bool(x) for x in label]


def _source_side(nodes: list[int], cost: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source (content) side of the minimum cut, by shortest
    augmenting paths."""
    s, t = -1, -2
    rest: dict[int, dict[int, float]] = {s: {}, t: {}}
    for i in nodes:
        rest[i] = dict(near[i])
        if cost[i] > 0:
            rest[s][i] = cost[i]
            rest[i].setdefault(s, 0.0)
        elif cost[i] < 0:
            rest[i][t] = -cost[i]
            rest[t][i] = 0.0
    while True:
        back, todo = {s: s}, deque([s])
        while todo and t not in back:
            i = todo.popleft()
            for j, c in rest[i].items():
                if c > 1e-9 and j not in back:
                    back[j] = i
                    todo.append(j)
        if t not in back:
            return {i for i in back if i >= 0}
        path, j = [], t
        while j != s:
            path.append((back[j], j))
            j = back[j]
        flow = min(rest[a][b] for a, b in path)
        for a, b in path:
            rest[a][b] -= flow
            rest[b][a] = rest[b].get(a, 0.0) + flow


def main_text(page: str | None) -> str:
    """Main text of a page, one line per block (null or no content: empty)."""
    blocks = read_blocks(page or "")
    keep = min_cut([content_score(b) for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col, url_col, text, n_chars`` (code points).

    Null or empty html: empty text.  Null ids and urls are kept, repeated
    rows give repeated results.  Empty table: no rows.
    """
    def run(batches):  # noqa: ANN001
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["id", "url", "text", "n_chars"])

    return (pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
            .mapInArrow(run, "id long, url string, text string, n_chars long")
            .withColumnsRenamed({"id": id_col, "url": url_col}))
