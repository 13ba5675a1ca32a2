"""Main text of web pages by tree scoring.

The markup is read into a light tree with the usual implied end tags. Parts that never
hold the article (menus, footers, forms, scripts, adverts, comments ...; by tag, role and
words of class and id) are cut off. Each remaining paragraph gives points for its length
and commas: all to its parent, half to the next ancestor, a third to the one above. A
container's points are discounted by the share of its text that is in links. The best
container is kept whole, or the article or main element around it. Elsewhere the smallest
element around it and all others that score well is kept, less what is mostly links.

A word of class or id cuts an element only if links make up a third of its text or it holds
no paragraph of PARAGRAPH_CHARS; never inside a sentence, and never an article's own header.

Defined results: null or empty html, and pages without text, give an empty text;
repeated rows are read each.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

# fixed values: element names by role, and the words of class and id that mark what is no article
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
CUT = frozenset("script style nav footer aside form noscript template iframe button select textarea input svg canvas object menu dialog head title label fieldset video audio map xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p pre td blockquote li dd div section article main body h1 h2 h3 h4 h5 h6 figcaption".split())
#: What an element's start ends without its end tag; and where the search for such an element stops.
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
CLOSERS = frozenset().union(*CLOSED_BY.values())
#: End tags of elements inside these don't reach out, but for blocks'.
BARRIERS = frozenset(("table", "td", "th"))
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertisements banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer "
    "discussion disqus footer footers gdpr header headers legal masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
    "promos promoted promotion recommend recommended related replies reply respond rss search share sharing sidebar sidebars signup skyscraper social sponsor sponsored sponsors "
    "subscribe subscription tags toolbar topbar widget widgets".split()
)
LIKELY = frozenset("article body content entry main page post story text blog".split())
TEXTUAL = frozenset("p pre li dt dd td th blockquote figcaption h1 h2 h3 h4 h5 h6".split())
PARAGRAPH_CHARS = 80
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attributes", "parent", "depth", "children", "points", "length", "linked", "own", "dropped", "total", "in_links", "flow", "longest", "_cut", "_within", "_in_article")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.depth = parent.depth + 1 if parent is not None else 0
        self.children: list[Node | str] = []
        self.points, self.length, self.linked = 0.0, 0, 0
        self.own = 0.0  # points of its own paragraphs
        self.dropped = False
        self.total = self.in_links = self.flow = self.longest = 0
        self._cut: bool | None = None
        self._within: bool | None = None
        self._in_article: bool | None = None

    def likely(self) -> bool:
        return self.tag in ("article", "main") or bool(LIKELY & self.names()[0])

    def names(self) -> tuple[set[str], bool]:
        """Words of class and id, and whether the element is hidden or has a role outside the article."""
        words: set[str] = set()
        hidden = False
        for m in _NAMES.finditer(self.attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name in ("class", "id"):
                words.update(_WORDS.findall(value))
            elif name == "role":
                hidden |= value in ROLES
            elif name == "hidden":
                hidden = True
            elif name == "aria-hidden":
                hidden |= value == "true"
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "")
        return words, hidden

    def cut(self) -> bool:
        if self._cut is None:
            self._cut = self._is_cut()
        return self._cut or self.dropped

    def _is_cut(self) -> bool:
        if self.tag in CUT:
            return True
        if self.tag in ("html", "body", "article", "main"):
            return False
        # an article's own heading is part of it
        if self.tag == "header" and not (self.parent is not None and self.parent.in_article()):
            return True
        if not self.attributes.strip():
            return False
        words, hidden = self.names()
        if hidden:
            return True
        unlikely = words & UNLIKELY
        if not unlikely or words & {"article", "main"}:
            return False
        if self.tag not in BLOCK and self.parent is not None and self.parent.tag in TEXTUAL:
            return False
        if unlikely <= {"header", "headers"} and (words & LIKELY or self.parent is not None and self.parent.within()):
            return False
        # a class word alone cuts no text: links make up a third of it, or no paragraph is in it
        return self.longest < PARAGRAPH_CHARS or self.in_links * 3 > self.total

    def in_article(self) -> bool:
        """Whether this or an element around it is an article or main element."""
        return self._up("_in_article", lambda n: n.tag in ("article", "main"), lambda n: False)

    def within(self) -> bool:
        """Whether this or an element around it, below the body, is likely an article's."""
        return self._up("_within", Node.likely, lambda n: n.tag in ("body", "html"))

    def _up(self, kept: str, yes, no) -> bool:
        line: list[Node] = []
        up: Node | None = self
        while up is not None and getattr(up, kept) is None:
            line.append(up)
            up = up.parent
        told = up is not None and getattr(up, kept)
        for n in reversed(line):
            told = not no(n) and (told or yes(n))
            setattr(n, kept, told)
        return bool(told)


def weigh(root: Node) -> None:
    """Fills in, for each element: characters of text, of links, of its own flow of text, and of the longest flow in it; less what its tag cuts."""
    order, stack = [], [root]
    while stack:
        here = stack.pop()
        order.append(here)
        stack += [c for c in here.children if not isinstance(c, str) and c.tag not in CUT]
    for here in reversed(order):
        for c in here.children:
            if isinstance(c, str):
                n = len(c.strip())
                here.total += n
                here.flow += n
            elif c.tag not in CUT:
                here.total += c.total
                here.in_links += c.in_links
                here.longest = max(here.longest, c.longest)
                if c.tag not in BLOCK:
                    here.flow += c.flow
        here.longest = max(here.longest, here.flow)
        if here.tag == "a":
            here.in_links = here.total


class _Open:
    """The open elements, with the places of those of each name, of barriers, and of those that implied end tags look at."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.named: dict[str, list[int]] = {}
        self.barriers: list[int] = []
        self.solid: list[int] = []

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.named.setdefault(node.tag, []).append(at)
        if node.tag in BARRIERS:
            self.barriers.append(at)
        if node.tag in BLOCK or node.tag in CLOSED_BY or node.tag == "button":
            self.solid.append(at)

    def close(self, at: int) -> None:
        """Ends all elements from this place on."""
        while len(self.stack) > at:
            self.named[self.stack.pop().tag].pop()
        for own in (self.barriers, self.solid):
            while own and own[-1] >= at:
                own.pop()

    def end(self, tag: str) -> bool:
        """An end tag; whether an element was open for it."""
        own = self.named.get(tag)
        if not own or tag not in BLOCK and tag not in BARRIERS and self.barriers and self.barriers[-1] > own[-1]:
            return False
        self.close(own[-1])
        return True

    def start(self, tag: str) -> None:
        """Ends the nearest open element that this one's start closes, within its scope."""
        if tag not in CLOSERS:
            return
        for at in reversed(self.solid):
            name = self.stack[at].tag
            if tag in CLOSED_BY.get(name, ()):
                self.close(at)
                return
            if name in SCOPE.get(tag, ()) or name in BLOCK and name not in CLOSED_BY or name in ("td", "th", "li", "dd", "button"):
                return


def parse(source: str) -> Node:
    """A tree of the page in time that follows its length, whatever its tags."""
    root = Node("#root", "", None)
    open_ = _Open(root)
    at = 0
    section_end = -1
    while True:
        m = _TAG.search(source, at)
        top = open_.stack[-1]
        if m is None:
            if at < len(source):
                top.children.append(source[at:])
            return root
        if m.start() > at:
            top.children.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0] == "<![CDATA[":
                if section_end < at:
                    found = source.find("]]>", at)
                    section_end = found if found >= 0 else len(source)
                top.children.append(source[at:section_end].replace("&", "&amp;"))
                at = min(section_end + 3, len(source))
            continue
        tag = m[2].lower()
        if m[1]:
            if not open_.end(tag) and tag == "p":
                top.children.append(Node("p", "", top))
            continue
        open_.start(tag)
        top = open_.stack[-1]
        node = Node(tag, m[3] or "", top)
        top.children.append(node)
        # a slash before the end of a tag means nothing in HTML
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
            continue
        open_.push(node)


def blocks(node: Node) -> list[str]:
    """The texts of the node's blocks in page order, what is cut left out."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(held)).replace("\x00", "")).strip()
        held.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        here, k = stack.pop()
        if k == 0 and here.tag in BLOCK:
            flush()
        if k == len(here.children):
            if here.tag in BLOCK:
                flush()
            continue
        stack.append((here, k + 1))
        child = here.children[k]
        if isinstance(child, str):
            held.append(child)
        elif child.tag == "br":
            held.append(" ")
        elif not child.cut():
            stack.append((child, 0))
    flush()
    return out


def measure(root: Node) -> list[Node]:
    """Fills in text lengths, linked lengths and points; the containers that got points."""
    scored: dict[int, Node] = {}
    stack: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while stack:
        here, done, in_link = stack.pop()
        in_link |= here.tag == "a"
        if not done:
            stack.append((here, True, in_link))
            stack += [(c, False, in_link) for c in here.children if not isinstance(c, str) and not c.cut()]
            continue
        own = [c for c in here.children if isinstance(c, str)]
        inline = [c for c in here.children if not isinstance(c, str) and c.tag not in BLOCK]
        length = sum(len(t.strip()) for t in own)
        here.length = length + sum(c.length for c in here.children if not isinstance(c, str))
        here.linked = (length if in_link else 0) + sum(c.linked for c in here.children if not isinstance(c, str))
        text = length + sum(c.length for c in inline)
        if here.tag not in PARAGRAPH or not text:
            continue
        commas = sum(t.count(",") for t in own) + sum(_commas(c) for c in inline)
        points = (1 + commas + min(text / 100, 3)) * (1 - sum(c.linked for c in inline) / text)
        share = 1.0
        up = here.parent if here.tag in ("p", "pre", "td", "blockquote", "li", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption") else here
        for divisor in (1, 2, 3):
            if up is None or up.tag == "#root":
                break
            up.points += points * share / divisor
            if divisor == 1:
                up.own += points
            scored[id(up)] = up
            up = up.parent
    return list(scored.values())


def _commas(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                total += c.count(",")
            elif c.tag not in BLOCK:
                stack.append(c)
    return total


def final_points(node: Node) -> float:
    return (node.points + (5 if node.likely() else 0)) * (1 - node.linked / max(node.length, 1))


def extract(source: str | None) -> str:
    if not source:
        return ""
    root = parse(source)
    weigh(root)
    scored = measure(root)
    if not scored:
        return "\n\n".join(blocks(root))
    best = max(scored, key=final_points)
    up: Node | None = best
    while up is not None:
        if up.tag in ("article", "main") or up.tag == "div" and {"article"} & up.names()[0]:
            best = up
            if up.tag == "article":
                break
        up = up.parent
    if best.parent is None or best.tag in ("body", "html", "main", "article"):
        return "\n\n".join(blocks(best))
    least = max(10.0, 0.2 * final_points(best))
    good = [best, *(n for n in scored if n.own * (1 - n.linked / max(n.length, 1)) >= least)]
    # the parent, or whatever higher element is around all that score well
    around = best.parent
    spine: set[int] = set()
    for n in good:
        spine.add(id(n))
        up = n.parent
        while up is not None and id(up) not in spine:
            spine.add(id(up))
            up = up.parent
        # all that was met before and is not within around is around it
        if up is not None and up.depth < around.depth:
            around = up
    inside = {id(n) for n in good}
    stack = [around]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str) or id(c) in inside:
                continue
            if id(c) in spine:
                stack.append(c)
            elif c.tag in BLOCK and c.linked > 0.5 * c.length:
                c.dropped = True
    return "\n\n".join(blocks(around))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches, "html"):
        texts = [extract(x) for x in batch.column("html").to_pylist()]
        names = [n for n in batch.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])


def report(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    made = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return made.mapInArrow(_texts, T.StructType([made.schema["page_id"], made.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
