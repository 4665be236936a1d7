"""Main text of web pages by scoring the element tree.

Paragraph-like blocks pass points (for length and commas) to their ancestors, less with every level (``SHARES``, then ``FADE`` for each
level more); an element's points count by one minus its link density. The best container is kept, with what stands beside it: paragraphs however short,
loose text, and whatever else says something, unless much of it is links. Menus, headers, footers, sidebars, notices, adverts, forms, comments
and the like are left out wherever they stand. Most element names and hidden marks are final. A class, an id, a role, or being a form or
dialog is not: a name of the text itself beside it, a <main> inside, or more text than the rest of the page with few links
lets an element in (the last not for a role nor for ``ASIDE``, what readers or third parties say). If nothing is left of a page, class and id names are
disregarded altogether.

One pass over the pages; each page is parsed on its own, in time linear in its length however deep its elements nest: what is asked
of ancestors is kept at every element, and sums run once from the leaves to the root.
"""

from __future__ import annotations

import heapq
import html
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

# Element names of HTML by the part they play here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript textarea title iframe xmp noembed noframes".split())
SKIP = RAW | set("head nav footer aside button select option svg math canvas object audio video map menu datalist input".split())
#: Left out unless they hold the page's text, as some servers wrap a whole page in a form.
WRAPS = set("form fieldset dialog".split())
#: Text that a form needs, besides being most of its page's, in characters.
LEAST_WRAPPED = 250
#: Parts of tables, whose rows belong together.
TABLE = set("td th tr tbody thead tfoot".split())
#: What is beside the best container without a paragraph of its own needs so many characters.
LEAST_BESIDE = 25
BLOCK = set("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = set("p pre blockquote td dd li h2 h3 h4 h5 h6".split())
#: Elements of running text, which belong to the container beside them whatever they score.
BESIDE = set("p ul ol dl blockquote table pre figure h3 h4 h5 h6".split())
CLOSES_P = BLOCK - set("caption td th tr tbody thead tfoot body html".split())
#: An opening element ends an open one of these, looked for up to the given container.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id or role that mark an element as not being the text, or as being it.
LEAVE = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion comment comments disqus reply replies respond discussion sidebar side footer foot header masthead topbar nav navbar navigation menu breadcrumb breadcrumbs pagination pager related recommended share sharing social cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login widget toolbar tags meta skip hidden outbrain taboola search contentinfo complementary rail legal copyright".split())
HOLD = set("article content entry main post story text body blog page".split())
#: Words of LEAVE that stay out however much text they hold.
ASIDE = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion comment comments disqus reply replies respond discussion cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login hidden outbrain taboola nav navbar navigation menu".split())
#: A class that begins so tells of what the page has or lacks, not what the element is.
ABOUT = set("has no not non with without".split())

#: Part of a paragraph's points that reaches the ancestor so many levels up, and what is left of it for each level beyond.
SHARES = [1.0, 0.5, *(1 / (3 * n) for n in range(2, 9))]
FADE = 0.9

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</?[A-Za-z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^>])*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+")


#: Elements that hold an open paragraph back from what follows, and those that ``ENDS`` looks for.
P_HOLDERS = frozenset("p div article section td li main".split())
SCOPES = [(name, own | stop) for name, (own, stop) in ENDS.items()]


class Node:
    __slots__ = ("name", "parent", "parts", "hold", "leave", "soft", "aside", "wraps", "inner", "scopes")

    def __init__(self, name: str, parent: Node | None, called: list[set[str]] = (), hidden: bool = False, roles: set[str] = frozenset()):  # noqa: F821
        """``called``: the words of each class and id; ``hidden``: out by another attribute; ``roles``: words of its roles."""
        self.name, self.parent, self.parts = name, parent, []
        #: whether an <article> or <main> stands around it
        self.inner = parent is not None and (parent.inner or parent.name in ("article", "main"))
        self.scopes = parent.scopes if parent else {}
        of = [k for k, names in SCOPES if name in names]
        if name in P_HOLDERS:
            of.append("p")
        if of:
            self.scopes = {**self.scopes, **dict.fromkeys(of, self)}
        self.hold = name in ("article", "main") or bool(roles & HOLD) or any(c & HOLD for c in called)
        told = [c & LEAVE for c in called]
        own = name not in ("html", "body", "article", "main") and any(told) and not any(c & HOLD and not t for c, t in zip(called, told, strict=True))
        # a role says what an element is; only a role of the text, or a <main> inside, speaks against it
        role = name not in ("html", "body", "article", "main") and bool(roles & LEAVE) and not roles & HOLD
        self.aside = role or (own and any(t & ASIDE for t in told))
        own = (own or role) and not (roles & HOLD and not role)
        wraps = name in WRAPS
        self.leave = name in SKIP or hidden or own or wraps
        #: left out by class, id or role alone, or as a form
        self.soft = (own or wraps) and not (name in SKIP or name == "header" or hidden)
        self.wraps = wraps


def parse(page: str) -> Node:
    """The element tree; forgives missing and stray end tags, and pages that break off anywhere."""
    root = Node("html", None)
    here, at = root, 0
    open_: dict[str, list[Node]] = {}  # open elements by name, the innermost last

    def close(node: Node) -> None:
        nonlocal here
        while True:
            open_[here.name].pop()
            here, last = here.parent, here
            if last is node:
                return

    while m := _TOKEN.search(page, at):
        token = m.group()
        if m.start() > at:
            here.parts.append(page[at : m.start()])
        at = m.end()
        if token[1] in "!?":
            continue
        found = re.match(r"</?([A-Za-z][^\s/>]*)", token)
        name = found[1].lower()
        if token[1] == "/":
            if open_.get(name):
                close(open_[name][-1])
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P and (p := here.scopes.get("p")) and p.name == "p":
            close(p)
        if name in ENDS and (x := here.scopes.get(name)) and x.name in ENDS[name][0]:
            close(x)
        called, hidden, roles = [], False, set()
        if len(token) > len(found[0]) + 1:
            for key, value in _ATTRIBUTE.findall(token[len(found[0]) : -1 if token.endswith(">") else None]):
                key = key.lower()
                if key in ("class", "id"):
                    names = [_WORDS.findall(c) for c in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value.strip("\"'")).lower().split()]
                    called += [set(c) for c in names if c and c[0] not in ABOUT]
                elif key == "role":
                    roles.update(_WORDS.findall(value.lower()))
                elif key == "hidden" or (key == "aria-hidden" and "true" in value) or (key == "style" and re.search(r"display\s*:\s*none", value)):
                    hidden = True
        node = Node(name, here, called, hidden, roles)
        here.parts.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif not token.endswith("/>"):
            here = node
            open_.setdefault(name, []).append(node)
    if at < len(page):
        here.parts.append(page[at:])
    return root


def _left_out(node: Node) -> bool:
    return not node.inner if node.name == "header" else node.leave


def _up(node: Node) -> Iterator[Node]:
    while (node := node.parent) is not None:
        yield node


def text_of(node: Node) -> str:
    """Text of an element without what is left out; block ends and <br> count as white space, one space each run."""
    out: list[str] = []
    stack = [iter(node.parts)]
    names = [node.name]
    while stack:
        for part in stack[-1]:
            if isinstance(part, str):
                out.append(part)
            elif not _left_out(part):
                if part.name in BLOCK or part.name == "br":
                    out.append(" ")
                stack.append(iter(part.parts))
                names.append(part.name)
                break
        else:
            stack.pop()
            if names.pop() in BLOCK:
                out.append(" ")
    return " ".join(html.unescape("".join(out)).split())


def _walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [p for p in reversed(node.parts) if not isinstance(p, str) and not _left_out(p)]


def _sizes(root: Node) -> dict[int, tuple[int, int]]:
    """(length of text, of it within links) of every element that is not left out."""
    order = list(_walk(root))
    sizes: dict[int, list[int]] = {id(n): [0, 0] for n in order}
    for node in reversed(order):
        own = sizes[id(node)]
        own[0] += sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        if node.name == "a":
            own[1] = own[0]
        if node is not root:
            up = sizes[id(node.parent)]
            up[0] += own[0]
            up[1] += own[1]
    return sizes


def _points(commas: int, length: int) -> int:
    return 1 + commas + min(3, length // 100)


@dataclass(slots=True)
class Flow:
    """What a stretch of text amounts to once its white space is single: words, letters in them, commas, and whether it begins and ends with
    white space."""

    words: int = 0
    letters: int = 0
    commas: int = 0
    open: bool = True
    shut: bool = True

    def add(self, other: Flow) -> None:  # noqa: F821
        if not other.words:
            self.shut = self.shut or other.open
            return
        if not self.words:
            self.open = self.shut or other.open
        elif not (self.shut or other.open):
            self.words -= 1
        self.words += other.words
        self.letters += other.letters
        self.commas += other.commas
        self.shut = other.shut

    def gap(self) -> None:
        self.shut = True

    @property
    def length(self) -> int:
        return self.letters + max(0, self.words - 1)


def _flow(text: str) -> Flow:
    text = html.unescape(text)
    own = text.split()
    return Flow(len(own), sum(map(len, own)), text.count(","), text[:1].isspace(), text[-1:].isspace()) if own else Flow(0, 0, 0, text != "", text != "")


def _let_in(root: Node) -> None:
    """Takes back ``leave`` where only a class or id says so and the element is the page's text after all."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in node.parts if not isinstance(p, str) and (p.soft or not _left_out(p))]
    if not any(n.soft for n in order):
        return
    # pieces of text of its own, their length and commas; points of its paragraphs, size, size within links, whether it holds a <main>
    own = {id(n): [0, 0, 0, 0, 0, 0, n.name == "main"] for n in order}
    for node in reversed(order):
        x = own[id(node)]
        for p in node.parts:
            if isinstance(p, str) and (t := p.strip()):
                x[0] += 1
                x[1] += len(t)
                x[2] += t.count(",")
        size = x[1]
        x[4] += size
        if node.name == "a":
            x[5] = x[4]
        flows = node.name in PARAGRAPH or node.name in BLOCK or node.name == "div" or node is root
        if flows and x[0] and x[5] <= 0.6 * x[4]:
            x[3] += _points(x[2], x[1] + x[0] - 1)
        up = own[id(node.parent)] if node is not root else None
        if up:
            if not flows:
                for i in range(3):
                    up[i] += x[i]
                up[4] += x[4] - size
            else:
                up[4] += x[4]
            # what stays out adds nothing to those around it
            up[3] += 0 if node.aside else x[3]
            up[5] += x[5]
            up[6] |= x[6]
    inside, edge = 0, []

    def enter(node: Node) -> None:
        nonlocal inside
        stack = [node]
        while stack:
            n = stack.pop()
            inside += own[id(n)][3]
            for p in n.parts:
                if isinstance(p, str) or id(p) not in own:
                    continue
                inside -= 0 if p.aside else own[id(p)][3]
                if p.soft and own[id(p)][6]:
                    p.leave = False
                if not p.leave:
                    stack.append(p)
                elif not p.aside:
                    heapq.heappush(edge, (-own[id(p)][3], len(edge), id(p), p))

    enter(root)
    while edge and -edge[0][0] > inside:
        node = heapq.heappop(edge)[-1]
        size, links = own[id(node)][4:6]
        if links < 0.25 * max(1, size) and not (node.wraps and size < LEAST_WRAPPED):
            node.leave = False
            enter(node)


def _scores(nodes: list[Node], density: Callable[[Node], float]) -> dict[int, float]:
    """Points of every element that has a paragraph in it (or is one with text of its own); ``nodes``: parents before children."""
    flows = {id(n): Flow() for n in nodes}
    # points of what lies so many levels below, and of all farther below, faded
    levels: dict[int, list[float]] = {}
    far: dict[int, float] = {}
    depth = len(SHARES)
    out: dict[int, float] = {}
    for node in reversed(nodes):
        key = id(node)
        flow = flows[key]
        own_length = own_commas = n_own = 0
        for p in node.parts:
            if isinstance(p, str):
                flow.add(_flow(p))
                if p.strip():
                    n_own += 1
                own_length += len(p) + 1
                own_commas += p.count(",")
            elif id(p) in flows:
                if p.name in BLOCK or p.name == "br":
                    flow.gap()
                flow.add(flows.pop(id(p)))
                if p.name in BLOCK:
                    flow.gap()
        held = levels.setdefault(key, [0.0] * depth) if key in levels else None
        direct = n_own and node.name in ("div", "section", "article", "main")
        points = 0
        if density(node) <= 0.6:
            if direct:
                points = _points(own_commas, own_length - 1)
            elif node.name in PARAGRAPH and flow.words:
                points = _points(flow.commas, flow.length)
        scored = held is not None or bool(points and direct)
        if points and held is None:
            held = levels[key] = [0.0] * depth
        # a paragraph gives its parent what a <div> with text of its own keeps for itself
        if points and direct:
            held[0] += points
        if scored:
            out[key] = sum(map(operator.mul, held, SHARES)) + far.get(key, 0.0)
        if node.parent is not None and held is not None:
            up = levels.setdefault(id(node.parent), [0.0] * depth)
            for i in range(depth - 1):
                up[i + 1] += held[i]
            if points and not direct:
                up[0] += points
            far[id(node.parent)] = far.get(id(node.parent), 0.0) + FADE * (SHARES[-1] * held[-1] + far.pop(key, 0.0))
            del levels[key]
    return out


def _main_text(root: Node) -> str:
    sizes = _sizes(root)
    density = lambda n: sizes[id(n)][1] / max(1, sizes[id(n)][0])
    nodes = list(_walk(root))
    points = _scores(nodes, density)
    scored = [n for n in reversed(nodes) if id(n) in points]
    if not scored:
        holders = [n for n in nodes if n.hold]
        return text_of(holders[0] if holders else root)
    value = lambda n: (points.get(id(n), 0.0) + (25 if n.name in ("article", "main") else 5 * n.hold)) * (1 - density(n))
    # the first of equal ones, the inner one before the one around it
    best = max(scored, key=value)
    if best.parent is None:
        return text_of(best)
    # an article that only wraps its parts is better than one of the parts
    for up in _up(best):
        if up.name in ("article", "main") and value(up) >= 0.3 * value(best):
            best = up
    return text_of(_with_neighbours(best, sizes, points, value))


def _with_neighbours(best: Node, sizes: dict[int, tuple[int, int]], points: dict[int, float], value: Callable[[Node], float]) -> Node:
    """An element that holds ``best`` and what belongs to it: siblings and loose text, for parts of a table also other rows."""
    whole = best.name in ("article", "main")  # what is beside it is rather another text
    least = max(10.0, 0.2 * value(best))

    def belongs(part: Node) -> bool:
        size, links = sizes[id(part)]
        if whole:
            return id(part) in points and value(part) >= least and (part.name == best.name or links < 0.5 * size)
        if not size or links >= 0.5 * size:
            return False
        return id(part) in points or (links < 0.25 * size and (part.name in BESIDE or part.name in ("h1", "h2") or size >= LEAST_BESIDE))

    here, kept = best, best
    while here.parent is not None:
        out, run = Node(here.parent.name, None), []

        def flush(out: Node = out, run: list = run) -> None:
            """Loose text with the inline elements in it, unless it is mostly links."""
            size = sum(len(p.strip()) if isinstance(p, str) else sizes[id(p)][0] for p in run)
            if not whole and 2 * sum(sizes[id(p)][1] for p in run if not isinstance(p, str)) < size:
                out.parts += run
            run.clear()

        for part in here.parent.parts:
            if isinstance(part, str) or (part is not here and part.name not in BLOCK and not _left_out(part)):
                run.append(part)
            elif part is here or not _left_out(part):
                flush()
                if part is here or belongs(part):
                    out.parts += [" ", kept if part is here else part, " "]
        flush()
        here, kept = here.parent, out
        if best.name not in TABLE or here.name not in TABLE:
            return kept
    return kept


def main_text(page: str | None) -> str:
    """The article of a page; empty for null, empty or text-free pages."""
    if not page:
        return ""
    root = parse(page)
    _let_in(root)
    text = _main_text(root)
    if not text:
        stack, back = [root], False
        while stack:
            n = stack.pop()
            if n.soft and n.leave and not n.wraps:
                n.leave, back = False, True
            stack += [p for p in n.parts if not isinstance(p, str)]
        text = _main_text(root) if back else text
    return text


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text of the whole html, empty if none) and n_chars (its code points).

    Null or empty html: empty text. Rows come back as often as they came, whatever is null in them; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pick(pages, page_id="bigint", url="string", html="string").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
