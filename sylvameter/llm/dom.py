"""A small tolerant HTML reader: a tree of block elements with their text runs.

Nodes nest to DEPTH. Blocks below that still part the text around them, and what lies in one that ``skips`` names is left
out, but they have no nodes: a page of any nesting has a tree that recursion can walk, and no text is lost.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import chain

from sylvameter.llm.marks import told

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Levels of nodes in a tree.
DEPTH = 100

#: Elements by their part in the reading.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg noframes xmp annotation annotation-xml".split())
BLOCK = frozenset(
    "html head body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes, if it is open inside the nearest of the second set.
_CLOSES = {
    **dict.fromkeys(BLOCK - {"html", "body", "option", "button", "legend", "summary", "caption"}, ({"p"}, {"td", "th", "div", "article", "section", "li", "blockquote", "body"})),
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}


@dataclass(slots=True, eq=False)
class Node:
    """A block element. ``marks`` are the telling words of its class and role, ``ids`` those of its id, and ``aside`` says
    that its class or role is of no article's part; parts are text runs and blocks in order."""

    tag: str
    key: str = ""
    marks: frozenset[str] = frozenset()
    ids: frozenset[str] = frozenset()
    parts: list[Node | str] = field(default_factory=list)
    linked: int = 0  # characters of its own text inside links
    aside: bool = False

    @property
    def kind(self) -> str:
        return f"{self.tag}.{self.key}" if self.key else self.tag


_NONE: frozenset[str] = frozenset()
#: Elements that are known by their tag alone, whatever class they have.
_PLAIN = frozenset("html body article main p h1 h2 h3 h4 h5 h6 li td tr".split())


def _node(tag: str, attrs: str) -> Node:
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if "=" in attrs else {}
    if not named:
        return Node(tag)
    classes = named.get("class", "")
    key = "" if tag in _PLAIN else next((x for x in classes.split() if not any(map(str.isdigit, x))), "")
    marks, aside = told(f"{classes} {named.get('role', '')}")
    return Node(tag, key, marks, told(named["id"])[0] if "id" in named else _NONE, aside=aside)


def parse(source: str | None, skips: Callable[[Node], bool] = lambda node: False) -> Node:
    """The tree of a page. Comments, scripts, styles and other raw elements leave nothing; no input is an error."""
    root = Node("#root")
    stack: list[Node] = [root]  # open blocks, the innermost last
    opened: Counter = Counter()  # their tags
    deep: list[Node] = []  # open blocks below DEPTH
    hidden = 0  # how many of these are skipped
    text: list[str] = []
    links = at = 0

    def flush() -> None:
        if text:
            run = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if run and not hidden:
                stack[-1].parts.append(run)

    def close() -> str:
        nonlocal hidden
        node = (deep or stack).pop()
        opened[node.tag] -= 1
        if hidden and len(stack) > DEPTH:
            hidden -= skips(node)
        return node.tag

    source = source or ""
    for_end = len(source)
    while at < for_end:
        found = _TOKEN.search(source, at)
        piece = source[at : found.start()] if found else source[at:]
        if piece:
            text.append(piece)
            if links:
                stack[-1].linked += len(piece)
        if not found:
            break
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        if found["end"] or found["end2"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK and opened[tag] > 0:
                flush()
                while close() != tag:
                    pass
                links = 0
            continue
        attrs = found["attrs"] or found["attrs2"] or ""
        if tag in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else for_end
            text.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK:
            flush()
            links = 0
            closed, limit = _CLOSES.get(tag, ((), ()))
            if any(opened[t] > 0 for t in closed):
                for i, above in enumerate(chain(reversed(deep), reversed(stack[1:])), 1):
                    if above.tag in closed:
                        for _ in range(i):
                            close()
                        break
                    if above.tag in limit:
                        break
            node = _node(tag, attrs)
            opened[tag] += 1
            if len(stack) <= DEPTH:
                stack[-1].parts.append(node)
                stack.append(node)
            else:
                deep.append(node)
                hidden += skips(node)
    flush()
    return root
