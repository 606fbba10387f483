"""Elements of HTML pages with their nesting: one pass over a page's tags with a stack of open elements."""

from __future__ import annotations

import re
from typing import NamedTuple

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b(?P<rawattributes>(?:[^>"']|"[^"]*"|'[^']*'|["'])*+)>.*?(?P<rawend></(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*'|["'])*+)>""",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Text of nothing but blanks, between tags or at a page's ends.
BLANK_TEXT = re.compile(r"(?<=>)\s+(?=<)|\A\s+(?=<)|(?<=>)\s+\Z")
#: Elements that have no content.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: An element of this kind ends where another of its group begins, unless one of these has been opened since.
ENDS = {"li": ({"li"}, ("ul", "ol")), "tr": ({"tr"}, ("table",)), "td": ({"td", "th"}, ("tr", "table")), "th": ({"td", "th"}, ("tr", "table")), "option": ({"option"}, ("select",)), "p": ({"p"}, ("div", "td", "th", "li", "table", "article", "blockquote"))}


class Node(NamedTuple):
    """An element, or a comment (tag ``#comment``): its depth and where it and its content begin and end."""

    tag: str
    attributes: str
    depth: int
    start: int
    inner_start: int
    inner_end: int
    end: int

    def value(self, name: str) -> str | None:
        """The attribute's value, empty where it has none; None without the attribute."""
        for key, *values in ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return "".join(values)
        return None


def nodes(page: str) -> list[Node]:
    """All elements and comments by start.

    A closing tag ends the last open element of its name and all within that
    aren't closed; without such an element it is ignored. What isn't closed at
    all ends with the page.
    """
    found: list[Node] = []
    stack: list[int] = []
    places: dict[str, list[int]] = {}  # by tag, the stack's places of its open elements

    def last(tag: str) -> int:
        own = places.get(tag)
        return own[-1] if own else -1

    def end_from(place: int, inner_end: int, end: int) -> None:
        for k in range(len(stack) - 1, place - 1, -1):
            node = found[stack[k]]
            found[stack[k]] = node._replace(inner_end=inner_end, end=end if k == place else inner_end)
            places[node.tag].pop()
        del stack[place:]

    for m in TOKEN.finditer(page):
        start, stop = m.span()
        if m["raw"]:
            found.append(Node(m["raw"].lower(), m["rawattributes"], len(stack), start, m.end("rawattributes") + 1, m.start("rawend"), stop))
        elif not m["tag"]:
            found.append(Node("#comment", "", len(stack), start, start, stop, stop))
        elif m["close"]:
            place = last(m["tag"].lower())
            if place >= 0:
                end_from(place, start, stop)
        else:
            tag = m["tag"].lower()
            if tag in ENDS:
                group, barriers = ENDS[tag]
                place = max(map(last, group))
                if place > max(map(last, barriers)):
                    end_from(place, start, start)
            empty = tag in VOID or m["attributes"].endswith("/")
            found.append(Node(tag, m["attributes"], len(stack), start, stop, stop if empty else len(page), stop if empty else len(page)))
            if not empty:
                places.setdefault(tag, []).append(len(stack))
                stack.append(len(found) - 1)
    return found


def inner(page: str, tag: str, attribute: str | None, value: str | None, match: str = "equal") -> list[str]:
    """Content of the elements of this tag, those within others included.

    With an attribute, only of those whose value equals the given one, begins
    with it (``prefix``) or has it among its blank-separated words (``word``).
    """

    def fits(node: Node) -> bool:
        own = node.value(attribute) if attribute else ""
        return own is not None and (not attribute or {"equal": own == value, "prefix": own.startswith(value), "word": value in own.split()}[match])

    return [page[n.inner_start : n.inner_end] for n in nodes(page) if n.tag == tag and fits(n)]


def without(page: str, ids: tuple[str, ...], classes: tuple[str, ...]) -> str:
    """The page without scripts, comments, the first element of each id, elements of the classes, and texts of blanks only."""
    left = set(ids)
    out, at = [], 0
    for n in nodes(page):
        own = n.value("id") if left and n.attributes else None
        gone = n.tag in ("script", "#comment") or (classes and n.attributes and not {*(n.value("class") or "").split()}.isdisjoint(classes))
        if own in left and own is not None:
            left.discard(own)
            gone = True
        if gone and n.end > at:
            out.append(page[at : max(n.start, at)])
            at = n.end
    return BLANK_TEXT.sub("", "".join([*out, page[at:]]))
