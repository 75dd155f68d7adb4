"""One pass over a storage or HTML text: its nodes in order, from an explicit stack, within a budget.

No text recurses: depth is the length of the stack. What comes out is flat rows, so trees are queried with joins
and groups (``operators/storage``), never walked.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements without an end tag, and elements that stand in a line of text.
VOID = frozenset(("br", "hr", "img", "col", "wbr"))
INLINE = frozenset(("strong", "b", "em", "i", "code", "u", "s", "del", "strike", "sub", "sup", "span", "a", "br", "ac:link", "ac:emoticon", "ac:placeholder", "time"))
#: Elements that hold what a link leads to.
CONTAINERS = ("ac:link", "a", "ac:image")

_TOKEN = re.compile(r"<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<tag>[^>]*)>|(?P<text>[^<]+|<[^>]*\Z)", re.S)
_NAME = re.compile(r"[A-Za-z][\w:.-]*", re.A)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.A)
#: Characters that XML does not allow, dropped after entities are resolved.
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f￾￿]")


@dataclass(frozen=True)
class Budget:
    """Nodes, depth of elements, and length of all text (in UTF-16 units) that a text may have."""

    nodes: int = 2_000_000
    depth: int = 256
    text: int = 16 << 20


def resolved(text: str) -> str:
    return _ILLEGAL.sub("", html.unescape(text))


def units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def attributes(source: str) -> dict[str, str]:
    """Attributes by name in small letters; of equal names the last holds."""
    out = {}
    for m in _ATTRIBUTE.finditer(source):
        value = m[2] or ""
        out[m[1].lower()] = resolved(value[1:-1] if value[:1] in ("'", '"') else value)
    return out


@dataclass
class Node:
    """``at`` counts from 1 in order of appearance, ``last`` is the last node inside, ``run`` counts the places where blocks begin or end."""

    at: int
    parent: int
    depth: int
    name: str
    attrs: dict[str, str] | None
    text: str | None
    run: int
    link: int
    last: int = 0


def read_nodes(source: str, budget: Budget) -> tuple[str, list[Node]]:
    """(``ok``, nodes), or the limit that the text breaks and no nodes.

    Elements that are not closed end with the text or with an outer one; end tags without a beginning are left
    out. A text's name is that of the block around it; ``link`` is the nearest link or image around a node.
    """
    nodes: list[Node] = []
    # Of each open element: its node, whether blocks may begin in it, the block and the link around what is inside.
    open_: list[tuple[Node | None, bool, str, int]] = [(None, True, "", 0)]
    length = run = 0

    def close(down_to: int) -> None:
        nonlocal run
        while len(open_) > down_to:
            node, is_block, _, _ = open_.pop()
            node.last = len(nodes)
            run += is_block

    for m in _TOKEN.finditer(source):
        parent, in_block, block, link = open_[-1]
        tag = m["tag"]
        if tag is None:
            raw = m["data"] if m["data"] is not None else m["text"]
            text = _ILLEGAL.sub("", raw) if m["data"] is not None else resolved(raw) if raw else ""
            if text:
                length += units(text)
                if length > budget.text:
                    return "text-too-long", []
                if len(nodes) >= budget.nodes:
                    return "too-many-nodes", []
                at = len(nodes) + 1
                nodes.append(Node(at, parent.at if parent else 0, len(open_), block, None, text, run, link, at))
            continue
        tag = tag.strip()
        if tag.startswith("/"):
            name = tag[1:].strip().lower()
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0].name == name:
                    close(k)
                    break
            continue
        alone = tag.endswith("/")
        tag = tag[:-1].strip() if alone else tag
        if not (named := _NAME.match(tag)):
            continue
        name = named[0].lower()
        if len(nodes) >= budget.nodes:
            return "too-many-nodes", []
        begins = in_block and name not in INLINE
        run += begins
        at = len(nodes) + 1
        node = Node(at, parent.at if parent else 0, len(open_), name, attributes(tag[named.end() :]), None, run, link, at)
        nodes.append(node)
        if alone or name in VOID:
            run += begins
            continue
        open_.append((node, begins, name if begins else block, at if name in CONTAINERS else link))
        if len(open_) - 1 > budget.depth:
            return "too-deep", []
    close(1)
    return "ok", nodes
