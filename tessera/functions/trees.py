"""JSON document trees as flat rows, from an explicit stack and within budgets; the rows are judged by joins (``operators/schema``)."""

from __future__ import annotations

import json
from dataclasses import dataclass

#: Keys that a node and a mark may have, and keys that no object may have.
NODE_KEYS = ("type", "attrs", "content", "marks", "text", "version")
MARK_KEYS = ("type", "attrs")
FORBIDDEN = frozenset(("__proto__", "prototype", "constructor"))


@dataclass(frozen=True)
class TreeBudget:
    """UTF-8 bytes of the input, of its texts and of its attributes, and numbers of nodes, marks, levels and attribute values."""

    input_bytes: int = 8 << 20
    nodes: int = 100_000
    depth: int = 128
    text_bytes: int = 6 << 20
    attribute_bytes: int = 2 << 20
    marks: int = 200_000
    attribute_values: int = 500_000


class Broken(Exception):
    """A tree that cannot be read: a code and where."""

    def __init__(self, code: str, path: str):
        super().__init__(code, path)
        self.code, self.path = code, path


@dataclass
class Row:
    """A node, or a mark of the node ``parent_type``; ``content`` and ``marks`` are numbers, null where the key is missing."""

    at: int
    path: str
    depth: int
    kind: str
    type: str
    parent_type: str
    other_keys: list[str]
    attrs: dict[str, str] | None
    has_text: bool
    has_version: bool
    content: int | None
    marks: int | None


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


class _Spent:
    def __init__(self, budget: TreeBudget):
        self.budget, self.nodes, self.marks, self.text, self.attribute_bytes, self.values = budget, 0, 0, 0, 0, 0

    def attributes(self, attrs: dict, path: str) -> dict[str, str]:
        """Counts all values below ``attrs``; each attribute's own value as JSON."""
        stack = [(attrs, path, "")]
        while stack:
            value, at, key = stack.pop()
            self.values += 1
            self.attribute_bytes += _size(key)
            if isinstance(value, dict):
                for k in value:
                    if k in FORBIDDEN:
                        raise Broken("invalid-attributes", f"{at}.{k}")
                stack += [(x, f"{at}.{k}", k) for k, x in value.items()]
            elif isinstance(value, list):
                stack += [(x, f"{at}[{i}]", "") for i, x in enumerate(value)]
            else:
                self.attribute_bytes += _size(value) if isinstance(value, str) else 4 if value is None or value is True else 5 if value is False else len(json.dumps(value))
            if self.values > self.budget.attribute_values or self.attribute_bytes > self.budget.attribute_bytes:
                raise Broken("attribute-budget-exceeded", at)
        return {k: json.dumps(x) for k, x in attrs.items()}


def _typed(item, keys: tuple[str, ...], code: str, path: str) -> list[str]:
    """The keys of a node or mark that are none of ``keys``; its type must be a text of 1 to 256 signs."""
    kind = item.get("type")
    if not isinstance(kind, str) or not 0 < len(kind) <= 256:
        raise Broken(code, f"{path}.type")
    for k in item:
        if k in FORBIDDEN:
            raise Broken(code, f"{path}.{k}")
    return [k for k in item if k not in keys]


def _not_json(text: str):
    raise ValueError(text)


def read_tree(source: str | None, budget: TreeBudget) -> tuple[str, str, list[Row]]:
    """(``ok``, ``$``, rows), or what breaks the tree and where, without rows."""
    try:
        return "ok", "$", list(_rows(source or "", budget))
    except Broken as b:
        return b.code, b.path, []


def _rows(source: str, budget: TreeBudget):
    if _size(source) > budget.input_bytes:
        raise Broken("input-too-large", "$")
    try:
        root = json.loads(source, parse_constant=_not_json)
    except RecursionError:
        raise Broken("depth-budget-exceeded", "$") from None
    except ValueError:
        raise Broken("invalid-json", "$") from None
    if not isinstance(root, dict) or root.get("type") != "doc" or not isinstance(root.get("content"), list):
        raise Broken("invalid-root", "$")
    version = root.get("version")
    if isinstance(version, bool) or version != 1:
        raise Broken("unsupported-version", "$.version")
    spent, stack = _Spent(budget), [(root, "$", 0, "")]
    at = 0
    while stack:
        node, path, depth, parent_type = stack.pop()
        if not isinstance(node, dict):
            raise Broken("invalid-node", path)
        spent.nodes += 1
        if spent.nodes > budget.nodes:
            raise Broken("node-budget-exceeded", path)
        if depth > budget.depth:
            raise Broken("depth-budget-exceeded", path)
        other = _typed(node, NODE_KEYS, "invalid-node", path)
        if "text" in node:
            if not isinstance(node["text"], str):
                raise Broken("invalid-node", f"{path}.text")
            spent.text += _size(node["text"])
            if spent.text > budget.text_bytes:
                raise Broken("text-budget-exceeded", f"{path}.text")
        attrs = None
        if "attrs" in node:
            if not isinstance(node["attrs"], dict):
                raise Broken("invalid-attributes", f"{path}.attrs")
            attrs = spent.attributes(node["attrs"], f"{path}.attrs")
        marks, content = node.get("marks", []), node.get("content", [])
        for key, value in (("marks", marks), ("content", content)):
            if not isinstance(value, list):
                raise Broken("invalid-node", f"{path}.{key}")
        at += 1
        yield Row(at, path, depth, "node", node["type"], parent_type, other, attrs, "text" in node, "version" in node, len(content) if "content" in node else None, len(marks) if "marks" in node else None)
        for i, mark in enumerate(marks):
            where = f"{path}.marks[{i}]"
            if not isinstance(mark, dict):
                raise Broken("invalid-mark", where)
            spent.marks += 1
            if spent.marks > budget.marks:
                raise Broken("mark-budget-exceeded", where)
            other = _typed(mark, MARK_KEYS, "invalid-mark", where)
            if "attrs" in mark and not isinstance(mark["attrs"], dict):
                raise Broken("invalid-attributes", f"{where}.attrs")
            at += 1
            yield Row(at, where, depth, "mark", mark["type"], node["type"], other, spent.attributes(mark["attrs"], f"{where}.attrs") if "attrs" in mark else None, False, False, None, None)
        stack += [(child, f"{path}.content[{i}]", depth + 1, node["type"]) for i, child in reversed(list(enumerate(content)))]

