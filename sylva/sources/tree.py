"""Trees that parsers build: ordered nodes with pre-order numbers and subtree ends."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

#: Attributes that every positioned element answers to.
POSITIONS = ("line", "column", "end_line", "end_column")


class Node:
    """A document, element, text, comment, pi or attribute node."""

    __slots__ = ("attrs", "children", "column", "depth", "end_column", "end_line", "kind", "line", "name", "ord", "parent", "post", "pre", "text", "value")

    def __init__(self, kind: str, name: str | None = None, text: str | None = None, attrs: dict[str, str] | None = None):
        self.kind, self.name, self.text = kind, name, text
        self.attrs = attrs if attrs is not None else {}
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.line = self.column = self.end_line = self.end_column = None
        self.pre = self.post = self.depth = self.ord = 0
        self.value: str | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def element(self, name: str, **attrs: str) -> Node:
        return self.add(Node("element", name, attrs=attrs))

    def add_text(self, text: str) -> Node | None:
        return self.add(Node("text", text=text)) if text else None

    def at(self, span: tuple[int, int, int, int]) -> Node:
        self.line, self.column, self.end_line, self.end_column = span
        return self

    def descendants(self) -> Iterator[Node]:
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def string_value(self) -> str:
        if self.value is None:
            if self.kind in ("text", "comment", "pi", "attribute"):
                self.value = self.text or ""
            else:
                self.value = "".join(n.text or "" for n in self.descendants() if n.kind == "text")
        return self.value

    def attribute(self, name: str) -> Node | None:
        value = self.attrs.get(name)
        if value is None and name in POSITIONS and self.kind == "element":
            number = getattr(self, name)
            value = None if number is None else str(number)
        if value is None:
            return None
        made = Node("attribute", name, value)
        made.parent, made.pre = self, self.pre
        return made

    def attribute_names(self) -> list[str]:
        own = [p for p in POSITIONS if p not in self.attrs and self.kind == "element" and getattr(self, p) is not None]
        return [*self.attrs, *own]


def document(root: Node | None = None) -> Node:
    doc = Node("document")
    if root is not None:
        doc.add(root)
    return doc


def number(doc: Node) -> Node:
    """Sets pre, post, depth and ord of all nodes of a tree."""
    at = 0
    stack: list[tuple[Node, int]] = [(doc, 0)]
    doc.pre, doc.depth, doc.ord = 0, 0, 0
    while stack:
        node, k = stack.pop()
        if k < len(node.children):
            child = node.children[k]
            at += 1
            child.pre, child.depth, child.ord = at, node.depth + 1, k
            stack.append((node, k + 1))
            stack.append((child, 0))
        else:
            node.post = at
    return doc


class Positions:
    """1-based line and byte column of character offsets."""

    def __init__(self, text: str):
        self.text, self.ascii = text, text.isascii()
        self.starts = [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset)
        begin = self.starts[line - 1]
        return line, (offset - begin if self.ascii else len(self.text[begin:offset].encode())) + 1

    def span(self, start: int, end: int) -> tuple[int, int, int, int]:
        return (*self.at(start), *self.at(end))


def sanitized(name: str) -> str:
    """A key as an XML name: characters that names cannot hold become underscores."""
    out = "".join(c if c == "_" or c.isalnum() or c in "-." else "_" for c in name)
    return out if out and (out[0] == "_" or out[0].isalpha()) else "_" + out


def keyed(parent: Node, key: str) -> Node:
    """A child element named by a key; the key is kept where the name differs."""
    name = sanitized(key)
    return parent.element(name, key=key) if name != key else parent.element(name)


def subtree_text(node: Node, indent: int | None = None, depth: int | None = None, meta: bool = False) -> str:
    """XML text of a subtree; indent None is compact, depth cuts below so many levels."""
    import xml.sax.saxutils as x

    def attributes(n: Node) -> str:
        shown = n.attribute_names() if meta else [a for a in n.attrs if a not in ("kind", "field")]
        return "".join(f" {a}={x.quoteattr(n.attribute(a).text or '')}" for a in shown)

    def write(n: Node, level: int) -> list[str]:
        pad = "" if indent is None else " " * indent * level
        if n.kind == "text":
            return [pad + x.escape(n.text or "")]
        if n.kind == "comment":
            return [f"{pad}<!--{n.text}-->"]
        if n.kind == "pi":
            return [f"{pad}<?{n.name} {n.text}?>"]
        if n.kind == "attribute":
            return [n.text or ""]
        if n.kind == "document":
            return [line for c in n.children for line in write(c, level)]
        head = f"<{n.name}{attributes(n)}"
        if not n.children:
            return [f"{pad}{head}/>"]
        if depth is not None and level >= depth:
            return [f"{pad}{head}>...</{n.name}>"]
        if all(c.kind == "text" for c in n.children):
            return [f"{pad}{head}>{x.escape(n.string_value())}</{n.name}>"]
        inner = [line for c in n.children for line in write(c, level + 1)]
        return [f"{pad}{head}>", *inner, f"{pad}</{n.name}>"]

    return ("" if indent is None else "\n").join(write(node, 0))
