"""JSON by a scanner that keeps offsets; the data tree and the structure tree."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..tree import Node, Positions, document, keyed

_SPACE = re.compile(r"[ \t\r\n]*")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_ATOM = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


@dataclass
class Value:
    kind: str  # object, array, string, number, true, false, null
    start: int
    end: int
    text: str = ""
    members: list | None = None  # (key value, value) pairs or values


def unescaped(raw: str) -> str:
    """Escapes decoded one by one; a lone surrogate is dropped."""

    def one(m: re.Match) -> str:
        e = m.group(1)
        if e[0] == "u" and len(e) == 5:
            code = int(e[1:], 16)
            return "" if 0xD800 <= code <= 0xDFFF else chr(code)
        return _ESCAPES.get(e, e)

    return _ESCAPE.sub(one, raw) if "\\" in raw else raw


class Scanner:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def fail(self):
        raise ValueError(f"bad JSON at offset {self.at}")

    def document(self) -> list[Value]:
        out = []
        self.space()
        while self.at < len(self.text):
            out.append(self.value())
            self.space()
        if not out:
            self.fail()
        return out

    def value(self) -> Value:
        self.space()
        start, c = self.at, self.text[self.at : self.at + 1]
        if c == '"':
            m = _STRING.match(self.text, start)
            if not m:
                self.fail()
            self.at = m.end()
            return Value("string", start, self.at, unescaped(m.group(1)))
        if c == "{" or c == "[":
            self.at += 1
            members: list = []
            self.space()
            close = "}" if c == "{" else "]"
            while self.text[self.at : self.at + 1] != close:
                if c == "{":
                    key = self.value()
                    self.space()
                    if key.kind != "string" or self.text[self.at : self.at + 1] != ":":
                        self.fail()
                    self.at += 1
                    members.append((key, self.value()))
                else:
                    members.append(self.value())
                self.space()
                if self.text[self.at : self.at + 1] == ",":
                    self.at += 1
                    self.space()
                elif self.text[self.at : self.at + 1] != close:
                    self.fail()
            self.at += 1
            return Value("object" if c == "{" else "array", start, self.at, members=members)
        m = _ATOM.match(self.text, start)
        if not m:
            self.fail()
        self.at = m.end()
        word = m.group()
        return Value(word if word in ("true", "false", "null") else "number", start, self.at, word)


def data(text: str) -> Node:
    """Keys become elements, scalars text, arrays repeat the element of their key (item without one)."""
    where, root = Positions(text), Node("element", "document")
    root.at(where.span(0, len(text)))
    for v in Scanner(text).document():
        _fill(root, v, None, where)
    return document(root)


def _fill(parent: Node, v: Value, key: str | None, where: Positions) -> None:
    """Puts a value's content into the element that stands for it."""
    if v.kind == "object":
        for k, member in v.members:
            _pair(parent, k.text, member, where)
    elif v.kind == "array":
        for item in v.members:
            _pair(parent, key or "item", item, where)
    else:
        parent.add_text(v.text)


def _pair(parent: Node, key: str, v: Value, where: Positions) -> None:
    if v.kind == "array":
        for item in v.members:
            _pair(parent, key, item, where)
        return
    e = keyed(parent, key).at(where.span(v.start, v.end))
    e.attrs["field"] = e.name
    if v.kind != "object":
        e.attrs["kind"] = v.kind
    _fill(e, v, key, where)


def structure(text: str) -> Node:
    """object, array, property, key, value, string, number, bool and null."""
    where, root = Positions(text), Node("element", "document")
    root.at(where.span(0, len(text)))

    def put(parent: Node, v: Value) -> None:
        name = "bool" if v.kind in ("true", "false") else v.kind
        e = parent.element(name).at(where.span(v.start, v.end))
        if v.kind == "object":
            for k, member in v.members:
                p = e.element("property").at(where.span(k.start, member.end))
                put(p.element("key").at(where.span(k.start, k.end)), k)
                put(p.element("value").at(where.span(member.start, member.end)), member)
        elif v.kind == "array":
            for item in v.members:
                put(e, item)
        else:
            e.add_text(v.text)

    for v in Scanner(text).document():
        put(root, v)
    return document(root)


def raw(text: str) -> Node:
    """Grammar names: object, pair, string_content and so on, with keys and values as fields."""
    where, root = Positions(text), Node("element", "document")
    root.at(where.span(0, len(text)))

    def put(parent: Node, v: Value) -> None:
        e = parent.element(v.kind, kind=v.kind).at(where.span(v.start, v.end))
        if v.kind == "object":
            for k, member in v.members:
                p = e.element("pair", kind="pair").at(where.span(k.start, member.end))
                put(p.element("key", field="key"), k)
                put(p.element("value", field="value"), member)
        elif v.kind == "array":
            for item in v.members:
                put(e, item)
        elif v.kind == "string":
            e.element("string_content", kind="string_content").add_text(v.text)
        else:
            e.add_text(v.text)

    for v in Scanner(text).document():
        put(root, v)
    return document(root)
