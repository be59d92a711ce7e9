"""TOML by lines: tables and keys become elements; tomllib checks the text and decodes scalars."""

from __future__ import annotations

import re
import tomllib

from ..tree import Node, Positions, document, keyed

_KEY = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'[^']*'|[A-Za-z0-9_-]+)\s*(\.)?""")
_END = re.compile(r"""[^\s,\]}#][^,\]}#\n]*""")


def structure(text: str) -> Node:
    """document with nested elements; arrays and arrays of tables hold item elements."""
    tomllib.loads(text)
    where, root = Positions(text), Node("element", "document")
    root.at(where.span(0, len(text)))
    now, at = root, 0
    reader = _Reader(text, where)
    while True:
        at = reader.skip(at, lines=True)
        if at >= len(text):
            return document(root)
        if text[at] == "[":
            many = text.startswith("[[", at)
            keys, at = reader.keys(at + 1 + many)
            now = root
            for k, (key, span) in enumerate(keys):
                last = k == len(keys) - 1
                now = reader.child(now, key, span)
                if many and last:
                    reader.tables.add(id(now))
                    now = now.element("item").at(span)
                elif id(now) in reader.tables:
                    now = now.children[-1]
            at = text.index("\n", at) if "\n" in text[at:] else len(text)
        else:
            at = reader.pair(now, at)


class _Reader:
    def __init__(self, text: str, where: Positions):
        self.text, self.where = text, where
        self.tables: set[int] = set()  # elements of arrays of tables

    def skip(self, at: int, lines: bool) -> int:
        spaces = " \t\r\n" if lines else " \t"
        while at < len(self.text):
            if self.text[at] in spaces:
                at += 1
            elif self.text[at] == "#":
                at = self.text.find("\n", at)
                at = len(self.text) if at < 0 else at
            else:
                break
        return at

    def keys(self, at: int) -> tuple[list[tuple[str, tuple]], int]:
        out = []
        while True:
            m = _KEY.match(self.text, at)
            raw = m.group(1)
            name = tomllib.loads(f"k = {raw}")["k"] if raw[0] in "\"'" else raw
            out.append((name, self.where.span(*m.span(1))))
            at = m.end()
            if not m.group(2):
                return out, at

    def child(self, parent: Node, key: str, span: tuple) -> Node:
        for c in parent.children:
            if c.kind == "element" and c.attrs.get("key", c.name) == key:
                return c
        return keyed(parent, key).at(span)

    def pair(self, parent: Node, at: int) -> int:
        keys, at = self.keys(at)
        at = self.skip(at, lines=False) + 1  # the equals sign
        for key, span in keys:
            parent = self.child(parent, key, span)
        return self.value(parent, self.skip(at, lines=False))

    def value(self, e: Node, at: int) -> int:
        text, start = self.text, at
        if text[at] == "[":
            at = self.skip(at + 1, lines=True)
            while text[at] != "]":
                at = self.skip(self.value(e.element("item"), at), lines=True)
                if text[at] == ",":
                    at = self.skip(at + 1, lines=True)
            at += 1
        elif text[at] == "{":
            at = self.skip(at + 1, lines=True)
            while text[at] != "}":
                at = self.skip(self.pair(e, at), lines=True)
                if text[at] == ",":
                    at = self.skip(at + 1, lines=True)
            at += 1
        else:
            for quote in ('"""', "'''", '"', "'"):
                if text.startswith(quote, at):
                    at += len(quote)
                    while not text.startswith(quote, at):
                        at += 2 if text[at] == "\\" and quote[0] == '"' else 1
                    at += len(quote)
                    while len(quote) == 3 and text.startswith(quote[0], at):
                        at += 1
                    e.add_text(tomllib.loads("k = " + text[start:at])["k"])
                    break
            else:
                at = _END.match(text, at).end()
                at = start + len(text[start:at].rstrip())
                e.add_text(text[start:at])
        e.at(self.where.span(start, at))
        return at
