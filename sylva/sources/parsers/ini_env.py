"""INI and env files by lines."""

from __future__ import annotations

import re

from ..tree import Node, Positions, document, keyed

_SETTING = re.compile(r"[ \t]*([^=:\n]+?)[ \t]*[=:][ \t]*([^\n]*)")
_VARIABLE = re.compile(r"[ \t]*(?:export[ \t]+)?([A-Za-z_]\w*)=([^\n]*)")


def _each_line(text: str):
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def ini(text: str) -> Node:
    """document; a section is an element, a setting an element with its value, comments stay."""
    where, root = Positions(text), Node("element", "document")
    root.at(where.span(0, len(text)))
    now = root
    for at, line in _each_line(text):
        bare = line.strip()
        if not bare:
            continue
        begin = at + line.index(bare)
        span = where.span(begin, begin + len(bare))
        if bare[0] in "#;":
            now.element("comment").at(span).add_text(bare[1:].strip())
        elif bare[0] == "[" and "]" in bare:
            now = keyed(root, bare[1 : bare.index("]")].strip()).at(span)
        elif m := _SETTING.match(text, at):
            value = m.group(2).strip()
            e = keyed(now, m.group(1)).at(where.span(m.start(2), m.start(2) + len(value)))
            e.add_text(value)
    return document(root)


def env(text: str) -> Node:
    """document; KEY=value with or without export is an element, comments stay, quotes are taken off."""
    where, root = Positions(text), Node("element", "document")
    root.at(where.span(0, len(text)))
    for at, line in _each_line(text):
        bare = line.strip()
        if bare.startswith("#"):
            begin = at + line.index(bare)
            root.element("comment").at(where.span(begin, begin + len(bare))).add_text(bare[1:].strip())
        elif m := _VARIABLE.match(text, at):
            raw = m.group(2).strip()
            begin = m.start(2)
            if raw[:1] in ("'", '"') and raw.find(raw[0], 1) > 0:
                value = raw[1 : raw.find(raw[0], 1)]
                begin += 1
            else:
                value = raw.split(" #")[0].rstrip()
            keyed(root, m.group(1)).at(where.span(begin, begin + len(value))).add_text(value)
    return document(root)
