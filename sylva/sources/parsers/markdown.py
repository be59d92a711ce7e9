"""Markdown blocks by a line automaton."""

from __future__ import annotations

import re

from ..tree import Node, Positions, document

_HEADING = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"[ ]{0,3}(`{3,}|~{3,})[ \t]*([^\s`]*)")
_ITEM = re.compile(r"(\s*)([-*+]|\d+[.)])[ \t]+(.*)")
_RULE = re.compile(r"[ ]{0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_TABLE = re.compile(r"\s*\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def structure(text: str) -> Node:
    """document/section with heading (h1 to h6 marker), list (ordered, unordered)/item, code_block, blockquote, table, hr, paragraph."""
    where, root = Positions(text), Node("element", "document")
    root.at(where.span(0, len(text)))
    lines = text.split("\n")
    section, k = root.element("section").at((1, 1, len(lines), len(lines[-1]) + 1)), 0

    def put(parent: Node, name: str, first: int, last: int) -> Node:
        return parent.element(name).at((first + 1, 1, last + 1, len(lines[last].encode()) + 1))

    while k < len(lines):
        line, first = lines[k], k
        if not line.strip():
            k += 1
        elif m := _FENCE.match(line):
            k += 1
            while k < len(lines) and not lines[k].strip().startswith(m.group(1)):
                k += 1
            e = put(section, "code_block", first, min(k, len(lines) - 1))
            if m.group(2):
                e.element("language").add_text(m.group(2))
            e.element("code").add_text("\n".join(lines[first + 1 : k]))
            k += 1
        elif m := _HEADING.match(line):
            section = put(root, "section", k, len(lines) - 1) if section.children else section
            e = put(section, "heading", k, k)
            e.element(f"h{len(m.group(1))}")
            e.add_text(m.group(2))
            k += 1
        elif _RULE.match(line):
            put(section, "hr", k, k)
            k += 1
        elif line.lstrip().startswith(">"):
            while k < len(lines) and lines[k].strip().startswith(">"):
                k += 1
            e = put(section, "blockquote", first, k - 1)
            e.add_text("\n".join(re.sub(r"^\s*> ?", "", x) for x in lines[first:k]))
        elif _ITEM.match(line):
            k = _list(section, lines, k, put)
        elif "|" in line and k + 1 < len(lines) and _TABLE.match(lines[k + 1]) and "|" in lines[k + 1]:
            while k < len(lines) and "|" in lines[k]:
                k += 1
            table = put(section, "table", first, k - 1)
            for r in [first, *range(first + 2, k)]:
                row = put(put(table, "thead", r, r) if r == first else table, "row", r, r)
                for cell in lines[r].strip().strip("|").split("|"):
                    put(row, "cell", r, r).add_text(cell.strip())
        elif line.startswith("    "):
            while k < len(lines) and (lines[k].startswith("    ") or not lines[k].strip()):
                k += 1
            put(section, "code_block", first, k - 1).element("code").add_text("\n".join(x[4:] for x in lines[first:k]).rstrip())
        else:
            while k < len(lines) and lines[k].strip() and not (_HEADING.match(lines[k]) or _FENCE.match(lines[k]) or _ITEM.match(lines[k]) or lines[k].lstrip().startswith(">")):
                k += 1
            put(section, "paragraph", first, k - 1).add_text("\n".join(lines[first:k]))
    return document(root)


def _list(parent: Node, lines: list[str], k: int, put) -> int:
    m = _ITEM.match(lines[k])
    indent, ordered, first = len(m.group(1)), m.group(2)[0].isdigit(), k
    e = put(parent, "list", k, k)
    e.element("ordered" if ordered else "unordered")
    while k < len(lines):
        m = _ITEM.match(lines[k])
        if not m or len(m.group(1)) < indent:
            break
        if len(m.group(1)) > indent and e.children[-1].name == "item":
            k = _list(e.children[-1], lines, k, put)
            continue
        if m.group(2)[0].isdigit() != ordered:
            break
        put(e, "item", k, k).add_text(m.group(3))
        k += 1
    e.end_line = max(k, first + 1)
    return k
