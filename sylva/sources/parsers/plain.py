"""Plain text: one line element for each line."""

from __future__ import annotations

from ..tree import Node, document


def lines(text: str) -> Node:
    root = Node("element", "document")
    rows = text.split("\n")
    root.at((1, 1, len(rows), len(rows[-1].encode()) + 1))
    for k, row in enumerate(rows, 1):
        root.element("line").at((k, 1, k, len(row.encode()) + 1)).add_text(row)
    return document(root)
