"""Markers of operators (fixed values): what stands inside an op element, outermost first."""

from __future__ import annotations

from .tree import Node

#: operator, marker, markers inside it; a slash goes one level deeper.
MARKERS = {
    "==": ("equals", []), "===": ("equals", ["strict"]), "!=": ("not-equals", []), "!==": ("not-equals", ["strict"]), "<": ("compare", ["less"]),
    ">": ("compare", ["greater"]), "<=": ("compare", ["less", "or-equal"]), ">=": ("compare", ["greater", "or-equal"]), "+": ("plus", []), "-": ("minus", []),
    "*": ("multiply", []), "/": ("divide", []), "%": ("modulo", []), "**": ("power", []), "&&": ("logical", ["and"]), "and": ("logical", ["and"]),
    "||": ("logical", ["or"]), "or": ("logical", ["or"]), "!": ("logical", ["not"]), "not": ("logical", ["not"]), "??": ("nullish-coalescing", []),
    "&": ("bitwise", ["and"]), "|": ("bitwise", ["or"]), "^": ("bitwise", ["xor"]), "~": ("bitwise", ["not"]), "<<": ("shift", ["left"]), ">>": ("shift", ["right"]),
    ">>>": ("shift", ["right", "unsigned"]), "+=": ("assign", ["plus"]), "-=": ("assign", ["minus"]), "*=": ("assign", ["multiply"]), "/=": ("assign", ["divide"]),
    "%=": ("assign", ["modulo"]), "**=": ("assign", ["power"]), "&&=": ("assign", ["logical/and"]), "||=": ("assign", ["logical/or"]),
    "??=": ("assign", ["nullish-coalescing"]), "<<=": ("assign", ["shift/left"]), ">>=": ("assign", ["shift/right"]), "&=": ("assign", ["bitwise/and"]),
    "|=": ("assign", ["bitwise/or"]), "^=": ("assign", ["bitwise/xor"]), "in": ("contains", []), "not in": ("contains", ["not"]), "is": ("identity", []),
    "is not": ("identity", ["not"]), "++": ("increment", []), "--": ("decrement", []),
}


def add_op(parent: Node, operator: str) -> Node:
    """An op element with its text and the markers of its meaning."""
    op = parent.element("op", field="op")
    if operator in MARKERS:
        first, inner = MARKERS[operator]
        marker = op.element(first)
        for path in inner:
            at = marker
            for name in path.split("/"):
                at = at.element(name)
    op.add_text(operator)
    return op
