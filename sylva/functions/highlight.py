"""Syntax categories of elements, and source or tree text in colours.

An element's name tells its category; a few names mean other things in some languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..sources.operators_table import MARKERS
from ..sources.tree import Node, Positions

#: Colours of terminals by category (fixed values).
COLOURS = {
    "keyword": "\x1b[34m", "type": "\x1b[36m", "function": "\x1b[36m", "identifier": "\x1b[97m", "string": "\x1b[33m",
    "number": "\x1b[33m", "comment": "\x1b[32m", "operator": "\x1b[2m", "punctuation": "\x1b[2m",
}
RESET = "\x1b[0m"
#: Element names of each category in the languages with code trees (fixed values).
NAMES = {
    "identifier": "name ref pkg",
    "type": "type implicit_type generic nullable array typeof typeparams typeparam attribute attributes pointer slice map chan hash",
    "string": "string rawstring symbol",
    "number": "int float number",
    "function": "call methodcall lambda closure macro",
    "operator": "op binary unary assign augassign ternary compare logical",
    "comment": "comment",
    "keyword": (
        "bool null nil none true false class struct interface enum record namespace module trait impl mod typealias typedef typespec package import export use from function method ctor "
        "if elif elsif else unless for foreach while until loop do switch case when default match arm select try catch except finally rescue ensure raise throw return break continue next redo retry goto yield "
        "defer go using lock with pass public private protected internal package-private static abstract virtual override sealed final readonly const volatile transient native async await partial extern unsafe synchronized "
        "new this base self super let var mut pub exported unexported def end begin decorated decorator listcomp dictcomp setcomp genexp"
    ),
}
#: Names with another category in one language (fixed values).
OWN = {
    "go": {"field": "identifier"},
    "java": {"field": "keyword", "param": "keyword", "params": "keyword"},
    "rust": {"ref": "type", "path": "type", "try": "operator", "param": "keyword", "params": "keyword", "static": "keyword"},
    "typescript": {"variable": "keyword", "param": "keyword", "params": "keyword", "optional": "keyword", "required": "keyword"},
    "python": {"param": "keyword", "params": "keyword"},
    "csharp": {"name": "identifier"},
}
OWN["tsx"] = OWN["javascript"] = OWN["typescript"]
_CATEGORY = {name: category for category, names in NAMES.items() for name in names.split()}
_OPERATORS = frozenset(name for first, inner in MARKERS.values() for name in (first, *inner))
_WORDS = re.compile(r"(?<![\w$])(?:" + "|".join(sorted(re.escape(w) for w in NAMES["keyword"].split())) + r")(?![\w$])")


def category(element: str, language: str = "") -> str:
    """The syntax category of an element, or default."""
    found = OWN.get(language, {}).get(element) or _CATEGORY.get(element)
    return found or ("operator" if element in _OPERATORS else "default")


def _spans(doc: Node, language: str) -> Iterator[tuple[tuple[int, int], tuple[int, int], str]]:
    """Begin, end and category of the innermost elements that have a place and a category."""
    for n in doc.descendants():
        if n.kind == "element" and n.line is not None and n.end_line is not None and not any(c.kind == "element" and c.line is not None for c in n.children):
            kind = category(n.name, language)
            if kind in ("identifier", "string", "number", "comment", "type"):
                yield (n.line, n.column), (n.end_line, n.end_column), kind


def highlighted(content: str, doc: Node, language: str, colours: dict[str, str] | None = None) -> str:
    """The source with its tokens in colours; keywords outside of other tokens too."""
    colours = COLOURS if colours is None else colours
    where = Positions(content)

    def offset(place: tuple[int, int]) -> int:
        begin = where.starts[min(place[0], len(where.starts)) - 1]
        if where.ascii:
            return begin + place[1] - 1
        line = content[begin : content.find("\n", begin) if content.find("\n", begin) >= 0 else len(content)]
        return begin + len(line.encode()[: place[1] - 1].decode("utf-8", "ignore"))

    def plain(text: str) -> str:
        return _WORDS.sub(lambda m: f"{colours.get('keyword', '')}{m[0]}{RESET}", text)

    out, at = [], 0
    for begin, end, kind in sorted((offset(a), offset(b), kind) for a, b, kind in _spans(doc, language)):
        if begin >= at and end > begin and kind in colours:
            out += [plain(content[at:begin]), colours[kind], content[begin:end], RESET]
            at = end
    return "".join(out) + plain(content[at:])


def coloured_tree(text: str) -> str:
    """XML text of a tree with tags dim and names, attribute values and comments in colours."""
    text = re.sub(r"(<!--.*?-->)", rf"{COLOURS['comment']}\1{RESET}", text, flags=re.S)
    text = re.sub(r'="([^"]*)"', rf'="{COLOURS["string"]}\1{RESET}"', text)
    return re.sub(r"(</?)([\w.:-]+)", rf"{COLOURS['punctuation']}\1{RESET}{COLOURS['type']}\2{RESET}", text)
