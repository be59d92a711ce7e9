"""One text at a time, without Spark: what an interactive page needs of the engine."""

from __future__ import annotations

from ..plans.evaluate import evaluate
from ..plans.xpath import normalized, problem
from ..sources.parsers import parse
from ..sources.tree import Node, subtree_text
from .highlight import highlighted
from .items import item_type, item_value
from .text import lines_of, snippet


def to_xml(text: str, language: str, mode: str | None = None, indent: int | None = 2, depth: int | None = None, meta: bool = False) -> str:
    """The tree of a text as XML."""
    return subtree_text(parse(text, language, mode), indent, depth, meta)


def validated(expression: str) -> dict:
    """Whether an expression can be read, and if not what is wrong from where to where."""
    wrong = problem(normalized(expression)) if expression.strip() else ("an empty expression", 0, 0)
    return {"valid": wrong is None} | ({} if wrong is None else dict(zip(("message", "start", "end"), wrong, strict=True)))


def found(text: str, language: str, expression: str, mode: str | None = None) -> list[dict]:
    """Matches of an expression: kind, value, place and source of each."""
    out = []
    for x in evaluate(normalized(expression), parse(text, language, mode)):
        row = {"type": item_type(x), "value": item_value(x)}
        if isinstance(x, Node) and x.line is not None:
            place = (x.line, x.column, x.end_line, x.end_column)
            row |= dict(zip(("line", "column", "end_line", "end_column"), place, strict=True)) | {"source": snippet(lines_of(text), *place, row["value"])}
        out.append(row)
    return out


def schema(text: str, language: str, mode: str | None = None) -> dict[str, int]:
    """How often each path of elements occurs."""
    counts: dict[str, int] = {}
    paths: dict[int, str] = {}
    for n in parse(text, language, mode).descendants():
        if n.kind == "element":
            above = paths.get(id(n.parent))
            path = paths[id(n)] = f"{above}/{n.name}" if above else n.name
            counts[path] = counts.get(path, 0) + 1
    return counts


def coloured(text: str, language: str) -> str:
    """The text with its tokens in terminal colours."""
    return highlighted(text, parse(text, language), language)
