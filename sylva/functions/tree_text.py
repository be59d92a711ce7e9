"""Trees as indented text, and marked source."""

from __future__ import annotations

import json

from ..sources.tree import Node


def tree_text(n: Node, depth: int | None = None) -> str:
    """One line per element: empty children are marks in brackets, a leaf shows its text, others open a branch."""
    rows: list[str] = []

    def title(e: Node) -> str:
        marks = " and ".join(c.name for c in e.children if c.kind == "element" and not c.children)
        return e.name + (f"[{marks}]" if marks else "")

    def shown(e: Node) -> list[Node]:
        return [c for c in e.children if (c.kind == "element" and c.children) or (c.kind == "text" and (c.text or "").strip())]

    def put(e: Node, lead: str, stem: str, level: int) -> None:
        if e.kind == "text":
            rows.append(lead + json.dumps((e.text or "").strip(), ensure_ascii=False))
            return
        inner = shown(e)
        if len(inner) == 1 and inner[0].kind == "text":
            rows.append(f"{lead}{title(e)} = {json.dumps(inner[0].text.strip(), ensure_ascii=False)}")
            return
        if not inner:
            rows.append(lead + title(e))
            return
        rows.append(f"{lead}{title(e)}/")
        if depth is not None and level >= depth:
            rows.append(f"{stem}  └─ … ({len(inner)} children)")
            return
        for k, c in enumerate(inner):
            last = k == len(inner) - 1
            put(c, stem + ("  └─ " if last else "  ├─ "), stem + ("    " if last else "  │ "), level + 1)

    for top in [n] if n.kind != "document" else [c for c in n.children if c.kind == "element"]:
        put(top, "", "", 1)
    return "\n".join(rows)


def side_by_side(content: str, n: Node, depth: int | None = None, gap: str = "  | ") -> str:
    """Source lines on the left; on the right the elements that begin on each line, indented by their depth."""
    rows = content.split("\n")
    own: dict[int, list[str]] = {}
    for e in n.descendants():
        if e.kind == "element" and e.line is not None and (depth is None or e.depth <= depth):
            marks = " and ".join(c.name for c in e.children if c.kind == "element" and not c.children)
            own.setdefault(e.line, []).append("  " * (e.depth - 1) + e.name + (f"[{marks}]" if marks else ""))
    width = max(map(len, rows), default=0)
    out = []
    for k, row in enumerate(rows, 1):
        right = own.get(k, [""])
        out += [f"{(row if i == 0 else ''):<{width}}{gap}{text}".rstrip() for i, text in enumerate(right)]
    return "\n".join(out)


def marked_source(content: str, spans: list[tuple[int, int, int, int]], mark: tuple[str, str] = ("»", "«")) -> str:
    """The whole text with spans (line, column, end line, end column in bytes) between marks."""
    rows = [r.encode() for r in content.split("\n")]
    edits = sorted({(a, b, mark[0]) for a, b, _, _ in spans} | {(c, d, mark[1]) for _, _, c, d in spans}, reverse=True)
    for line, column, sign in edits:
        if 1 <= line <= len(rows):
            rows[line - 1] = rows[line - 1][: column - 1] + sign.encode() + rows[line - 1][column - 1 :]
    return b"\n".join(rows).decode("utf-8", "replace")
