"""Text of matches: source snippets, line ranges, message templates, gutters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACEHOLDER = re.compile(r"\{(value|line|col|file)\}")


def lines_of(content: str) -> list[str]:
    return [x.removesuffix("\r") for x in content.split("\n")]


def snippet(lines: list[str], line: int, column: int, end_line: int, end_column: int, value: str | None) -> str:
    """The source between two byte positions; the value where the position is not in the text."""
    if not 1 <= line <= len(lines) or end_line > len(lines) or end_line < line:
        return value or ""
    if line == end_line:
        raw = lines[line - 1].encode()[column - 1 : end_column - 1]
        return raw.decode("utf-8", "replace")
    first = lines[line - 1].encode()[column - 1 :].decode("utf-8", "replace")
    last = lines[end_line - 1].encode()[: end_column - 1].decode("utf-8", "replace")
    return "\n".join([first, *lines[line : end_line - 1], last])


def line_range(lines: list[str], line: int, end_line: int) -> list[str]:
    return lines[line - 1 : end_line] if 1 <= line <= len(lines) else []


def rule_message(template: str, value: str | None, line: int, column: int, file: str, short: bool = True) -> str:
    """A message with its placeholders filled; short cuts the value to 50 characters in one line."""
    shown = " ".join((value or "").split()) if short else value or ""
    if short and len(shown) > 50:
        shown = shown[:47] + "..."
    values = {"value": shown, "line": str(line), "col": str(column), "file": file}
    return _PLACEHOLDER.sub(lambda m: values[m.group(1)], template)


def message_column(template: str, value: Column, line: Column, column: Column, file: Column, short: bool = True) -> Column:
    """rule_message as an expression."""
    shown = value
    if short:
        flat = F.trim(F.regexp_replace(value, r"\s+", " "))
        shown = F.when(F.char_length(flat) > 50, F.concat(F.substring(flat, 1, 47), F.lit("..."))).otherwise(flat)
    parts, at = [], 0
    values = {"value": F.coalesce(shown, F.lit("")), "line": line.cast("string"), "col": column.cast("string"), "file": file}
    for m in _PLACEHOLDER.finditer(template):
        parts += [F.lit(template[at : m.start()]), values[m.group(1)]]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def gutter(lines: list[str], first: int, column: int, end_column: int) -> str:
    """Source lines with numbers: one line is underlined, of several the first and the last are marked, more than six are shortened."""
    if not lines:
        return ""
    width = len(str(first + len(lines) - 1))
    if len(lines) == 1:
        under = " " * (width + 2) + " " + " " * (column - 1) + "^" + "~" * max(0, end_column - column - 1)
        return f"{first:>{width}} | {lines[0]}\n{under}"
    rows = []
    for k, text in enumerate(lines):
        if len(lines) > 6 and 2 <= k < len(lines) - 2:
            if k == 2:
                rows.append(" " * width + " ...")
            continue
        mark = ">|" if k in (0, len(lines) - 1) else " |"
        rows.append(f"{first + k:>{width}} {mark} {text}".rstrip())
    return "\n".join(rows)


def snippet_column(content: Column, line: Column, column: Column, end_column: Column) -> Column:
    """The source of a match inside one line, by byte columns; parts of a cut character become U+FFFD."""
    row = F.regexp_replace(F.element_at(F.split(content, "\n", -1), line), "\r$", "")
    return F.make_valid_utf8(F.substring(F.encode(row, "UTF-8"), column, end_column - column).cast("string"))


def lines_column(content: Column, line: Column, end_line: Column) -> Column:
    return F.slice(F.transform(F.split(content, "\n", -1), lambda x: F.regexp_replace(x, "\r$", "")), line, end_line - line + 1)
