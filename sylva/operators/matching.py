"""Matching: every source parsed once, all its rules evaluated, one row per item found.

Rules over lines of plain text are expressions of their own (plans/lines.py); the rest is interpreted.
Which rules apply to a source is an array column computed below Python; sources without any rule are
filtered out before they are parsed. Inside a document rules are grouped by language and tree mode, so
each tree is built once. A document that does not parse, or an expression that fails on it, gives no
row unless errors are asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.items import item_to_json, item_type, item_value
from ..functions.text import line_range, lines_of, rule_message, snippet
from ..plans import lines as line_plans
from ..plans.evaluate import Context, compiled
from ..sources.languages import canonical
from ..sources.parsers import BAD_TEXT, parse
from ..sources.partitions import certainly_empty, spread
from ..sources.tree import Node
from .rules import Rule, applicable

COLUMNS = (
    ("doc_id", pa.int64(), "long"), ("file", pa.string(), "string"), ("line", pa.int32(), "int"), ("column", pa.int32(), "int"), ("end_line", pa.int32(), "int"), ("end_column", pa.int32(), "int"),
    ("command", pa.string(), "string"), ("rule_id", pa.string(), "string"), ("rule_index", pa.int32(), "int"), ("item_index", pa.int32(), "int"), ("item_type", pa.string(), "string"),
    ("value", pa.string(), "string"), ("source", pa.string(), "string"), ("lines", pa.list_(pa.string()), "array<string>"), ("tree", pa.string(), "string"),
    ("reason", pa.string(), "string"), ("severity", pa.string(), "string"), ("message", pa.string(), "string"), ("origin", pa.string(), "string"), ("status", pa.string(), "string"), ("output", pa.string(), "string"),
)
NAMES = [n for n, _, _ in COLUMNS]
SCHEMA = ", ".join(f"`{n}` {t}" for n, _, t in COLUMNS)
#: Fields that are made only where they are asked for.
COSTLY = ("source", "lines", "tree")
BATCH_ROWS = 20_000


def location(n) -> tuple[int, int, int, int]:
    """Line, column, end line and end column; 1:1 for what has no place. An XML document's own attributes of these names count."""
    if isinstance(n, Node) and n.kind == "attribute":
        n = n.parent
    if not isinstance(n, Node):
        return 1, 1, 1, 1

    def number(name: str, other: int) -> int:
        own = getattr(n, name)
        if own is None:
            try:
                own = int(n.attrs.get(name, ""))
            except ValueError:
                own = None
        return other if own is None else own

    line, column = number("line", 1), number("column", 1)
    return line, column, number("end_line", line), number("end_column", column)


def match_document(content: str, path: str, language: str, rules: Sequence[tuple[int, Rule]], command: str, wanted: frozenset, quoted: bool = True, errors: bool = False, **parsing) -> Iterator[dict]:
    """Rows (without doc_id) of one document, rule by rule."""
    trees: dict = {}
    lines = None
    for index, rule in rules:
        key = (rule.language or language, rule.tree_mode or parsing.get("mode"))
        try:
            if key not in trees:
                trees[key] = parse(content, key[0], key[1], parsing.get("ignore_whitespace", False), parsing.get("parse_depth"))
            items = compiled(rule.expression)(Context(trees[key], 1, 1, {"file": [path]}))
        except BAD_TEXT as e:
            if errors:
                yield {"file": path, "line": 1, "column": 1, "end_line": 1, "end_column": 1, "command": command, "rule_id": rule.id, "rule_index": index, "item_index": 0, "reason": str(e), "severity": "fatal", "origin": "xpath" if key in trees else "input"}
            continue
        for k, x in enumerate(items):
            line, column, end_line, end_column = location(x)
            value = item_value(x, quoted)
            row = {"file": path, "line": line, "column": column, "end_line": end_line, "end_column": end_column, "command": command, "rule_id": rule.id, "rule_index": index, "item_index": k, "item_type": item_type(x), "value": value}
            if wanted & {"source", "lines"} and lines is None:
                lines = lines_of(content)
            if "source" in wanted:
                row["source"] = snippet(lines, line, column, end_line, end_column, value) if isinstance(x, Node) else value
            if "lines" in wanted and isinstance(x, Node):
                row["lines"] = line_range(lines, line, end_line)
            if "tree" in wanted or row["item_type"] in ("map", "array"):
                row["tree"] = item_to_json(x, parsing.get("tree_depth"))
            if command == "check":
                row |= {"reason": rule.said, "severity": rule.severity}
            if rule.message:
                row["message"] = rule_message(rule.message, value, line, column, path)
            yield row


def to_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t, _ in COLUMNS], NAMES)


def run_rules(sources: DataFrame, rules: Sequence[Rule], command: str = "query", fields: Iterable[str] = (), quoted: bool = True, errors: bool = False, mode: str | None = None, ignore_whitespace: bool = False, parse_depth: int | None = None, tree_depth: int | None = None) -> DataFrame:
    """Matches of all rules over all sources, unordered; fields names the costly columns to fill, tree_depth cuts trees."""
    rules, wanted = list(rules), frozenset(fields) & frozenset(COSTLY)
    native = []
    if not sources.isStreaming and mode is None and not ignore_whitespace and parse_depth is None and "tree" not in wanted:
        native = [(k, r, p) for k, r in enumerate(rules) if r.tree_mode is None and canonical(r.language or "text") == "text" and (p := line_plans.predicates(r.expression)) is not None]
    texts, others = sources.where("language = 'text'"), sources.where("language is null or language != 'text'")
    if native and not certainly_empty(texts):
        found = line_plans.matched_lines(texts, native, command, wanted, SCHEMA)
        if len(native) == len(rules) and certainly_empty(others):
            return found
    else:
        native, found = [], None
    marks = applicable(rules, F.col("path"), F.col("language"))
    if native:
        done = F.array(*[F.lit(k) for k, _, _ in native])
        marks = F.when(F.col("language") == "text", F.array_except(marks, done)).otherwise(marks)
    work = sources.select("doc_id", "path", "language", "content", marks.alias("rules")).where("content is not null and size(rules) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for doc_id, path, language, own, content in zip(*(b.column(c).to_pylist() for c in ("doc_id", "path", "language", "rules")), b.column("content"), strict=True):
                found = match_document(content.as_py(), path, language, [(k, rules[k]) for k in own], command, wanted, quoted, errors, mode=mode, ignore_whitespace=ignore_whitespace, parse_depth=parse_depth, tree_depth=tree_depth)
                rows.extend({"doc_id": doc_id, **r} for r in found)
                if len(rows) >= BATCH_ROWS:
                    yield to_batch(rows)
                    rows = []
        yield to_batch(rows)

    out = spread(work).mapInArrow(run, SCHEMA)
    return out if found is None else found.unionByName(out)


#: Order of a report: file, position, then rule and item.
ORDER = ("file", "line", "column", "rule_index", "item_index")


def ordered(matches: DataFrame) -> DataFrame:
    return matches.orderBy(*ORDER)


def limited(matches: DataFrame, n: int | None) -> DataFrame:
    """The first n matches of the report's order."""
    return matches if n is None else matches.orderBy(*ORDER).limit(n)
