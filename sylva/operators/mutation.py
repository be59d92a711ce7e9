"""Mutation: set (update or insert) and update (existing nodes only) of values inside documents.

Only the text of what changes is rewritten: a value's span is spliced, a missing path is put before the
end of the deepest object or mapping that exists, in the layout found there. Mappings of one document
are applied one after the other, each on the text that the one before left.

One mapping of a plain name (//k) in a flat JSON object on one line of ASCII is spliced by expressions of Spark; only other
texts are parsed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.evaluate import Context, compile_expr, evaluate
from ..plans.xpath import normalized, parse
from ..sources.languages import canonical
from ..sources.parsers import BAD_TEXT
from ..sources.parsers import parse as parse_tree
from ..sources.partitions import spread
from ..sources.tree import Node, Positions
from .matching import COLUMNS, SCHEMA, location, to_batch


class MutationError(ValueError):
    pass


@dataclass(frozen=True)
class Mapping:
    """An expression and the value its nodes get; kind is string, number, boolean, null, or None: as it was, and text where nothing was."""

    xpath: str
    value: str
    kind: str | None = None
    limit: int | None = None


# -- declarative expressions -------------------------------------------------------------------

_NAME = re.compile(r"\s*([A-Za-z_][\w.\-]*)\s*")
_STRING = re.compile(r"'((?:[^']|'')*)'|\"((?:[^\"]|\"\")*)\"")
_BARE = re.compile(r"[^\]\s]+")


class _Declaration:
    """A path of names with predicates: each predicate sets a value, holds further ones, or is a bare mark."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, message: str):
        raise MutationError(f"{message} at {self.at} in {self.text!r}")

    def path(self) -> list[tuple[str, list]]:
        """(name, predicates) of each segment; a predicate is (path, value and kind or nothing)."""
        out = []
        while True:
            m = _NAME.match(self.text, self.at)
            if not m:
                self.fail("expected a name")
            self.at, predicates = m.end(), []
            while self.text[self.at : self.at + 1] == "[":
                self.at += 1
                inner = self.path()
                value = None
                if self.text[self.at : self.at + 1] == "=":
                    self.at += 1
                    value = self.literal()
                while self.text[self.at : self.at + 1] == " ":
                    self.at += 1
                if self.text[self.at : self.at + 1] != "]":
                    self.fail("expected ]")
                self.at += 1
                predicates.append((inner, value))
            out.append((m.group(1), predicates))
            if self.text[self.at : self.at + 1] != "/":
                return out
            self.at += 1

    def literal(self) -> tuple[str, str]:
        while self.text[self.at : self.at + 1] == " ":
            self.at += 1
        if m := _STRING.match(self.text, self.at):
            self.at = m.end()
            return (m.group(1).replace("''", "'"), "string") if m.group(1) is not None else (m.group(2).replace('""', '"'), "string")
        m = _BARE.match(self.text, self.at)
        word = m.group() if m else ""
        if word in ("true()", "false()"):
            value = (word[:-2], "boolean")
        elif word == "null()":
            value = ("null", "null")
        elif re.fullmatch(r"-?\d+(\.\d+)?", word):
            value = (word, "number")
        else:
            self.fail(f"invalid bare value {word!r}: quote it, or write true() or false()")
        self.at = m.end()
        return value


def _mappings(path: list, prefix: str, value: tuple[str, str] | None) -> list[Mapping]:
    """What a path sets: its value, what its last predicates say, or null for a bare name. Earlier predicates choose."""
    xpath = prefix
    for k, (name, predicates) in enumerate(path):
        xpath += ("/" if xpath and not xpath.endswith("/") else "") + name
        if k < len(path) - 1:
            xpath += "".join("[" + "/".join(n for n, _ in inner) + (f"={_quoted(*v)}" if v else "") + "]" for inner, v in predicates)
    if value is not None:
        return [Mapping(xpath, *value)]
    last = path[-1][1]
    if not last:
        return [Mapping(xpath, "null", "null")]
    return [m for inner, v in last for m in _mappings(inner, xpath, v)]


def _quoted(value: str, kind: str) -> str:
    return "'" + value.replace("'", "''") + "'" if kind == "string" else value if kind == "number" else f"'{value}'"


def declared(expression: str, value: str | None = None) -> list[Mapping]:
    """Mappings of an expression such as db[host='x'][port=1][user[name='a']].

    With a value the whole expression chooses what gets it (predicates of its last segment too).
    """
    if value is not None:
        text = expression.strip()
        return [Mapping(text if text.startswith("/") else "//" + text, value)]
    reader = _Declaration(expression.strip())
    path = reader.path()
    if reader.at != len(reader.text):
        reader.fail("expected the end")
    return _mappings(path, "//", None)


# -- splicing ----------------------------------------------------------------------------------


def _offset(where: Positions, line: int, column: int) -> int | None:
    if not 1 <= line <= len(where.starts):
        return None
    begin = where.starts[line - 1]
    end = where.starts[line] if line < len(where.starts) else len(where.text)
    if where.ascii:
        return min(begin + column - 1, end)
    return begin + len(where.text[begin:end].encode()[: column - 1].decode("utf-8", "ignore"))


def _span(where: Positions, n: Node) -> tuple[int, int] | None:
    if n.line is None:
        return None
    a, b = _offset(where, n.line, n.column), _offset(where, n.end_line, n.end_column)
    return None if a is None or b is None else (a, b)


def spliced(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Text with spans replaced, the last first; equal spans once, overlaps refused."""
    done = sorted({(a, b): v for a, b, v in edits}.items())
    for (first, _), (second, _) in zip(done, done[1:], strict=False):
        if second[0] < first[1]:
            raise MutationError("spans to replace overlap")
    for (a, b), value in reversed(done):
        text = text[:a] + value + text[b:]
    return text


def _rendered(language: str, value: str, kind: str | None, old: str = "") -> str:
    """A value as the language writes it; quotes in YAML follow what was there. A value that its kind cannot hold is text."""
    if kind in ("number", "boolean", "null", "true", "false") and not re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null|~", value):
        kind = "string"
    if language == "json":
        return value if kind in ("number", "boolean", "null", "true", "false") else json.dumps(value, ensure_ascii=False)
    if language == "yaml":
        if old[:1] == "'":
            return "'" + value.replace("'", "''") + "'"
        plain = re.fullmatch(r"[\w./@+-][\w ./@+-]*", value) and not value.endswith(" ")
        ambiguous = kind == "string" and (re.fullmatch(r"[-+]?[\d.]+|true|false|null|yes|no|on|off|~", value, re.I) is not None)
        return json.dumps(value, ensure_ascii=False) if old[:1] == '"' or not plain or ambiguous else value
    return value


def _missing_tail(xpath: str, doc: Node) -> tuple[Node, list[str]]:
    """The deepest element that exists along a path of child steps, and the names below it that do not."""
    e = parse(xpath)
    if e[0] != "path":
        raise MutationError("only paths can be inserted")
    steps = [s for s in e[2] if s != ("axis", "descendant-or-self", ("kind", "node", None), ())]
    if any(s[0] != "axis" or s[1] != "child" or s[2][0] != "name" or s[2][1] is None for s in steps):
        raise MutationError("only child steps can be inserted")
    for k in range(len(steps) - 1, -1, -1):
        if any(s[3] for s in steps[k:]):
            raise MutationError("a predicate on a segment that does not exist")
        if k:
            cut = len(e[2]) - (len(steps) - k)
            prefix = ("path", e[1], e[2][:cut])
            found = _evaluate(prefix, doc)
            if found:
                return found[0], [s[2][1] for s in steps[k:]]
    root = next(c for c in doc.children if c.kind == "element")
    inner = [c for c in root.children if c.kind == "element" and c.name == "document"] if root.name == "stream" else [root]
    return inner[0] if inner else root, [s[2][1] for s in steps]


def _evaluate(e: tuple, doc: Node) -> list[Node]:
    return [n for n in compile_expr(e)(Context(doc)) if isinstance(n, Node) and n.kind == "element"]


def _inserted_json(text: str, span: tuple[int, int], names: list[str], value: str) -> str:
    a, b = span
    body = text[a:b]
    open_, close = body.find("{"), body.rfind("}")
    if open_ < 0 or close < 0:
        raise MutationError("values can only be put into objects")
    inside = body[open_ + 1 : close]
    multi = "\n" in inside
    closing = re.search(r"\n([ \t]*)$", inside)
    base = closing.group(1) if closing else ""
    first = re.search(r"\n([ \t]+)\S", inside)
    indent = first.group(1) if first else base + "  "
    unit = indent[len(base) :] or "  "

    def nested(k: int, pad: str) -> str:
        if k == len(names) - 1:
            return f"{json.dumps(names[k])}: {value}"
        if not multi:
            return f"{json.dumps(names[k])}: {{{nested(k + 1, pad)}}}"
        return f"{json.dumps(names[k])}: {{\n{pad + unit}{nested(k + 1, pad + unit)}\n{pad}}}"

    new = nested(0, indent)
    kept = inside.rstrip()
    if multi:
        middle = f"{kept}{',' if kept.strip() else ''}\n{indent}{new}\n{base}"
    else:
        middle = f"{kept}, {new}" + inside[len(kept) :] if kept.strip() else new
    return text[:a] + body[: open_ + 1] + middle + body[close:] + text[b:]


def _inserted_yaml(text: str, node: Node, where: Positions, names: list[str], value: str) -> str:
    span = _span(where, node) or (0, len(text))
    children = [c for c in node.children if c.kind == "element" and c.line is not None]
    body = text[span[0] : span[1]]
    if children:
        line = text.split("\n")[children[0].line - 1]
        indent = line[: len(line) - len(line.lstrip(" -"))].replace("-", " ")
    else:
        indent = ""
    if body.lstrip().startswith("{"):
        return _inserted_json(text, span, names, value)
    rows = [indent + "  " * k + n + ":" for k, n in enumerate(names)]
    rows[-1] += " " + value
    end = span[0] + len(body.rstrip())
    head = text[:end]
    return head + ("\n" if head.strip() else "") + "\n".join(rows) + (text[end:] or "\n")


def apply_mapping(content: str, language: str, mapping: Mapping, insert: bool = True, ignore_whitespace: bool = False) -> tuple[str, list[Node]]:
    """The new text, and the nodes of the old one that were changed (none for an insertion)."""
    language = canonical(language)
    xpath = mapping.xpath if mapping.xpath.startswith(("/", "(")) else normalized(mapping.xpath)
    doc = parse_tree(content, language, None, ignore_whitespace)
    found = [n for n in evaluate(xpath, doc) if isinstance(n, Node)]
    found = [n.parent if n.kind == "text" else n for n in found][: mapping.limit]
    where = Positions(content)
    if found:
        edits = []
        for n in found:
            span = _span(where, n)
            if span is None:
                continue
            old = content[span[0] : span[1]]
            kind = mapping.kind or n.attrs.get("kind", "string")
            if n.attrs.get("kind") and mapping.kind is None and language == "json" and kind in ("true", "false"):
                kind = "boolean"
            edits.append((*span, _rendered(language, mapping.value, kind, old)))
        return spliced(content, edits), found
    if not insert:
        return content, []
    if language not in ("json", "yaml"):
        raise MutationError(f"nothing matches and {language} values cannot be inserted")
    node, names = _missing_tail(xpath, doc)
    value = _rendered(language, mapping.value, mapping.kind or "string")
    if language == "json":
        span = (0, len(content)) if node.name == "document" and node.parent is doc else _span(where, node)
        return _inserted_json(content, span, names, value), []
    return _inserted_yaml(content, node, where, names, value), []


# -- flat JSON objects ---------------------------------------------------------------------------

_PLAIN_PATH = re.compile(r"//([A-Za-z_][A-Za-z0-9_]*)")
#: Names that elements of the parser's own may have.
_OWN_NAMES = frozenset(("document", "stream", "item"))
_SCALAR = r'(?:"[ !#-\[\]-~]*+"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][-+]?[0-9]++)?+|true|false|null)'
_MEMBER = rf' *+"[A-Za-z_][A-Za-z0-9_]*+" *+: *+{_SCALAR} *+'
_FLAT = rf"\A\{{(?:{_MEMBER}(?:,{_MEMBER})*+| *+)\}}\z"
#: Longest text that is matched as a whole.
_FLAT_CHARS = 2_000


def _flat(sources: DataFrame, mappings: Sequence[Mapping], ignore_whitespace: bool) -> tuple[str, DataFrame, DataFrame] | None:
    """The name of the only mapping, the flat objects that have it once or not at all, and all other texts."""
    m = _PLAIN_PATH.fullmatch(mappings[0].xpath) if len(mappings) == 1 and mappings[0].limit is None else None
    if not m or m.group(1) in _OWN_NAMES or ignore_whitespace or sources.isStreaming:
        return None
    content = F.col("content")
    plain = (F.col("language") == "json") & (F.length(content) <= _FLAT_CHARS) & content.rlike(_FLAT) & (F.regexp_count(content, F.lit(f'"{m.group(1)}" *:')) <= 1)
    plain = F.coalesce(plain, F.lit(False))
    return m.group(1), sources.where(plain), sources.where(~plain)


def _flat_rows(flat: DataFrame, name: str, mapping: Mapping, command: str) -> DataFrame:
    """The rows of mutate for flat objects."""

    def value(old: str) -> F.Column:
        return F.lit(_rendered("json", mapping.value, mapping.kind or old))

    def new(old: F.Column) -> F.Column:
        first = F.substring(old, 1, 1)
        return F.when(first == '"', value("string")).when(first.isin("t", "f"), value("boolean")).when(first == "n", value("null")).otherwise(value("number"))

    content = F.col("content")
    rest = F.coalesce(F.get(F.split(content, rf'"{name}" *: *', 2), F.lit(1)), F.lit(""))
    old = F.regexp_extract(rest, rf"\A{_SCALAR}", 0)
    before, has = F.length(content) - F.length(rest), rest != ""
    inside = F.substring(content, F.lit(2), F.length(content) - 2)
    kept = F.rtrim(inside)
    added = F.lit(f"{json.dumps(name)}: {_rendered('json', mapping.value, mapping.kind or 'string')}")
    filled = F.concat(F.lit("{"), kept, F.lit(", "), added, F.substring(inside, F.length(kept) + 1, F.length(inside)), F.lit("}"))
    put = F.when(kept == "", F.concat(F.lit("{"), added, F.lit("}"))).otherwise(filled)
    output = F.when(has, F.concat(F.substring(content, F.lit(1), before), new(old), F.substring(rest, F.length(old) + 1, F.length(rest)))).otherwise(put if command == "set" else content)
    # a filter of the status finds the old value once
    changed = F.when(has, F.get(F.transform(F.array(old), lambda o: o != new(o)), F.lit(0))).otherwise(command == "set")
    made = {"doc_id": F.col("doc_id"), "file": F.col("path"), "line": F.lit(1), "column": F.when(has, before + 1).otherwise(1), "end_line": F.lit(1), "end_column": F.when(has, before + F.length(old) + 1).otherwise(1)}
    made |= {"command": F.lit(command), "rule_index": F.lit(0), "item_index": F.lit(0), "reason": F.lit(mapping.xpath), "status": F.when(changed, "updated").otherwise("unchanged"), "output": output}
    return flat.select(*[made.get(n, F.lit(None)).cast(t).alias(n) for n, _, t in COLUMNS])


def mutate(sources: DataFrame, mappings: Sequence[Mapping], command: str = "set", ignore_whitespace: bool = False) -> DataFrame:
    """One row per source: status updated or unchanged, output the new text, reason the expressions; fatal rows where it fails."""
    mappings = list(mappings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, path, language, content in zip(*(b.column(c).to_pylist() for c in ("doc_id", "path", "language", "content")), strict=True):
                row = {"doc_id": doc_id, "file": path, "line": 1, "column": 1, "end_line": 1, "end_column": 1, "command": command, "rule_index": 0, "item_index": 0, "reason": "; ".join(m.xpath for m in mappings)}
                now, touched = content, None
                try:
                    for m in mappings:
                        now, nodes = apply_mapping(now or "", language, m, command == "set", ignore_whitespace)
                        touched = touched or (nodes[0] if nodes else None)
                    row |= {"status": "updated" if now != content else "unchanged", "output": now}
                    if touched is not None:
                        row |= dict(zip(("line", "column", "end_line", "end_column"), location(touched), strict=True))
                except BAD_TEXT as e:
                    row |= {"severity": "fatal", "origin": "input", "reason": str(e), "status": "unchanged", "output": content}
                rows.append(row)
            yield to_batch(rows)

    sources = sources.where("content is not null").select("doc_id", "path", "language", "content")
    flat = _flat(sources, mappings, ignore_whitespace)
    parsed = spread(flat[2] if flat else sources).mapInArrow(run, SCHEMA)
    return parsed.unionByName(_flat_rows(flat[1], flat[0], mappings[0], command)) if flat else parsed


def write_back(changed: DataFrame, folder: str) -> DataFrame:
    """Writes the new texts as a table of versions below folder and returns it: a retried task writes the same rows again.

    Files on a driver's own disk are replaced by replace_files.
    """
    changed.where("status = 'updated'").select("file", "output").write.mode("overwrite").parquet(folder)
    return changed.sparkSession.read.parquet(folder)


def replace_files(changed: DataFrame) -> int:
    """Replaces the local files of a small result on the driver; returns how many."""
    import os

    n = 0
    for r in changed.where("status = 'updated'").select("file", "output").toLocalIterator():
        temporary = r["file"] + ".new"
        with open(temporary, "w", encoding="utf-8", newline="") as f:
            f.write(r["output"])
        os.replace(temporary, r["file"])
        n += 1
    return n
