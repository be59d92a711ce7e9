"""JSON texts by a shape that Spark finds in them: node tables and rows without a parser of our own.

One aggregate over all texts merges their shapes (objects, arrays, values), whatever their number. Texts are then read by from_json with that
shape, every value as the text it is written as, and become nodes by expressions (shred.py). A text takes the other way - our parser - if the
shape cannot tell its tree: what is no single object, has a null, an empty object or array, a repeated key, an escaped character by number or a key that is no
name, has keys in another order than most, or holds a value where others have an object or array. Both ways give the same tree, but for positions in
the text, which only parsed nodes have.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import settle
from .nodes import COLUMNS, node_table
from .shred import typed_nodes

_TOKEN = re.compile(r"\s*(OBJECT<|ARRAY<|[A-Z_]+(?:\([0-9, ]*\))?|`(?:[^`]|``)*`|[^\s:<>,`]+|[:<>,])")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: A string of a JSON text, with the colon that makes it a key.
_STRING = r'"(?:[^"\\]|\\.)*+"(?:\s*:)?'


class _Shape:
    """A merged shape as a Spark type with text for every value, and the paths that have values of several kinds or other obstacles."""

    def __init__(self, text: str):
        self.tokens, self.at, self.conflicts = _TOKEN.findall(text), 0, []
        self.type = self._read("$", False)

    def _take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def _read(self, path: str, inside: bool) -> T.DataType | None:
        """The type at a path; none where texts that have it take the other way. inside tells paths below an array, which have no path of their own."""
        word = self._take()
        if word == "ARRAY<":
            inner = self._read(path, True)
            self._take()
            return T.ArrayType(inner) if inner is not None else None
        if word != "OBJECT<":
            return self._conflict(path) if word in ("VARIANT", "VOID") else T.StringType()
        fields = []
        while self.tokens[self.at] != ">":
            name = self._take().strip("`").replace("``", "`")
            self._take()
            below = path if inside else f"{path}.{name}" if _NAME.fullmatch(name) else f"{path}['{name}']" if "'" not in name else "$"
            kind = self._read(below, inside)
            if not _NAME.fullmatch(name):
                kind = self._conflict(below)
            if kind is not None:
                fields.append(T.StructField(name, kind))
            if self.tokens[self.at] == ",":
                self._take()
        self._take()
        return T.StructType(fields) if fields else self._conflict(path)

    def _conflict(self, path: str) -> None:
        self.conflicts.append(path)


def _ordered(kind: T.DataType, rank: dict[str, int]) -> T.DataType:
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_ordered(kind.elementType, rank))
    if isinstance(kind, T.StructType):
        fields = [T.StructField(f.name, _ordered(f.dataType, rank)) for f in kind.fields]
        return T.StructType(sorted(fields, key=lambda f: (rank.get(f.name, len(rank)), f.name)))
    return kind


def _keys(text: Column) -> Column:
    """The keys of a JSON text in their order, at all depths."""
    strings = F.filter(F.regexp_extract_all(text, F.lit(_STRING), F.lit(0)), lambda x: x.endswith(":"))
    return F.transform(strings, lambda x: F.regexp_replace(x, r"\s*:$", ""))


def _with_quoted_numbers(text: Column) -> Column:
    """A JSON text whose numbers are strings: they stay as they are written."""
    marked = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|(-?[0-9][0-9.eE+-]*+)', "$1\u0001$2\u0002")
    return F.translate(F.replace(marked, F.lit("\u0001\u0002"), F.lit("")), "\u0001\u0002", '""')


def shape_of(sources: DataFrame) -> tuple[T.StructType | None, list[str]]:
    """The merged shape of the JSON objects among the sources, and the paths whose texts have to be parsed.

    Fields stand in the order of the text with the most different keys.
    """
    objects = sources.where("language = 'json'").select(F.try_parse_json("content").alias("v"), F.array_distinct(_keys(F.col("content"))).alias("keys")).where(F.schema_of_variant("v").startswith("OBJECT<"))
    found = objects.agg(F.schema_of_variant_agg("v").alias("shape"), F.max(F.struct(F.size("keys").alias("n"), "keys")).alias("most")).first()
    if not found["shape"] or not found["shape"].startswith("OBJECT<"):
        return None, []
    shape = _Shape(found["shape"])
    rank = {name.strip('"'): k for k, name in enumerate(found["most"]["keys"])}
    return (_ordered(shape.type, rank) if isinstance(shape.type, T.StructType) else None), sorted(set(shape.conflicts))


def _readable(content: Column, data: Column, conflicts: list[str]) -> Column:
    """Whether the shape tells the tree of a text that was read as data."""
    v = F.try_parse_json(content)
    own = F.schema_of_variant(v)
    plain = own.startswith("OBJECT<") & ~own.contains("VOID") & ~own.contains("OBJECT<>") & ~own.contains("VARIANT") & ~content.rlike(r"\\u|[\x01\x02]")
    for path in conflicts:
        plain = plain & (F.lit(False) if path == "$" else F.try_variant_get(v, path, "variant").isNull())
    return F.coalesce(plain & (_keys(content) == _keys(F.to_json(data))), F.lit(False))


def typed_rows(sources: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The JSON texts that a discovered shape tells, as rows (doc_id, path, data), and the sources that need a parser, where there are any.

    Texts are read once and written with what was read; only texts for the parser are kept as texts.
    """
    shape, conflicts = shape_of(sources)
    if shape is None or "$" in conflicts:
        return None, sources
    is_json = F.col("language").eqNullSafe("json")
    read = sources.select("doc_id", "path", "language", "content", F.when(is_json, F.from_json(_with_quoted_numbers(F.col("content")), shape)).alias("data"))
    told = F.coalesce(is_json & _readable(F.col("content"), F.col("data"), conflicts), F.lit(False))
    read = read.withColumn("told", told)
    read = settle(read.withColumn("content", F.when(~F.col("told"), F.col("content"))).withColumn("data", F.when(F.col("told"), F.col("data"))), "json-rows")
    others = read.where("not told").drop("data", "told")
    return read.where("told").select("doc_id", "path", "data"), (others if others.limit(1).count() else None)


def json_nodes(sources: DataFrame, stage: bool = True) -> DataFrame:
    """Nodes of all sources: of JSON texts by their discovered shape, of all others by their parsers; without positions. stage writes them once."""
    rows, others = typed_rows(sources)
    if rows is None:
        return node_table(others, stage=stage)
    shaped = typed_nodes(rows.select("doc_id", "path", "data.*"), "doc_id", F.col("path"), skip=("path",)).select(*[n for n, _, _ in COLUMNS])
    shaped = settle(shaped, "nodes") if stage else shaped
    return shaped if others is None else shaped.unionByName(node_table(others, stage=stage))
