"""The node table of rows whose shape Spark knows, without a parser: every row is a document, every field an element.

A row becomes the tree that its JSON text would become (a null field has no element, an array is its field repeated), in one expression
over its columns. Each value is given as many numbers as its shape can need, so pre numbers follow document order and
intervals contain what they should, with gaps. No Python, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _static_span(kind: T.DataType) -> int | None:
    """Numbers that a value of this type needs at most; none if that depends on the lengths of arrays."""
    if isinstance(kind, T.StructType):
        inner = [_static_span(f.dataType) for f in kind.fields]
        return None if None in inner else 1 + sum(inner)
    return None if isinstance(kind, T.ArrayType) else 2


def _stride(c: Column, kind: T.DataType) -> Column:
    """Numbers for each element of an array of these elements."""
    known = _static_span(kind)
    return F.lit(known).cast("long") if known else F.coalesce(F.array_max(F.transform(c, lambda x: _span(x, kind))), F.lit(0).cast("long"))


def _span(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.ArrayType):
            return _span(F.flatten(F.filter(c, lambda x: x.isNotNull())), kind.elementType)
        return F.coalesce(F.size(c) * _stride(c, kind.elementType), F.lit(0)).cast("long")
    if isinstance(kind, T.StructType):
        total = F.lit(1).cast("long")
        for f in kind.fields:
            total = total + _span(c[f.name], f.dataType)
        return total
    return F.lit(2).cast("long")


def _node(pre, post, parent, depth, ord_, kind, name, text, value, path) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        pre.cast("long").alias("pre"), post.cast("long").alias("post"), parent.cast("long").alias("parent"), F.lit(depth).alias("depth"), ord_.cast("int").alias("ord"), F.lit(kind).alias("kind"), (F.lit(name) if name else none).alias("name"),
        (text if text is not None else none).alias("text"), (value if value is not None else none).alias("string_value"), (F.lit(path) if path else none).alias("path"),
    )


def _nodes(c: Column, kind: T.DataType, name: str, at: Column, parent: Column, depth: int, ord_: Column, above: str) -> Column:
    """Array of the nodes of one value, the first numbered at."""
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.ArrayType):
            return _nodes(F.flatten(F.filter(c, lambda x: x.isNotNull())), kind.elementType, name, at, parent, depth, ord_, above)
        c = F.filter(c, lambda x: x.isNotNull())
        step = _stride(c, kind.elementType)
        each = F.flatten(F.transform(c, lambda x, i: _nodes(x, kind.elementType, name, at + i * step, parent, depth, ord_ + i, above)))
        return F.coalesce(each, F.array().cast(each_type()))
    path = f"{above}/{name}" if above else name
    if isinstance(kind, T.StructType):
        own = _node(at, at + _span(c, kind) - 1, parent, depth, ord_, "element", name, None, None, path)
        return F.when(c.isNull(), F.array().cast(each_type())).otherwise(F.concat(F.array(own), *_fields(c, kind, at, depth + 1, path)))
    text = c.cast("string")
    filled = F.coalesce(F.length(text) > 0, F.lit(False))
    own = _node(at, at + filled.cast("long"), parent, depth, ord_, "element", name, None, F.coalesce(text, F.lit("")), path)
    leaf = _node(at + 1, at + 1, at, depth + 1, F.lit(0), "text", None, text, text, path)
    return F.when(text.isNull(), F.array().cast(each_type())).when(filled, F.array(own, leaf)).otherwise(F.array(own))


def _fields(c: Column | None, kind: T.StructType, at: Column, depth: int, path: str) -> list[Column]:
    out, place, number = [], at + 1, F.lit(0)
    for f in kind.fields:
        own = F.col(f"`{f.name}`") if c is None else c[f.name]
        out.append(_nodes(own, f.dataType, f.name, place, at, depth, number, path))
        place = place + _span(own, f.dataType)
        number = number + _held(own, f.dataType)
    return out


def _held(c: Column, kind: T.DataType) -> Column:
    """How many elements a field has."""
    if not isinstance(kind, T.ArrayType):
        return c.isNotNull().cast("int")
    if isinstance(kind.elementType, T.ArrayType):
        return _held(F.flatten(F.filter(c, lambda x: x.isNotNull())), kind.elementType)
    return F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0))


def each_type() -> str:
    return "array<struct<pre:bigint,post:bigint,parent:bigint,depth:int,ord:int,kind:string,name:string,text:string,string_value:string,path:string>>"


def typed_nodes(rows: DataFrame, doc_id: str, file: Column | None = None, name: str = "document", skip: Sequence[str] = ()) -> DataFrame:
    """Nodes of all rows: those of their columns but doc_id and those to skip, below an element of this name.

    Elements with element children have no string value. There are no positions in a text and no attributes.
    """
    fields = T.StructType([f for f in rows.schema.fields if f.name != doc_id and f.name not in skip])
    at, total = F.lit(1).cast("long"), F.lit(2).cast("long")
    for f in fields.fields:
        total = total + _span(F.col(f"`{f.name}`"), f.dataType)
    none = F.lit(None).cast("long")
    top = F.array(_node(F.lit(0), total - 1, none, 0, F.lit(0), "document", None, None, None, ""), _node(at, total - 1, F.lit(0), 1, F.lit(0), "element", name, None, None, name))
    every = F.concat(top, *_fields(None, fields, at, 2, name))
    out = rows.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (file if file is not None else F.lit(None).cast("string")).alias("file"), F.inline(every))
    nothing = {c: F.lit(None).cast("int") for c in ("line", "column", "end_line", "end_column")}
    return out.withColumns({**nothing, "attrs": F.lit(None).cast("map<string,string>")})
