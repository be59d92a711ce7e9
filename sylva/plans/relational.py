"""The relational backend: location paths over the node table as joins and filters.

A step is an equi-join on the parent or an interval join inside a document, a predicate a semi or anti
join, a position a window, a count a grouped join. plan() raises Unsupported for expressions outside
this subset; the interpreter takes those.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .xpath import normalized, parse


class Unsupported(ValueError):
    """The expression has no relational plan."""


_COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_FLIP = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_ANY = ("axis", "descendant-or-self", ("kind", "node", None), ())
#: Of a context row: its node, and the node it was reached from (for positions).
KEY = ("doc_id", "pre")


class Plan:
    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    # -- steps ---------------------------------------------------------------------------------

    def _tested(self, test: tuple) -> DataFrame:
        if test[0] == "name":
            out = self.nodes.where("kind = 'element'")
            return out if test[1] is None else out.where(F.col("name") == test[1])
        kind, name = test[1], test[2]
        if kind == "node":
            return self.nodes
        out = self.nodes.where(F.col("kind") == {"text": "text", "comment": "comment", "element": "element", "document-node": "document", "processing-instruction": "pi"}[kind])
        return out if name is None else out.where(F.col("name") == name)

    def _step(self, context: DataFrame, step: tuple, origin: bool) -> DataFrame:
        """Rows of the step's nodes; with origin, one row per context node and reached node, in from_pre."""
        _, axis, test, predicates = step
        c = context.select(F.col("doc_id").alias("c_doc"), F.col("pre").alias("c_pre"), F.col("post").alias("c_post"), F.col("parent").alias("c_parent"), *([F.col("from_pre").alias("c_from")] if origin else []))
        n = self._tested(test)
        same = F.col("doc_id") == F.col("c_doc")
        within = {
            "child": F.col("parent") == F.col("c_pre"),
            "descendant": (F.col("pre") > F.col("c_pre")) & (F.col("pre") <= F.col("c_post")),
            "descendant-or-self": (F.col("pre") >= F.col("c_pre")) & (F.col("pre") <= F.col("c_post")),
            "self": F.col("pre") == F.col("c_pre"),
            "parent": F.col("pre") == F.col("c_parent"),
            "ancestor": (F.col("pre") < F.col("c_pre")) & (F.col("post") >= F.col("c_pre")),
            "ancestor-or-self": (F.col("pre") <= F.col("c_pre")) & (F.col("post") >= F.col("c_pre")),
            "following-sibling": (F.col("parent") == F.col("c_parent")) & (F.col("pre") > F.col("c_pre")),
            "preceding-sibling": (F.col("parent") == F.col("c_parent")) & (F.col("pre") < F.col("c_pre")),
            "following": F.col("pre") > F.col("c_post"),
            "preceding": F.col("post") < F.col("c_pre"),
        }
        if axis == "attribute":
            raise Unsupported("attributes end a path")
        if self._is_set(step, origin):
            found = self._swept(axis, n, context)
            for p in predicates:
                found = self.keep(found, p)
            return found
        found = n.join(c, same & within[axis])
        reverse = axis in ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling", "parent")
        for p in predicates:
            found = self._positional(found, p, reverse) if _is_position(p) else self.keep(found, p)
        return found.withColumn("from_pre", F.col("c_from")).drop("c_doc", "c_pre", "c_post", "c_parent", "c_from") if origin else found.drop("c_doc", "c_pre", "c_post", "c_parent")

    @staticmethod
    def _is_set(step: tuple, origin: bool) -> bool:
        """Whether only the nodes that a step reaches count, not from where."""
        return not origin and step[1] not in ("child", "self", "parent") and not any(map(_is_position, step[3]))

    @staticmethod
    def _swept(axis: str, nodes: DataFrame, context: DataFrame) -> DataFrame:
        """The nodes that an axis reaches from any context node, each once and without comparing pairs.

        Subtrees are nested intervals, so one number for each document, parent or place is enough: the first or last context node, the
        farthest end of those before, the next one behind.
        """
        if axis in ("following", "preceding", "following-sibling", "preceding-sibling"):
            keys = ["doc_id", "parent"] if axis.endswith("sibling") else ["doc_id"]
            edge = {"following": F.min("post"), "preceding": F.max("pre"), "following-sibling": F.min("pre"), "preceding-sibling": F.max("pre")}[axis]
            edges = context.groupBy(*keys).agg(edge.alias("_edge"))
            beyond = F.col("pre") > F.col("_edge") if axis.startswith("following") else F.col("post" if axis == "preceding" else "pre") < F.col("_edge")
            return nodes.join(edges, keys).where(beyond).drop("_edge").select(nodes.columns)
        down, own = axis.startswith("descendant"), 0 if axis.endswith("self") else -1
        marks = context.select("doc_id", "pre", F.col("post" if down else "pre").alias("_edge"), F.lit(True).alias("_mark"))
        every = nodes.withColumn("_edge", F.lit(None).cast("int")).withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
        # going up, nodes come from the end of the document, so that what counts lies before a row there too
        order = Window.partitionBy("doc_id").orderBy(F.col("pre") if down else F.col("pre").desc()).rangeBetween(Window.unboundedPreceding, own)
        edge = (F.max if down else F.min)("_edge").over(order)
        inside = F.col("_near") >= F.col("pre") if down else F.col("_near") <= F.col("post")
        return every.withColumn("_near", edge).where(~F.col("_mark")).where(inside).select(nodes.columns)

    def _positional(self, found: DataFrame, p: tuple, reverse: bool) -> DataFrame:
        order = F.col("pre").desc() if reverse else F.col("pre").asc()
        context = Window.partitionBy("doc_id", "c_pre")
        position, last = F.row_number().over(context.orderBy(order)), F.count("*").over(context)
        value = {"position": position, "last": last}
        if p[0] == "lit":
            test = position == p[1]
        elif p == ("call", "last", ()):
            test = position == last
        else:
            side = lambda e: F.lit(e[1]) if e[0] == "lit" else value[e[1]]
            test = _COMPARE[p[1]](side(p[2]), side(p[3]))
        return found.withColumn("_kept", test).where("_kept").drop("_kept")

    def path(self, e: tuple, context: DataFrame | None, origin: bool = False) -> DataFrame:
        """Nodes of a path, each once (with origin: once for each context node)."""
        steps = list(e[2])
        if e[1] or context is None:
            if origin:
                raise Unsupported("absolute paths inside predicates")
            now = None
            if not steps:
                return self.nodes.where("kind = 'document'")
        else:
            now = context
        if steps and steps[0] == ("context",):
            steps = steps[1:]
        k = 0
        while k < len(steps):
            s = steps[k]
            if s == _ANY and k + 1 < len(steps) and steps[k + 1][0] == "axis" and steps[k + 1][1] == "child" and not any(map(_is_position, steps[k + 1][3])):
                s = ("axis", "descendant", *steps[k + 1][2:])
                k += 1
            k += 1
            if s[0] != "axis":
                raise Unsupported("only axis steps")
            if now is None and s[1] == "descendant":
                # from the root every node of that name is one: a plain filter
                now = self._tested(s[2])
                for p in s[3]:
                    now = self.keep(now, p)
                continue
            now = self._step(self.nodes.where("kind = 'document'") if now is None else now, s, origin)
            key = [*KEY, "from_pre"] if origin else [*KEY]
            if s[1] != "child" and s[1] != "self" and not self._is_set(s, origin):
                now = now.dropDuplicates(key)
        if now is None:
            raise Unsupported("an empty path")
        return now

    # -- predicates ----------------------------------------------------------------------------

    def keep(self, context: DataFrame, p: tuple) -> DataFrame:
        """The context rows for which a predicate holds."""
        kind = p[0]
        if kind == "paren":
            return self.keep(context, p[1])
        if kind == "op" and p[1] == "and":
            return self.keep(self.keep(context, p[2]), p[3])
        if kind == "op" and p[1] == "or":
            keys = self.keep(context, p[2]).select(*KEY).union(self.keep(context, p[3]).select(*KEY)).distinct()
            return context.join(keys, list(KEY), "left_semi")
        if kind == "call" and p[1] == "not":
            return context.join(self.keep(context, p[2][0]).select(*KEY), list(KEY), "left_anti")
        if kind == "call" and p[1] in ("exists", "boolean"):
            return self.keep(context, p[2][0])
        if kind == "call" and p[1] == "empty":
            return context.join(self.keep(context, p[2][0]).select(*KEY), list(KEY), "left_anti")
        if kind == "call" and p[1] in ("contains", "starts-with", "ends-with", "matches") and p[2][1][0] == "lit":
            literal = p[2][1][1]
            test = {"contains": lambda c: c.contains(literal), "starts-with": lambda c: c.startswith(literal), "ends-with": lambda c: c.endswith(literal), "matches": lambda c: c.rlike(literal)}[p[1]]
            return self._value_test(context, p[2][0], test, literal == "" and p[1] != "matches")
        if kind == "op" and p[1] in _COMPARE:
            left, op, right = p[2], p[1], p[3]
            if left[0] == "lit" and right[0] != "lit":
                left, op, right = right, _FLIP[op], left
            if right[0] != "lit":
                return self._arithmetic_test(context, p)
            if left[0] == "call" and left[1] == "count":
                return self._count_test(context, left[2][0], op, right[1])
            return self._value_test(context, left, lambda c: _compared(c, op, right[1]))
        if kind == "path":
            if p[2] and p[2][-1][0] == "axis" and p[2][-1][1] == "attribute":
                return self._value_test(context, p, lambda c: c.isNotNull())
            own = self.children(p)
            reached = self._reached(context, p).select("doc_id", F.col("from_pre").alias("pre")) if own is None else own.select("doc_id", F.col("parent").alias("pre"))
            return context.join(reached.distinct(), list(KEY), "left_semi")
        raise Unsupported(f"predicate {p[0]}")

    def _reached(self, context: DataFrame, e: tuple) -> DataFrame:
        if e[1]:
            raise Unsupported("absolute paths inside predicates")
        start = context.select("doc_id", "pre", "post", "parent").dropDuplicates(list(KEY)).withColumn("from_pre", F.col("pre"))
        return self.path(e, start, origin=True)

    def children(self, e: tuple) -> DataFrame | None:
        """The nodes of a path that is one child step, whatever their parent; nothing for other paths. Each names its parent, so no join is needed to tell whose they are."""
        if e[0] != "path" or e[1] or len(e[2]) != 1 or e[2][0][0] != "axis" or e[2][0][1] != "child" or any(map(_is_position, e[2][0][3])):
            return None
        found = self._tested(e[2][0][2])
        for p in e[2][0][3]:
            found = self.keep(found, p)
        return found

    def _value(self, e: tuple) -> Column | None:
        """The value of an expression that only needs the context row."""
        if e == ("context",) or (e[0] == "call" and e[1] in ("string", "number", "data") and (not e[2] or e[2][0] == ("context",))):
            return F.col("string_value")
        if e[0] == "path" and not e[1] and len(e[2]) == 1 and e[2][0][0] == "axis" and e[2][0][1] == "attribute" and e[2][0][2][1]:
            return attribute(e[2][0][2][1])
        if e[0] == "call" and e[1] == "name" and not e[2]:
            return F.col("name")
        if e[0] == "call" and e[1] == "string-length" and (not e[2] or e[2][0] == ("context",)):
            return F.char_length("string_value")
        return None

    def _value_test(self, context: DataFrame, e: tuple, test, on_nothing: bool = False) -> DataFrame:
        """Context rows for which some value of e passes; on_nothing is the result for no value."""
        value = self._value(e)
        if value is not None:
            return context.where(F.coalesce(test(value), F.lit(on_nothing)))
        if e[0] == "call" and e[1] in ("string", "number", "data") and len(e[2]) == 1:
            e = e[2][0]
        if e[0] != "path":
            raise Unsupported(f"value of {e[0]}")
        own = self.children(e)
        if own is not None:
            hits = own.where(test(F.col("string_value"))).select("doc_id", F.col("parent").alias("pre"))
            return context.join(hits.distinct(), list(KEY), "left_semi")
        if e[2][-1][0] == "axis" and e[2][-1][1] == "attribute":
            name = e[2][-1][2][1]
            owners = self._reached(context, ("path", False, e[2][:-1]))
            hits = owners.where(test(attribute(name)))
        else:
            hits = self._reached(context, e).where(test(F.col("string_value")))
        return context.join(hits.select("doc_id", F.col("from_pre").alias("pre")).distinct(), list(KEY), "left_semi")

    def _count_test(self, context: DataFrame, e: tuple, op: str, n) -> DataFrame:
        if e[0] != "path":
            raise Unsupported("count of values")
        own = self.children(e)
        reached = self._reached(context, e) if own is None else own.withColumn("from_pre", F.col("parent"))
        if (op, n) in ((">", 0), (">=", 1), ("!=", 0)):
            return context.join(reached.select("doc_id", F.col("from_pre").alias("pre")).distinct(), list(KEY), "left_semi")
        if (op, n) in (("=", 0), ("<", 1)):
            return context.join(reached.select("doc_id", F.col("from_pre").alias("pre")).distinct(), list(KEY), "left_anti")
        counts = reached.groupBy("doc_id", F.col("from_pre").alias("pre")).agg(F.count("*").alias("_n"))
        return context.join(counts, list(KEY), "left").where(_COMPARE[op](F.coalesce("_n", F.lit(0)), F.lit(n))).drop("_n")

    def _arithmetic_test(self, context: DataFrame, p: tuple) -> DataFrame:
        def number(e: tuple) -> Column:
            if e[0] == "lit" and not isinstance(e[1], str):
                return F.lit(e[1])
            if e[0] == "op" and e[1] in ("+", "-", "*"):
                return {"+": operator.add, "-": operator.sub, "*": operator.mul}[e[1]](number(e[2]), number(e[3]))
            value = self._value(e)
            if value is None:
                raise Unsupported("arithmetic over paths")
            return value.try_cast("double")

        return context.where(_COMPARE[p[1]](number(p[2]), number(p[3])))


def attribute(name: str, of: Callable[[str], Column] = F.col) -> Column:
    """An attribute's value; positions are attributes too. of gives the columns of the node."""
    own = F.element_at(of("attrs"), F.lit(name))
    return F.coalesce(own, of(name).cast("string")) if name in ("line", "column", "end_line", "end_column") else own


def _compared(c: Column, op: str, literal) -> Column:
    if isinstance(literal, str):
        return _COMPARE[op](c, F.lit(literal))
    # text that is no number compares as NaN does: false, but for !=
    value = F.trim(c.cast("string")).try_cast("double")
    return F.coalesce(_COMPARE[op](value, F.lit(float(literal))), F.when(c.isNotNull(), F.lit(op == "!=")))


def _is_position(p: tuple) -> bool:
    if p[0] == "lit":
        return not isinstance(p[1], str)
    if p == ("call", "last", ()):
        return True
    if p[0] == "op" and p[1] in _COMPARE:
        ok = [x[0] == "lit" and not isinstance(x[1], str) or x in (("call", "position", ()), ("call", "last", ())) for x in p[2:]]
        return all(ok) and any(x[0] == "call" for x in p[2:])
    return False


def plan(nodes: DataFrame, xpath: str) -> DataFrame:
    """Result rows of an expression: a path or union of paths (node rows, or value for attributes), or count of one."""
    e = parse(normalized(xpath))
    return _plan(Plan(nodes), e)


def _plan(p: Plan, e: tuple) -> DataFrame:
    if e[0] == "paren":
        return _plan(p, e[1])
    if e[0] == "op" and e[1] in ("union", "intersect", "except"):
        left, right = _plan(p, e[2]), _plan(p, e[3])
        if e[1] == "union":
            return left.unionByName(right, allowMissingColumns=True).dropDuplicates(list(KEY))
        return left.join(right.select(*KEY).distinct(), list(KEY), "left_semi" if e[1] == "intersect" else "left_anti")
    if e[0] == "call" and e[1] in ("count", "sum", "avg", "min", "max") and len(e[2]) == 1:
        inner = _plan(p, e[2][0])
        docs = p.nodes.where("kind = 'document'").select("doc_id", "file")
        value = F.col("value" if "value" in inner.columns else "string_value")
        agg = F.count("*") if e[1] == "count" else getattr(F, e[1])(value.try_cast("double"))
        found = inner.groupBy("doc_id").agg(agg.alias("value"))
        zero = {"count": F.lit(0), "sum": F.lit(0.0)}.get(e[1])
        out = docs.join(found, "doc_id", "left")
        return out.select("doc_id", "file", (F.coalesce("value", zero) if zero is not None else F.col("value")).alias("value"))
    if e[0] == "path" and e[2] and e[2][-1][0] == "axis" and e[2][-1][1] == "attribute":
        name = e[2][-1][2][1]
        if name is None or e[2][-1][3]:
            raise Unsupported("attribute wildcards")
        steps = e[2][:-1]
        if steps[-1:] == (_ANY,):
            steps = (*steps[:-1], ("axis", "descendant", ("name", None), ())) if not steps[:-1] else (*steps, ("axis", "self", ("name", None), ()))
        owners = p.path(("path", e[1], steps), None)
        return owners.withColumn("value", attribute(name)).where("value is not null")
    if e[0] == "path" and e[2] and e[2][-1][0] == "call" and e[2][-1][1] in ("string", "string-length", "name") and not e[2][-1][2]:
        value = {"string": F.col("string_value"), "string-length": F.char_length("string_value"), "name": F.col("name")}[e[2][-1][1]]
        return p.path(("path", e[1], e[2][:-1]), None).withColumn("value", value)
    if e[0] == "path":
        return p.path(e, None)
    raise Unsupported(e[0])
