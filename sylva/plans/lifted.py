"""The loop-lifted backend: FLWOR and set-at-a-time evaluation of whole expressions over the node table.

An expression is not run once for each document and iteration but once for all of them. A scope is a table of tuples: doc_id, one key
column for each iteration around (the place of the item that is bound), and columns for what is bound. for is a join
with the items of its sequence, which adds a key; let of one value is a column, of a sequence a table beside it; return gives the
items in the order of the keys. Aggregates group by the keys of their scope, predicates are semi joins on them, and an expression
is evaluated in the outermost scope that has all it names, so what does not depend on an iteration is found once for each document.

Maps and arrays are JSON texts, put together from the innermost outwards: entries of one tuple side by side, members and sequences of several items by
one aggregate each, scalars before maps before arrays as they are shown.

Comparisons of two sequences are existential: = is a semi join on keys and value, < and > compare the least of one with the greatest of the other, !=
holds unless both hold one and the same value. Values that XPath calls an error (several items where one is needed, text that is no number) mark their document, which
then has no result, as in the interpreter. plan functions raise Unsupported for expressions outside this subset.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import typed
from .relational import _COMPARE, _FLIP, Plan, Unsupported, attribute
from .xpath import normalized, parse

#: Columns of a node that a binding carries.
NODE = ("pre", "post", "parent", "kind", "name", "string_value", "attrs", "line", "column", "end_line", "end_column")
GENERAL = frozenset(("=", "!=", "<", "<=", ">", ">="))
VALUE = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
NUMBERS = frozenset(("integer", "number"))
AGGREGATES = frozenset(("count", "sum", "avg", "min", "max", "string-join", "exists", "empty", "not", "boolean"))
_KINDS = {"map": "string", "array": "string", "string": "string", "number": "double", "integer": "bigint", "boolean": "boolean", "untyped": "string"}
_TYPES = {"string": T.StringType(), "untyped": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}


@dataclass
class Items:
    """Items of an expression for each tuple of a scope: one row each, with the scope's columns.

    order names the columns that order the items of a tuple; kind is node (columns prefix_pre and so on) or that of prefix_v.
    """

    df: DataFrame
    scope: Scope
    order: list[str]
    kind: str
    prefix: str
    single: bool = False
    #: Whether nodes and values met in it.
    mixed: bool = False

    @property
    def node(self) -> bool:
        return self.kind == "node"

    @property
    def value(self) -> Column:
        return F.col(f"{self.prefix}_string_value" if self.node else f"{self.prefix}_v")

    @property
    def atomic(self) -> str:
        return "untyped" if self.node else self.kind

    @property
    def payload(self) -> list[str]:
        return [f"{self.prefix}_{c}" for c in NODE] if self.node else [f"{self.prefix}_v"]


@dataclass
class Scope:
    """Tuples with their keys (doc_id first) and what is bound: a column and its kind, the prefix of a node, or Items."""

    df: DataFrame
    keys: list[str]
    outer: Scope | None = None
    bound: dict = field(default_factory=dict)
    #: Whether df is all documents and nothing but their columns.
    plain: bool = False
    #: The column that the last key was taken from.
    place: str | None = None

    def find(self, name: str):
        """What a name is bound to, and the scope it is bound in."""
        s: Scope | None = self
        while s is not None:
            if name in s.bound:
                return s.bound[name], s
            s = s.outer
        raise Unsupported(f"unknown variable {name}")

    def join(self, found: DataFrame, keys: list[str]) -> None:
        """Adds the other columns of found, which has one row at most for each of the keys."""
        self.df = self.df.join(found, keys, "left")
        self.plain = False


def _free(e, known: frozenset = frozenset()) -> set[str]:
    """Variables that an expression names, with a dot if it needs the context item."""
    if not isinstance(e, tuple) or not e or not isinstance(e[0], str):
        return set().union(*[_free(x, known) for x in e]) if isinstance(e, tuple) else set()
    kind = e[0]
    if kind == "lit":
        return set()
    if kind == "var":
        return set() if e[1] in known else {e[1]}
    if kind == "context":
        return {"."}
    if kind in ("for", "let", "some", "every"):
        return _free(e[2], known) | _free(e[3], known | {e[1]})
    if kind == "function":
        return _free(e[2], known | set(e[1]))
    if kind == "path":
        if e[1] or not e[2]:
            return set().union(*[_free(x, known) - {"."} for x in e[2]], set())
        first = _free(e[2][0], known) - ({"."} if e[2][0][0] == "axis" else set()) | ({"."} if e[2][0][0] == "axis" else set())
        return first | set().union(*[_free(x, known) - {"."} for x in e[2][1:]], set())
    if kind == "axis":
        return set().union(*[_free(x, known) - {"."} for x in e[3]], set())
    if kind in ("map!", "filter"):
        return _free(e[1], known) | (_free(e[2], known) - {"."})
    if kind == "call":
        alone = not e[2] and e[1] in ("string", "number", "name", "local-name", "string-length", "normalize-space", "position", "last", "data")
        return set().union(*[_free(x, known) for x in e[2]], {"."} if alone else set())
    if kind in ("cast", "castable", "instance", "treat"):
        return _free(e[1], known)
    return set().union(*[_free(x, known) for x in e[1:] if isinstance(x, tuple)], set())


class Lifted:
    def __init__(self, nodes: DataFrame):
        self.nodes, self.plan, self.made, self.marks = nodes, Plan(nodes), 0, False
        docs = nodes.where("kind = 'document'").select("doc_id", "file", F.lit(False).alias("_bad"), *[F.col(c).alias(f"d_{c}") for c in NODE])
        self.top = Scope(docs, ["doc_id"], bound={".": "d", "file": (F.col("file"), "string")}, plain=True)

    def name(self) -> str:
        self.made += 1
        return f"x{self.made}"

    # -- scopes --------------------------------------------------------------------------------

    def home(self, e: tuple, s: Scope) -> Scope:
        """The outermost scope around s that has all that e names."""
        named = _free(e)
        while s.outer is not None and not named & set(s.bound):
            s = s.outer
        return s

    def lift_for(self, it: Items, e: tuple, s: Scope) -> Items:
        """The items in a scope that has all that e, which is asked of each of them, names beside the item."""
        named = _free(e) - {"."}
        while s is not it.scope and s.outer is not None and not named & set(s.bound):
            s = s.outer
        return self.lift(it, s) if len(s.keys) > len(it.scope.keys) else it

    def lift(self, it: Items, s: Scope) -> Items:
        """The same items for each tuple of a scope inside theirs."""
        if it.scope is s:
            return it
        df = s.df.join(it.df.select(*it.scope.keys, *it.order, *it.payload), it.scope.keys)
        return replace(it, df=df, scope=s)

    def inside(self, it: Items, s: Scope, name: str) -> Scope:
        """The scope of a binding that takes the items one by one."""
        it = self.lift(it, s)
        key = f"k{self.name()}"
        place = F.lit(0) if not it.order else F.col(it.order[0]) if len(it.order) == 1 else F.struct(*it.order)
        bound = it.prefix if it.node else (it.value, it.kind)
        return Scope(it.df.withColumn(key, place), [*s.keys, key], s, {name: bound}, place=it.order[0] if len(it.order) == 1 else None)

    def bad(self, s: Scope, test: Column) -> None:
        """Marks the documents of tuples for which a test holds: they have no result."""
        self.marks = True
        s.df = s.df.withColumn("_bad", F.col("_bad") | F.coalesce(test, F.lit(False)))
        s.plain = False

    # -- sequences -----------------------------------------------------------------------------

    def atoms(self, df: DataFrame, s: Scope, c: Column, kind: str, order: list[str], single: bool = False) -> Items:
        p = self.name()
        return Items(df.withColumn(f"{p}_v", c.cast(_KINDS[kind])).where(F.col(f"{p}_v").isNotNull()), s, order, kind, p, single)

    def items(self, e: tuple, s: Scope) -> Items:
        s = self.home(e, s)
        kind = e[0]
        if kind == "paren":
            return self.items(e[1], s)
        if kind == "var":
            bound, at = s.find(e[1])
            return self.bound_items(bound, at, s)
        if kind == "context":
            bound, at = s.find(".")
            return self.bound_items(bound, at, s)
        if kind == "path":
            return self.path(e, s)
        if kind == "filter":
            it = self.lift_for(self.items(e[1], s), e[2], s)
            for p in e[2]:
                it = self.filtered(it, p)
            return it
        if kind == "seq":
            return self.union([self.items(x, s) for x in e[1]], s)
        if kind == "for":
            inner = self.inside(self.items(e[2], s), s, e[1])
            return self.returned(self.items(e[3], inner), inner, s)
        if kind == "map!":
            inner = self.inside(self.items(e[1], s), s, ".")
            return self.returned(self.items(e[2], inner), inner, s)
        if kind == "let":
            return self.items(e[3], self.let(e, s))
        if kind == "if":
            test = self.condition(e[1], s)
            c = f"{self.name()}_c"
            s.df, s.plain = s.df.withColumn(c, test), False
            yes, no = self.lift(self.items(e[2], s), s), self.lift(self.items(e[3], s), s)
            return self.union([replace(yes, df=self.with_column(yes.df, s, c).where(c)), replace(no, df=self.with_column(no.df, s, c).where(~F.col(c)))], s)
        if kind == "op" and e[1] == "to":
            low, high = (self.scalar(x, s)[0].cast("bigint") for x in (e[2], e[3]))
            p = self.name()
            df = s.df.withColumn(f"{p}_v", F.explode(F.when(low <= high, F.sequence(low, high)))).where(F.col(f"{p}_v").isNotNull())
            return Items(df, s, [f"{p}_v"], "integer", p)
        if kind == "op" and e[1] in ("union", "intersect", "except"):
            return self.combined(e, s)
        if kind == "call" and e[1] in ("distinct-values", "sort", "reverse", "head", "tail", "subsequence", "tokenize", "for-each", "filter", "data", "zero-or-one", "exactly-one", "one-or-more"):
            return self.sequence_call(e, s)
        if kind == "apply" and e[1][0] == "function":
            return self.items(self.bound_body(e[1], e[2]), s)
        c, k = self.scalar(e, s)
        return self.atoms(s.df, s, c, k, [], True)

    @staticmethod
    def with_column(df: DataFrame, s: Scope, c: str) -> DataFrame:
        """df with a column of its scope's tuples that was added after df was made."""
        return df if c in df.columns else df.join(s.df.select(*s.keys, c), s.keys)

    @staticmethod
    def bound_body(f: tuple, args: tuple) -> tuple:
        if len(f[1]) != len(args):
            raise Unsupported("a function with other arguments")
        body = f[2]
        for name, x in reversed(list(zip(f[1], args, strict=True))):
            body = ("let", name, x, body)
        return body

    def bound_items(self, bound, at: Scope, s: Scope) -> Items:
        if isinstance(bound, Items):
            return bound
        if isinstance(bound, str):
            p = self.name()
            df = s.df.withColumns({f"{p}_{c}": F.col(f"{bound}_{c}") for c in NODE})
            return Items(df.where(F.col(f"{p}_pre").isNotNull()), s, [], "node", p, True)
        return self.atoms(s.df, s, *bound, [], True)

    def let(self, e: tuple, s: Scope) -> Scope:
        """The scope with a name for the value of e[2]."""
        own = Scope(s.df, s.keys, s.outer, dict(s.bound), s.plain)
        if self.is_single(e[2], s):
            c, kind = self.scalar(e[2], own)
            held = f"{self.name()}_l"
            own.df, own.plain = own.df.withColumn(held, c), False
            own.bound[e[1]] = (F.col(held), kind)
        else:
            it = self.items(e[2], s)
            own.bound[e[1]] = it if it.scope is not s else replace(it, scope=own)
        return own

    def returned(self, it: Items, inner: Scope, s: Scope) -> Items:
        """Items of the body of an iteration as items of the scope around it."""
        it = self.lift(it, inner)
        return replace(it, scope=s, order=[inner.keys[-1], *it.order], single=False)

    def union(self, parts: list[Items], s: Scope) -> Items:
        """The items of several expressions, one after the other."""
        if not parts:
            return self.atoms(s.df.where(F.lit(False)), s, F.lit(""), "string", [])
        parts = [self.lift(p, s) for p in parts]
        kinds = {p.kind for p in parts}
        mixed = any(p.mixed for p in parts) or len(kinds) > 1 and "node" in kinds
        if len(kinds) > 1:
            kinds = {p.atomic for p in parts}
            if kinds & {"map", "array"}:
                raise Unsupported("a sequence of maps and other values")
            kind = "number" if kinds <= NUMBERS else "untyped" if kinds == {"untyped"} else "string"
            if kind == "string" and kinds - {"string", "untyped"}:
                raise Unsupported("a sequence of values of several kinds")
        else:
            kind = kinds.pop()
        p, most = self.name(), max(len(x.order) for x in parts)
        order = [f"{p}_o{k}" for k in range(most + 1)]
        names = [f"{p}_{c}" for c in NODE] if kind == "node" else [f"{p}_v"]
        common = [c for c in s.df.columns if all(c in x.df.columns for x in parts)]
        kinds_of = [{f.name: f.dataType for f in x.df.schema.fields} for x in parts]
        places = []
        for k in range(most):
            held = {t[x.order[k]].simpleString() for x, t in zip(parts, kinds_of, strict=True) if k < len(x.order)}
            if len(held) > 1 and not all(h in ("int", "bigint") for h in held):
                raise Unsupported("sequences in orders of several kinds")
            places.append("bigint" if held <= {"int", "bigint"} else held.pop())
        out = None
        for n, x in enumerate(parts):
            own = [F.lit(n).alias(order[0]), *[(F.col(x.order[k]) if k < len(x.order) else F.lit(None)).cast(places[k]).alias(order[k + 1]) for k in range(most)]]
            values = [F.col(f"{x.prefix}_{c}").alias(f"{p}_{c}") for c in NODE] if kind == "node" else [x.value.cast(_KINDS[kind]).alias(names[0])]
            part = x.df.select(*common, *own, *values)
            out = part if out is None else out.unionByName(part)
        return Items(out, s, order, kind, p, mixed=mixed)

    def combined(self, e: tuple, s: Scope) -> Items:
        left, right = self.lift(self.items(e[2], s), s), self.lift(self.items(e[3], s), s)
        if not (left.node and right.node):
            raise Unsupported("set operations on values")
        if e[1] == "union":
            both = self.union([left, right], s)
            return replace(both, df=both.df.dropDuplicates([*s.keys, f"{both.prefix}_pre"]), order=[f"{both.prefix}_pre"])
        other = right.df.select(*s.keys, F.col(f"{right.prefix}_pre").alias(f"{left.prefix}_pre")).distinct()
        df = left.df.join(other, [*s.keys, f"{left.prefix}_pre"], "left_semi" if e[1] == "intersect" else "left_anti")
        return replace(left, df=df.dropDuplicates([*s.keys, f"{left.prefix}_pre"]), order=[f"{left.prefix}_pre"])

    def sequence_call(self, e: tuple, s: Scope) -> Items:
        name, args = e[1], e[2]
        if name in ("for-each", "filter"):
            f = args[1]
            if f[0] != "function" or len(f[1]) != 1:
                raise Unsupported("a function that is not written out")
            it = self.items(args[0], s)
            inner = self.inside(it, it.scope, f[1][0])
            if name == "for-each":
                inner = self.inside(self.lift(it, s), s, f[1][0])
                return self.returned(self.items(f[2], inner), inner, s)
            kept = self.keep(f[2], inner)
            return replace(it, df=kept.df)
        if name == "tokenize":
            if len(args) != 2 or args[1][0] != "lit":
                raise Unsupported("tokenize without a literal pattern")
            text = self.text(args[0], s)
            p = self.name()
            df = s.df.select("*", F.posexplode(F.when(text != "", F.split(text, args[1][1]))).alias(f"{p}_o", f"{p}_v"))
            return Items(df, s, [f"{p}_o"], "string", p)
        it = self.items(args[0], s)
        if name in ("zero-or-one", "exactly-one", "one-or-more"):
            return it
        p, keys = self.name(), it.scope.keys
        if name in ("data", "distinct-values", "sort") and it.node:
            it = Items(it.df.withColumn(f"{p}_v", it.value), it.scope, it.order, "untyped", p, it.single)
            p = self.name()
        if name == "data":
            return it
        if name == "distinct-values":
            place = F.struct(*it.order) if it.order else F.lit(0)
            first = it.df.groupBy(*keys, it.value.alias(f"{p}_v")).agg(F.min(place).alias(f"{p}_o"), F.bool_or("_bad").alias("_bad"))
            return self.beside(Items(first, it.scope, [f"{p}_o"], it.kind, p))
        if name == "sort":
            if len(args) > 1:
                raise Unsupported("sort by a key")
            return replace(it, order=[it.payload[0], *it.order])
        window = Window.partitionBy(*keys).orderBy(*it.order) if it.order else Window.partitionBy(*keys).orderBy(F.lit(0))
        place = f"{p}_n"
        numbered = it.df.withColumn(place, F.row_number().over(window))
        if name == "reverse":
            return replace(it, df=numbered.withColumn(place, -F.col(place)), order=[place])
        n = F.col(place)
        if name == "subsequence":
            first = F.round(self.scalar(args[1], it.scope)[0].cast("double")) if len(args) > 1 else F.lit(1.0)
            test = n >= first
            if len(args) > 2:
                test = test & (n < first + F.round(self.scalar(args[2], it.scope)[0].cast("double")))
        else:
            test = n == 1 if name == "head" else n > 1
        return replace(it, df=numbered.where(test), order=[place], single=name == "head")

    def beside(self, it: Items) -> Items:
        """Items whose rows lost the other columns of their scope get them again, where there are any."""
        lost = [c for c in it.scope.df.columns if c not in it.df.columns]
        if it.scope.plain:
            return replace(it, df=it.df.withColumns({c: F.lit(None).cast(dict(it.scope.df.dtypes)[c]) for c in lost}))
        df = it.df.drop("_bad").join(it.scope.df, it.scope.keys)
        return replace(it, df=df)

    # -- paths ---------------------------------------------------------------------------------

    def path(self, e: tuple, s: Scope) -> Items:
        steps = list(e[2])
        if e[1]:
            if s.plain:
                k = self.supported(steps)
                if k:
                    found = self.plan.path(("path", True, tuple(steps[:k])), None)
                    return self.walk(self.of_nodes(found, s), steps[k:], s)
                return self.walk(self.bound_items("d", s, s), steps, s)
            top = s
            while top.outer is not None:
                top = top.outer
            return self.walk(self.of_nodes(self.plan.path(("path", True, ()), None), top) if top.plain else self.bound_items("d", top, top), steps, s)
        if steps and steps[0][0] != "axis":
            return self.walk(self.items(steps[0], s), steps[1:], s)
        bound, at = s.find(".")
        return self.walk(self.bound_items(bound, at, s), steps, s)

    def of_nodes(self, found: DataFrame, s: Scope) -> Items:
        """Rows of the node table as items of the plain scope."""
        p = self.name()
        mine = {f"{p}_{c}": F.col(c) for c in NODE}
        rest = {c: F.lit(None).cast(k) for c, k in s.df.dtypes if c not in ("doc_id", "file", "_bad")}
        return Items(found.select("doc_id", "file", F.lit(False).alias("_bad"), *[c.alias(n) for n, c in {**mine, **rest}.items()]), s, [f"{p}_pre"], "node", p)

    def supported(self, steps: list) -> int:
        """How many of the first steps the relational backend plans whole."""
        k = 0
        for n, x in enumerate(steps):
            if x[0] != "axis" or x[1] == "attribute" or _free(x[3]) - {"."}:
                break
            try:
                self.plan.path(("path", False, (x,)), self.nodes.limit(0), origin=False) if x[3] else None
            except Unsupported:
                break
            k = n + 1
        # a step to any descendant belongs to the step after it
        while k and steps[k - 1][1] == "descendant-or-self" and k < len(steps):
            k -= 1
        return k

    def walk(self, it: Items, steps: list, s: Scope) -> Items:
        """The items that steps reach from others, in scopes up to s."""
        while steps:
            k = self.supported(steps)
            if k:
                it, steps = self.reached(it, tuple(steps[:k])), steps[k:]
                continue
            x = steps[0]
            if x[0] == "axis" and x[1] == "descendant-or-self" and not x[3] and len(steps) > 1 and steps[1][0] == "axis" and steps[1][1] == "child" and not any(map(self.by_position, steps[1][3])):
                steps = [("axis", "descendant", *steps[1][2:]), *steps[2:]]
                continue
            if x[0] != "axis":
                it = self.lift_for(it, x, s)
                inner = self.inside(it, it.scope, ".")
                it, steps = self.returned(self.items(x, inner), inner, it.scope), steps[1:]
                if it.mixed:
                    raise Unsupported("a step to nodes and values")
                if it.node:
                    it = replace(it, df=it.df.dropDuplicates([*it.scope.keys, f"{it.prefix}_pre"]), order=[f"{it.prefix}_pre"])
                continue
            if x[1] == "attribute":
                name = x[2][1] if x[2][0] == "name" else None
                if name is None or x[3] or not it.node:
                    raise Unsupported("attribute tests")
                p = self.name()
                value = attribute(name, lambda c, own=it.prefix: F.col(f"{own}_{c}"))
                it, steps = Items(it.df.withColumn(f"{p}_v", value).where(F.col(f"{p}_v").isNotNull()), it.scope, it.order, "untyped", p, it.single), steps[1:]
                continue
            if any(map(self.by_position, x[3])):
                raise Unsupported("positions beside variables")
            it = self.lift_for(self.reached(it, ((*x[:3], ()),)), x[3], s)
            for p in x[3]:
                it = self.filtered(it, p)
            steps = steps[1:]
        return it

    @staticmethod
    def by_position(p: tuple) -> bool:
        return p[0] == "lit" and not isinstance(p[1], str) or p[0] == "call" and p[1] in ("position", "last") or p[0] == "op" and any(x[0] == "call" and x[1] in ("position", "last") for x in p[2:])

    def reached(self, it: Items, steps: tuple) -> Items:
        """The nodes that steps reach from the nodes of the items, each once for each tuple."""
        if not it.node:
            raise Unsupported("a step from values")
        p, base = self.name(), F.col(f"{it.prefix}_pre")
        if len(steps) == 1 and steps[0][1] == "child" and not any(map(self.by_position, steps[0][3])):
            found = self.plan._tested(steps[0][2])
            for x in steps[0][3]:
                found = self.plan.keep(found, x)
            found = found.withColumn("from_pre", F.col("parent"))
        else:
            own = it.df.select("doc_id", *[F.col(f"{it.prefix}_{c}").alias(c) for c in ("pre", "post", "parent")]).dropDuplicates(["doc_id", "pre"])
            found = self.plan.path(("path", False, steps), own.withColumn("from_pre", F.col("pre")), origin=True)
        found = found.select(F.col("doc_id").alias(f"{p}_doc"), F.col("from_pre").alias(f"{p}_from"), *[F.col(c).alias(f"{p}_{c}") for c in NODE])
        df = it.df.join(found, (F.col("doc_id") == F.col(f"{p}_doc")) & (base == F.col(f"{p}_from"))).drop(f"{p}_doc", f"{p}_from")
        if not it.single and any(x[1] not in ("child", "self") for x in steps):
            df = df.dropDuplicates([*it.scope.keys, f"{p}_pre"])
        return Items(df, it.scope, [f"{p}_pre"], "node", p)

    def filtered(self, it: Items, p: tuple) -> Items:
        """The items for which a predicate holds; positions count the items of a tuple."""
        if self.by_position(p):
            if not it.order and not it.single:
                raise Unsupported("positions of unordered items")
            n, last = f"{self.name()}_n", f"{self.name()}_n"
            keys = Window.partitionBy(*it.scope.keys)
            df = it.df.withColumn(n, F.row_number().over(keys.orderBy(*(it.order or [F.lit(0)])))).withColumn(last, F.count("*").over(keys))
            known = {"position": F.col(n), "last": F.col(last)}
            if p[0] == "lit":
                test = F.col(n) == p[1]
            elif p[0] == "call":
                test = F.col(n) == F.col(last) if p[1] == "last" else F.lit(True)
            else:
                side = lambda x: F.lit(x[1]) if x[0] == "lit" else known[x[1]] if x[0] == "call" and x[1] in known else None
                left, right = side(p[2]), side(p[3])
                if left is None or right is None or p[1] not in _COMPARE:
                    raise Unsupported("arithmetic of positions")
                test = _COMPARE[p[1]](left, right)
            return replace(it, df=df.where(test))
        inner = self.keep(p, self.inside(it, it.scope, "."))
        return replace(it, df=inner.df)

    # -- conditions ----------------------------------------------------------------------------

    def keep(self, e: tuple, s: Scope) -> Scope:
        """The tuples for which a condition holds."""

        def joined(hits: DataFrame, keys: list[str], how: str) -> Scope:
            return Scope(s.df.join(hits.select(*keys), keys, how), s.keys, s.outer, s.bound, place=s.place)

        kind = e[0]
        if kind == "paren":
            return self.keep(e[1], s)
        if kind == "op" and e[1] == "and":
            return self.keep(e[3], self.keep(e[2], s))
        negated = kind == "call" and e[1] in ("not", "empty")
        inner = e[2][0] if kind == "call" and e[1] in ("not", "empty", "exists", "boolean") else e
        while inner[0] == "paren":
            inner = inner[1]
        found = self.hits(inner, s)
        if found is not None:
            return joined(*found, "left_anti" if negated else "left_semi")
        test = self.condition(e, s)
        return Scope(s.df.where(test | F.col("_bad") if self.marks else test), s.keys, s.outer, s.bound, place=s.place)

    def hits(self, e: tuple, s: Scope) -> tuple[DataFrame, list[str]] | None:
        """Keys of the tuples for which an existential condition holds, as a table and their names; nothing for other conditions."""
        if e[0] == "op" and e[1] in GENERAL:
            left, right, op = e[2], e[3], e[1]
            if self.is_single(left, s) and self.is_single(right, s):
                return None
            if self.is_single(left, s):
                left, right, op = right, left, _FLIP[op]
            a = self.own_children(left, s) or self.items(left, s)
            if self.is_single(right, s):
                if right[0] == "lit":
                    c, kind = F.lit(right[1]), self.kind_of(right[1])
                else:
                    a = self.lift(self.items(left, s), s)
                    c, kind = self.scalar(right, s)
                    fresh = [x for x in s.df.columns if x not in a.df.columns]
                    if fresh:
                        a = replace(a, df=a.df.join(s.df.select(*s.keys, *fresh), s.keys))
                return a.df.where(self.compared(a.value, a.atomic, op, c, kind)), a.scope.keys
            return self.matched(a, op, self.items(right, s))
        if e[0] in ("some", "every"):
            it = self.items(e[2], s)
            inner = self.inside(self.lift(it, s), s, e[1])
            if e[0] == "every":
                return None
            return self.keep(e[3], inner).df, s.keys
        if (own := self.own_children(e, s)) is not None:
            return own.df, own.scope.keys
        if e[0] == "path" or e[0] in ("filter", "map!", "for") or e[0] == "var" and isinstance(s.find(e[1])[0], Items):
            it = self.items(e, s)
            if it.node or e[0] == "path" and e[2] and e[2][-1][0] == "axis":
                return it.df, it.scope.keys
        return None

    def own_children(self, e: tuple, s: Scope) -> Items | None:
        """The items of one child step from the nodes that a scope right below the documents goes through: they name their tuple, so no join is needed yet.

        Rows of nodes that are no tuple's are among them; what they are joined with leaves them out.
        """
        bound = s.bound.get(".")
        if not isinstance(bound, str) or s.outer is None or s.outer.outer is not None or s.place != f"{bound}_pre" or _free(e) - {"."}:
            return None
        try:
            found = self.plan.children(e)
        except Unsupported:
            return None
        if found is None:
            return None
        p = self.name()
        return Items(found.select("doc_id", F.col("parent").alias(s.keys[-1]), F.lit(False).alias("_bad"), *[F.col(c).alias(f"{p}_{c}") for c in NODE]), s, [f"{p}_pre"], "node", p)

    def matched(self, a: Items, op: str, b: Items) -> tuple[DataFrame, list[str]]:
        """Keys of the deeper of two sequences for which some value of a compares with some value of b."""
        if len(a.scope.keys) < len(b.scope.keys):
            a, b, op = b, a, _FLIP[op]
        numeric = bool({a.atomic, b.atomic} & NUMBERS)
        for x in (a, b):
            if numeric and x.atomic == "string" or (x.atomic == "boolean") != (a.atomic == "boolean"):
                raise Unsupported("values that cannot be compared")
        v = lambda x: self.number(x.value, x.atomic) if numeric else x.value
        keys = b.scope.keys
        left = a.df.select(*a.scope.keys, v(a).alias("_a"))
        right = b.df.select(*keys, v(b).alias("_b"))
        if op == "=":
            right = right.withColumnRenamed("_b", "_a").where("_a is not null")
            return left.join(right, [*keys, "_a"], "left_semi"), a.scope.keys
        if op == "!=":
            ends = right.groupBy(*keys).agg(F.min("_b").alias("_low"), F.max("_b").alias("_high"))
            return left.join(ends, keys).where("_a != _low or _a != _high"), a.scope.keys
        edge = (F.max if op in ("<", "<=") else F.min)("_b")
        return left.join(right.groupBy(*keys).agg(edge.alias("_b")), keys).where(_COMPARE[op](F.col("_a"), F.col("_b"))), a.scope.keys

    def condition(self, e: tuple, s: Scope) -> Column:
        """Whether a condition holds for each tuple of s, never null."""
        kind = e[0]
        if kind == "paren":
            return self.condition(e[1], s)
        if kind == "op" and e[1] in ("and", "or"):
            left, right = self.condition(e[2], s), self.condition(e[3], s)
            return left & right if e[1] == "and" else left | right
        if kind == "call" and e[1] in ("not", "empty"):
            return ~(self.condition(e[2][0], s) if e[1] == "not" else self.there(e[2][0], s))
        if kind == "call" and e[1] == "exists":
            return self.there(e[2][0], s)
        if kind == "call" and e[1] == "boolean":
            return self.condition(e[2][0], s)
        if kind == "every":
            return ~self.condition(("some", e[1], e[2], ("call", "not", (e[3],))), s)
        found = self.hits(e, s)
        if found is not None:
            return self.marked(s, *found)
        if kind == "op" and (e[1] in GENERAL or e[1] in VALUE):
            (a, ka), (b, kb) = self.scalar(e[2], s), self.scalar(e[3], s)
            return F.coalesce(self.compared(a, ka, VALUE.get(e[1], e[1]), b, kb), F.lit(False))
        c, k = self.scalar(e, s)
        test = c if k == "boolean" else c != "" if k in ("string", "untyped") else (c != 0) & ~F.isnan(c.cast("double"))
        return F.coalesce(test, F.lit(False))

    def there(self, e: tuple, s: Scope) -> Column:
        """Whether an expression has any item."""
        if self.is_single(e, s):
            return self.scalar(e, s)[0].isNotNull()
        it = self.items(e, s)
        return self.marked(s, it.df, it.scope.keys)

    def marked(self, s: Scope, hits: DataFrame, keys: list[str]) -> Column:
        c = f"{self.name()}_m"
        s.join(hits.select(*keys).distinct().withColumn(c, F.lit(True)), keys)
        return F.coalesce(F.col(c), F.lit(False))

    @staticmethod
    def number(c: Column, kind: str) -> Column:
        if kind in ("map", "array"):
            raise Unsupported("a map or array as a number")
        return c.cast("double") if kind in NUMBERS or kind == "boolean" else F.trim(c).try_cast("double")

    def compared(self, a: Column, ka: str, op: str, b: Column, kb: str) -> Column:
        if {"map", "array"} & {ka, kb}:
            raise Unsupported("a comparison of maps or arrays")
        if "boolean" in (ka, kb) and ka != kb:
            raise Unsupported("a comparison with a boolean")
        if {ka, kb} & NUMBERS:
            if "string" in (ka, kb):
                raise Unsupported("a comparison of text with a number")
            a, b = self.number(a, ka), self.number(b, kb)
        return _COMPARE[op](a, b)

    # -- single values -------------------------------------------------------------------------

    @staticmethod
    def kind_of(x) -> str:
        return "string" if isinstance(x, str) else "integer" if isinstance(x, int) else "number"

    def is_single(self, e: tuple, s: Scope) -> bool:
        """Whether an expression has one value at most by its form."""
        kind = e[0]
        if kind == "paren":
            return self.is_single(e[1], s)
        if kind == "lit":
            return True
        if kind in ("var", "context"):
            try:
                return not isinstance(s.find(e[1] if kind == "var" else ".")[0], Items)
            except Unsupported:
                return True
        if kind == "op":
            return e[1] not in ("to", "union", "intersect", "except")
        if kind in ("neg", "pos", "cast", "castable", "instance", "some", "every", "map", "array", "array{}"):
            return True
        if kind == "if":
            return self.is_single(e[2], s) and self.is_single(e[3], s)
        if kind == "let":
            return self.is_single(e[3], Scope(s.df, s.keys, s.outer, {**s.bound, e[1]: "?"}))
        if kind == "call":
            return e[1] not in ("distinct-values", "sort", "reverse", "tail", "subsequence", "tokenize", "for-each", "filter", "data", "head", "zero-or-one", "exactly-one", "one-or-more")
        return False

    def shown(self, c: Column, kind: str) -> Column:
        """The text of a value: whole numbers without a point."""
        if kind == "number":
            return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(F.regexp_replace(c.cast("string"), r"\.0E", "E"))
        return c.cast("string")

    def text(self, e: tuple, s: Scope) -> Column:
        c, kind = self.scalar(e, s)
        if kind in ("map", "array"):
            raise Unsupported("a map or array as text")
        return F.coalesce(self.shown(c, kind), F.lit(""))

    def scalar(self, e: tuple, s: Scope) -> tuple[Column, str]:
        """The value of an expression for each tuple of s, null if it has none, and its kind."""
        kind = e[0]
        if kind == "paren":
            return self.scalar(e[1], s)
        if kind == "lit":
            return F.lit(e[1]), self.kind_of(e[1])
        if kind in ("var", "context"):
            bound, _ = s.find(e[1] if kind == "var" else ".")
            if isinstance(bound, str):
                return F.col(f"{bound}_string_value"), "untyped"
            if not isinstance(bound, Items):
                return bound
            return self.one(bound, s)
        if kind == "op" and e[1] == "||":
            return F.concat(self.text(e[2], s), self.text(e[3], s)), "string"
        if kind == "op" and e[1] in ("+", "-", "*", "div", "idiv", "mod"):
            return self.arithmetic(e, s)
        if kind == "op" and (e[1] in GENERAL or e[1] in VALUE or e[1] in ("and", "or")) or kind in ("some", "every"):
            return self.condition(e, s), "boolean"
        if kind in ("neg", "pos"):
            c, k = self.scalar(e[1], s)
            c = self.number(c, k)
            return (-c if kind == "neg" else c), "number"
        if kind == "if":
            test = self.condition(e[1], s)
            (yes, a), (no, b) = self.scalar(e[2], s), self.scalar(e[3], s)
            k = a if a == b else "number" if {a, b} <= NUMBERS else "string" if {a, b} <= {"string", "untyped"} else None
            if k is None:
                raise Unsupported("branches of several kinds")
            return F.when(test, yes.cast(_KINDS[k])).otherwise(no.cast(_KINDS[k])), k
        if kind == "let":
            own = self.let(e, s)
            c, k = self.scalar(e[3], own)
            held = f"{self.name()}_l"
            s.df, s.plain = own.df.withColumn(held, c), False
            return F.col(held), k
        if kind in ("cast", "castable", "instance", "treat"):
            return self.typed(e, s)
        if kind == "apply" and e[1][0] == "function":
            return self.scalar(self.bound_body(e[1], e[2]), s)
        if kind == "call":
            return self.call(e, s)
        if kind == "map":
            return self.map_text(e[1], s), "map"
        if kind == "array{}":
            return self.members(self.items(e[1], s), s, lambda n, all_, first: F.concat(F.lit("["), F.coalesce(all_, F.lit("")), F.lit("]"))), "array"
        if kind == "array":
            if not e[1]:
                return F.lit("[]"), "array"
            return F.concat(F.lit("["), F.concat_ws(", ", *[self.json(x, s, "[]")[0] for x in e[1]]), F.lit("]")), "array"
        if kind not in ("path", "filter", "seq", "for", "map!", "op"):
            raise Unsupported(f"a value of {kind}")
        return self.one(self.items(e, s), s)

    def encoded(self, c: Column, kind: str) -> Column:
        """A value as JSON."""
        if kind in ("map", "array", "boolean"):
            return c.cast("string")
        if kind in NUMBERS:
            number = c.cast("double")
            return F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit("null")).otherwise(self.shown(c, kind))
        quoted = F.to_json(F.array(c))
        return F.substring(quoted, F.lit(2), F.length(quoted) - 2)

    def members(self, it: Items, s: Scope, shape) -> Column:
        """shape(number, all as JSON joined by commas, the first) of the items of each tuple."""
        text, n, bad = self.encoded(it.value, it.atomic), f"{self.name()}_n", f"{self.name()}_b"
        held = f"{self.name()}_j"
        row = F.struct(*it.order, text.alias("_t")) if it.order else F.struct(text.alias("_t"))
        found = it.df.groupBy(*it.scope.keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["_t"]).alias(held), F.count("*").alias(n), F.bool_or("_bad").alias(bad))
        s.join(found, it.scope.keys)
        if self.marks:
            self.bad(s, F.col(bad))
        return shape(F.coalesce(n, F.lit(0)), F.array_join(held, ", "), F.get(held, F.lit(0)))

    def json(self, e: tuple, s: Scope, none: str = "null") -> tuple[Column, Column]:
        """The items of an expression as JSON, bare if it is one, and how it is ordered: 0 for scalars, 1 for maps, 2 for arrays."""
        rank = lambda kind: {"map": 1, "array": 2}.get(kind, 0)
        if self.is_single(e, s):
            c, kind = self.scalar(e, s)
            return F.coalesce(self.encoded(c, kind), F.lit(none)), F.when(c.isNull(), F.lit(0)).otherwise(F.lit(rank(kind)))
        it, ranks = self.items(e, s), []

        def shape(n: Column, every: Column, first: Column) -> Column:
            ranks.append(F.when(n > 1, 2).when(n == 1, F.lit(rank(it.atomic))).otherwise(F.lit(0)))
            return F.when(n == 0, F.lit(none)).when(n == 1, first).otherwise(F.concat(F.lit("["), every, F.lit("]")))

        return self.members(it, s, shape), ranks[0]

    def map_text(self, entries: tuple, s: Scope) -> Column:
        held = []
        for k, v in entries:
            key = self.text(k, s)
            text, rank = self.json(v, s)
            held.append(F.struct(rank.cast("int").alias("r"), key.alias("k"), text.alias("t")))
        if not held:
            return F.lit("{}")
        pairs = F.transform(F.array_sort(F.array(*held)), lambda x: F.concat(self.encoded(x["k"], "string"), F.lit(": "), x["t"]))
        return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))

    def one(self, it: Items, s: Scope) -> tuple[Column, str]:
        """The value of the one item of a sequence; several are an error."""
        v, n, bad = (f"{self.name()}_{x}" for x in "vnb")
        found = it.df.groupBy(*it.scope.keys).agg(F.first(it.value).alias(v), F.count("*").alias(n), F.bool_or("_bad").alias(bad))
        s.join(found, it.scope.keys)
        self.bad(s, (F.col(n) > 1) | F.col(bad))
        return F.col(v), it.atomic

    def arithmetic(self, e: tuple, s: Scope) -> tuple[Column, str]:
        (a, ka), (b, kb) = self.scalar(e[2], s), self.scalar(e[3], s)
        if "string" in (ka, kb) or "boolean" in (ka, kb):
            raise Unsupported("arithmetic with text")
        whole = {ka, kb} == {"integer"}
        if whole and e[1] in ("+", "-", "*"):
            a, b = a.cast("bigint"), b.cast("bigint")
            return {"+": a + b, "-": a - b, "*": a * b}[e[1]], "integer"
        a, b = self.number(a, ka), self.number(b, kb)
        if e[1] in ("idiv", "mod") or e[1] == "div" and whole:
            self.bad(s, b == 0)
        safe = F.nullif(b, F.lit(0.0))
        if e[1] == "idiv":
            q = a / safe
            return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)), "integer"
        if e[1] == "div":
            huge = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))
            return F.when(b == 0, huge).otherwise(a / safe), "number"
        if e[1] == "mod":
            return a % safe, "number"
        return {"+": a + b, "-": a - b, "*": a * b}[e[1]], "number"

    def typed(self, e: tuple, s: Scope) -> tuple[Column, str]:
        word, inner, (name, many) = e
        name = name.rpartition(":")[2]
        wanted = {"string": "string", "integer": "integer", "int": "integer", "long": "integer", "double": "number", "decimal": "number", "float": "number", "boolean": "boolean", "untypedAtomic": "untyped"}.get(name)
        if word == "instance":
            if self.is_single(inner, s):
                c, k = self.scalar(inner, s)
                fits = name == "item()" or name == "anyAtomicType" or k == wanted or name in ("decimal", "numeric") and k == "integer"
                return F.when(c.isNull(), F.lit(many in ("?", "*"))).otherwise(F.lit(fits)), "boolean"
            it = self.items(inner, s)
            n = f"{self.name()}_n"
            fits = name == "item()" or it.node and name in ("node()", "element()") or not it.node and it.kind == wanted
            s.join(it.df.groupBy(*it.scope.keys).agg(F.count("*").alias(n)), it.scope.keys)
            count = F.coalesce(n, F.lit(0))
            size = {"": count == 1, "?": count <= 1, "*": F.lit(True), "+": count >= 1}[many]
            return size & (F.lit(fits) | (count == 0)), "boolean"
        if wanted is None or word == "treat":
            raise Unsupported(f"type {name}")
        c, k = self.scalar(inner, s)
        out = self.cast(c, k, wanted)
        if word == "castable":
            return F.when(c.isNull(), F.lit(many == "?")).otherwise(out.isNotNull()), "boolean"
        self.bad(s, c.isNotNull() & out.isNull())
        return out, wanted

    def cast(self, c: Column, kind: str, wanted: str) -> Column:
        if wanted in ("string", "untyped"):
            return self.shown(c, kind)
        if wanted == "boolean":
            if kind in NUMBERS:
                return (c != 0) & ~F.isnan(c.cast("double"))
            return c if kind == "boolean" else F.when(F.trim(c).isin("true", "1"), F.lit(True)).when(F.trim(c).isin("false", "0"), F.lit(False))
        if wanted == "integer":
            return c.cast("bigint") if kind in NUMBERS or kind == "boolean" else F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint"))
        return self.number(c, kind)

    def call(self, e: tuple, s: Scope) -> tuple[Column, str]:
        name, args = e[1].rpartition(":")[2] if e[1].startswith("fn:") else e[1], e[2]
        if name in AGGREGATES:
            if name in ("exists", "empty", "not", "boolean"):
                return self.condition(e, s), "boolean"
            return self.aggregate(name, args, s)
        if name.startswith("xs:") and len(args) == 1:
            return self.typed(("cast", args[0], (name, "")), s)
        if name in ("true", "false"):
            return F.lit(name == "true"), "boolean"
        if name in ("string", "data", "number") or not args and name in ("string-length", "normalize-space"):
            c, k = self.scalar(args[0] if args else ("context",), s)
            if k in ("map", "array"):
                raise Unsupported("a map or array as text")
            if name == "number":
                return F.coalesce(self.number(c, k), F.lit(float("nan"))), "number"
            text = F.coalesce(self.shown(c, k), F.lit(""))
            return {"string-length": F.char_length(text), "normalize-space": F.trim(F.regexp_replace(text, r"\s+", " "))}.get(name, text), "integer" if name == "string-length" else "string"
        if name in ("name", "local-name"):
            target = args[0] if args else ("context",)
            bound = s.find(target[1] if target[0] == "var" else ".")[0] if target[0] in ("var", "context") else None
            if not isinstance(bound, str):
                raise Unsupported("the name of a path")
            return F.coalesce(F.col(f"{bound}_name"), F.lit("")), "string"
        if name == "concat":
            return F.concat(*[self.text(a, s) for a in args]), "string"
        if name in ("abs", "floor", "ceiling", "round") and len(args) == 1:
            c, k = self.scalar(args[0], s)
            c = self.number(c, k)
            return {"abs": F.abs(c), "floor": F.floor(c), "ceiling": F.ceil(c), "round": F.floor(c + 0.5)}[name].cast("double"), "number"
        given = []
        for a in args:
            c, k = self.scalar(a, s)
            given.append(typed.Value(self.shown(c, k) if k in ("number", "untyped", "string") and not (a[0] == "lit" and k == "number") else c, _TYPES[k if k not in ("number",) else "string"]))
        if name in ("substring", "contains", "starts-with", "ends-with", "upper-case", "lower-case", "translate", "substring-before", "substring-after", "matches", "replace", "normalize-space", "string-length"):
            literal = [typed.Value(F.lit(a[1]), _TYPES[self.kind_of(a[1])]) if a[0] == "lit" else g for a, g in zip(args, given, strict=True)]
            try:
                out = typed.Compiler(typed.Value(F.lit(""), T.StringType())).call(name, literal, None, args)
            except (typed.Unsupported, AttributeError, IndexError, TypeError) as x:
                raise Unsupported(f"{name}()") from x
            k = next((k for k, t in _TYPES.items() if k != "untyped" and type(out.kind) is type(t)), "integer" if isinstance(out.kind, T.IntegralType) else "number")
            return out.column, k
        raise Unsupported(f"{name}()")

    def aggregate(self, name: str, args: tuple, s: Scope) -> tuple[Column, str]:
        it = self.items(args[0], s)
        if name == "count":
            agg, kind, none = F.count("*"), "integer", F.lit(0).cast("bigint")
        elif name == "string-join":
            sep = args[1] if len(args) > 1 else ("lit", "")
            if sep[0] != "lit":
                raise Unsupported("a separator that is no literal")
            row = F.struct(*it.order, self.shown(it.value, it.atomic).alias("_t")) if it.order else F.struct(self.shown(it.value, it.atomic).alias("_t"))
            agg, kind, none = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["_t"]), sep[1]), "string", F.lit("")
        else:
            if it.atomic == "string" or it.atomic == "boolean":
                if name not in ("min", "max") or it.atomic == "boolean":
                    raise Unsupported(f"{name}() of text")
                agg, kind, none = getattr(F, name)(it.value), "string", None
            else:
                whole = it.atomic == "integer" and name != "avg"
                v = it.value if whole else self.number(it.value, it.atomic)
                v = v if it.atomic != "untyped" else F.coalesce(v, F.lit(float("nan")))
                kind = "integer" if whole else "number"
                agg, none = getattr(F, name)(v), F.lit(0).cast(_KINDS[kind]) if name == "sum" else None
        c, bad = f"{self.name()}_g", f"{self.name()}_b"
        s.join(it.df.groupBy(*it.scope.keys).agg(agg.alias(c), F.bool_or("_bad").alias(bad)), it.scope.keys)
        if self.marks:
            self.bad(s, F.col(bad))
        return (F.col(c) if none is None else F.coalesce(F.col(c), none)), kind


def columns(nodes: DataFrame, **expressions: str) -> DataFrame:
    """doc_id and one column for each expression of one value at most: its text, a number where it counts; documents for which all fail are null throughout."""
    out = None
    for name, xpath in expressions.items():
        work = Lifted(nodes)
        c, kind = work.scalar(parse(xpath), work.top)
        shown = c.cast("bigint") if xpath.startswith("count(") else work.shown(c, kind)
        if work.marks:
            shown = F.when(~F.col("_bad"), shown)
        own = work.top.df.select("doc_id", shown.alias(name))
        out = own if out is None else out.join(own, "doc_id")
    return out


def rows(nodes: DataFrame, xpath: str, normalize: bool = True, quoted: bool = False) -> DataFrame:
    """doc_id, file, item_order (its place in the document), item_type, value and, of maps and arrays, tree: one row for each item of an expression.

    quoted shows texts in XPath quotes.
    """
    work = Lifted(nodes)
    it = work.items(parse(normalized(xpath) if normalize else xpath), work.top)
    order = F.struct(*it.order) if it.order else F.struct(F.lit(0).alias("one"))
    built = it.kind in ("map", "array")
    value = work.shown(it.value, it.atomic)
    if quoted and it.kind == "string":
        value = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    none = F.lit(None).cast("string")
    df = it.df.select("doc_id", "file", order.alias("item_order"), F.lit("node" if it.node else it.kind if built else "atomic").alias("item_type"), (none if built else value).alias("value"), (it.value if built else none).alias("tree"), "_bad")
    if work.marks:
        df = df.join(df.where("_bad").select("doc_id").distinct(), "doc_id", "left_anti")
    return df.drop("_bad")
