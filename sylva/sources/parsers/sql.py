"""T-SQL by recursive descent: statements with their clauses, relations, expressions and comments."""

from __future__ import annotations

import re

from ..operators_table import add_op
from ..tree import Node, Positions, document

_TOKEN = re.compile(
    r"(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<string>N?'(?:[^']|'')*')|(?P<number>\d+(?:\.\d+)?)|(?P<name>\[[^\]]+\]|\"[^\"]+\"|[@#]{1,2}\w[\w$#@]*|[A-Za-z_][\w$#@]*)"
    r"|(?P<op><>|!=|<=|>=|\|\||[-+*/%=<>(),.;])|(?P<space>\s+)|(?P<other>.)",
    re.S,
)
_COMPARE = ("=", "<", ">", "<=", ">=", "<>", "!=")
#: Words that end an expression or a list of relations.
_STOPS = frozenset(
    "from where group having order union intersect except into values set on join inner left right full cross outer when then else end as and or not between in like is exists "
    "select insert update delete merge with create begin commit rollback go exec execute declare return using asc desc default primary returns over partition by".split()
)


class Reader:
    def __init__(self, text: str):
        self.where, self.text = Positions(text), text
        self.root = Node("element", "file").at(self.where.span(0, len(text)))
        self.tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "space"]
        self.k, self.now = 0, self.root

    # -- tokens --------------------------------------------------------------------------------

    def comments(self) -> None:
        while self.k < len(self.tokens) and self.tokens[self.k][0] == "comment":
            _, word, a, b = self.tokens[self.k]
            self.now.element("comment").at(self.where.span(a, b)).add_text(word)
            self.k += 1

    def peek(self, ahead: int = 0) -> str:
        """The next word in lower case, comments put where they stand; empty at the end."""
        self.comments()
        k = self.k
        while ahead:
            k += 1
            while k < len(self.tokens) and self.tokens[k][0] == "comment":
                k += 1
            ahead -= 1
        return self.tokens[k][1].lower() if k < len(self.tokens) else ""

    def kind(self) -> str:
        self.comments()
        return self.tokens[self.k][0] if self.k < len(self.tokens) else ""

    def take(self) -> str:
        self.comments()
        word = self.tokens[self.k][1] if self.k < len(self.tokens) else ""
        self.k += 1
        return word

    def skip(self, *words: str) -> bool:
        """Passes over the words if they come next."""
        if all(self.peek(i) == w for i, w in enumerate(words)):
            for _ in words:
                self.take()
            return True
        return False

    def inside(self, parent: Node, name: str):
        return _Element(self, parent, name)

    @staticmethod
    def bare(word: str) -> str:
        return word[1:-1] if word[:1] in '["' else word

    # -- statements ----------------------------------------------------------------------------

    def file(self) -> Node:
        while self.peek():
            self.statement(self.root)
        self.comments()
        return document(self.root)

    def statement(self, parent: Node) -> None:
        self.now = parent
        word = self.peek()
        if word == ";" or word in ("commit", "rollback", "end"):
            self.take()
            return
        if word == "go":
            with self.inside(parent, "go"):
                self.take()
            return
        if word == "begin":
            self.take()
            if self.peek() in ("transaction", "tran"):
                with self.inside(parent, "transaction") as t:
                    self.take()
                    while self.peek() not in ("commit", "rollback", ""):
                        self.statement(t)
                    self.take()
            else:
                while self.peek() not in ("end", ""):
                    self.statement(parent)
                self.take()
            self.now = parent
            return
        with self.inside(parent, "statement") as s:
            {"with": self.ctes, "select": self.query, "insert": self.insert, "update": self.update, "delete": self.delete, "create": self.create, "merge": self.merge, "set": self.set_variable, "exec": self.execute, "execute": self.execute, "return": self.returned}.get(
                word, self.other
            )(s)
        self.now = parent

    def other(self, s: Node) -> None:
        while self.peek() not in (";", "", "go"):
            with self.inside(s, "word") as e:
                e.add_text(self.take())

    def returned(self, s: Node) -> None:
        with self.inside(s, "return") as e:
            self.take()
            self.expression(e)

    def execute(self, s: Node) -> None:
        with self.inside(s, "exec") as e:
            self.take()
            self.reference(e)
            while self.peek() not in (";", "", "go"):
                if not self.skip(","):
                    self.expression(e)

    def set_variable(self, s: Node) -> None:
        with self.inside(s, "set") as e:
            self.take()
            self.variable(e)
            self.skip("=")
            self.expression(e)

    def ctes(self, s: Node) -> None:
        self.take()
        while True:
            with self.inside(s, "cte") as c:
                c.element("name").add_text(self.bare(self.take()))
                self.skip("as")
                self.skip("(")
                with self.inside(c, "statement") as inner:
                    self.query(inner)
                self.skip(")")
            if not self.skip(","):
                break
        self.query(s)

    def query(self, s: Node) -> None:
        self.one_query(s)
        while self.peek() in ("union", "intersect", "except"):
            with self.inside(s, self.peek()) as e:
                self.take()
                if self.skip("all"):
                    e.element("all")
                self.one_query(e)
        if self.peek() == "order":
            self.order_by(s)

    def one_query(self, s: Node) -> None:
        if self.skip("("):
            self.query(s)
            self.skip(")")
            return
        with self.inside(s, "select") as e:
            self.take()
            if self.skip("distinct"):
                e.element("distinct")
            if self.peek() == "top":
                with self.inside(e, "top") as t:
                    self.take()
                    self.primary(t)
            while True:
                self.aliased(e)
                if not self.skip(","):
                    break
        if self.skip("into"):
            with self.inside(s, "into") as e:
                self.reference(e)
        if self.peek() == "from":
            self.from_clause(s)

    def aliased(self, e: Node) -> None:
        self.expression(e)
        self.alias(e)

    def alias(self, e: Node) -> None:
        named = self.skip("as")
        if named or (self.kind() == "name" and self.peek() not in _STOPS and self.peek()[:1] not in "@#"):
            with self.inside(e, "alias") as a:
                a.add_text(self.bare(self.take()))

    def from_clause(self, s: Node) -> None:
        with self.inside(s, "from") as f:
            self.take()
            self.relation(f)
            while True:
                word = self.peek()
                if self.skip(","):
                    self.relation(f)
                elif word in ("join", "inner", "left", "right", "full", "cross"):
                    with self.inside(f, "join") as j:
                        while self.peek() != "join" and self.peek():
                            j.element(self.take().lower())
                        self.take()
                        self.relation(j)
                        if self.skip("on"):
                            self.expression(j)
                elif word == "where":
                    self.where_clause(f)
                elif word == "group":
                    with self.inside(f, "group_by") as g:
                        self.skip("group", "by")
                        self.listed(g)
                elif word == "having":
                    with self.inside(f, "having") as h:
                        self.take()
                        self.expression(h)
                elif word == "order":
                    self.order_by(f)
                else:
                    return

    def where_clause(self, e: Node) -> None:
        with self.inside(e, "where") as w:
            self.take()
            self.expression(w)

    def order_by(self, e: Node) -> None:
        with self.inside(e, "order_by") as o:
            self.skip("order", "by")
            while True:
                with self.inside(o, "order_target") as t:
                    self.expression(t)
                    if self.peek() in ("asc", "desc"):
                        t.element("direction").add_text(self.take())
                if not self.skip(","):
                    return

    def relation(self, e: Node) -> None:
        with self.inside(e, "relation") as r:
            if self.peek() == "(":
                self.subquery(r)
            else:
                self.reference(r)
            self.alias(r)

    def reference(self, e: Node) -> None:
        """A table or routine: name, or schema and name."""
        with self.inside(e, "temp_ref" if self.peek()[:1] == "#" else "ref") as r:
            parts = [self.bare(self.take())]
            while self.skip("."):
                parts.append(self.bare(self.take()))
            if r.name == "temp_ref":
                r.add_text(parts[0])
                return
            for p in parts[:-1]:
                r.element("schema").add_text(p)
            r.element("name").add_text(parts[-1])

    def insert(self, s: Node) -> None:
        with self.inside(s, "insert") as e:
            self.take()
            self.skip("into")
            self.reference(e)
            self.columns(e)
            if self.skip("values"):
                while self.peek() == "(":
                    with self.inside(e, "list") as v:
                        self.take()
                        self.listed(v)
                        self.skip(")")
                    self.skip(",")
            elif self.peek() in ("select", "with"):
                self.query(e)

    def columns(self, e: Node) -> None:
        if self.skip("("):
            with self.inside(e, "list") as cols:
                while self.peek() not in (")", ""):
                    with self.inside(cols, "col") as c:
                        c.element("name").add_text(self.bare(self.take()))
                    self.skip(",")
            self.skip(")")

    def update(self, s: Node) -> None:
        with self.inside(s, "update") as e:
            self.take()
            self.reference(e)
            self.assignments(e)
            if self.peek() == "from":
                self.from_clause(e)
            if self.peek() == "where":
                self.where_clause(e)

    def assignments(self, e: Node) -> None:
        self.skip("set")
        while True:
            with self.inside(e, "assign") as a:
                self.primary(a)
                self.skip("=")
                self.expression(a)
            if not self.skip(","):
                return

    def delete(self, s: Node) -> None:
        with self.inside(s, "delete"):
            self.take()
        with self.inside(s, "from") as f:
            self.skip("from")
            self.reference(f)
            if self.peek() == "where":
                self.where_clause(f)

    def merge(self, s: Node) -> None:
        with self.inside(s, "merge") as e:
            self.take()
            self.skip("into")
            self.relation(e)
            if self.skip("using"):
                self.relation(e)
            if self.skip("on"):
                self.expression(e)
            while self.peek() == "when":
                with self.inside(e, "when") as w:
                    self.take()
                    while self.peek() not in ("then", ""):
                        w.element(self.take().lower())
                    self.take()
                    action = self.take().lower()
                    w.element("action").add_text(action)
                    if action == "update":
                        self.assignments(w)
                    elif action == "insert":
                        self.columns(w)
                        self.skip("values", "(")
                        self.listed(w)
                        self.skip(")")

    def create(self, s: Node) -> None:
        what = self.peek(1)
        with self.inside(s, f"create_{what}") as e:
            self.take()
            self.take()
            self.reference(e)
            if what == "table":
                self.skip("(")
                while self.peek() not in (")", ""):
                    with self.inside(e, "col_def") as c:
                        c.element("name").add_text(self.bare(self.take()))
                        self.type_name(c)
                        while self.peek() not in (",", ")", ""):
                            if self.skip("default"):
                                with self.inside(c, "default") as d:
                                    self.expression(d)
                            else:
                                c.element("constraint").add_text(self.take())
                    self.skip(",")
                self.skip(")")
            elif what in ("function", "procedure", "proc"):
                parens = self.skip("(")
                while self.peek()[:1] == "@":
                    with self.inside(e, "param") as p:
                        self.variable(p)
                        self.type_name(p)
                    self.skip(",")
                if parens:
                    self.skip(")")
                if self.skip("returns"):
                    with self.inside(e, "returns") as r:
                        self.type_name(r)
                self.skip("as")
                with self.inside(e, "body") as b:
                    if self.skip("begin"):
                        while self.peek() not in ("end", ""):
                            if self.peek() == "return":
                                self.returned(b)
                            else:
                                self.statement(b)
                        self.take()
                    else:
                        self.statement(b)
            else:
                self.skip("as")
                self.other(e) if self.peek() != "select" else self.query(e)

    def type_name(self, e: Node) -> None:
        with self.inside(e, "type") as t:
            text = self.take()
            if self.skip("("):
                inner = []
                while self.peek() not in (")", ""):
                    inner.append(self.take())
                self.take()
                text += f"({''.join(inner)})"
            t.add_text(text)

    # -- expressions ---------------------------------------------------------------------------

    def listed(self, e: Node) -> None:
        while self.peek() not in (")", ""):
            self.expression(e)
            if not self.skip(","):
                return

    def expression(self, e: Node, level: int = 0) -> None:
        """or, and, not, comparisons, sums, products, in this order of binding."""
        if level == 2 and self.peek() == "not" and self.peek(1) != "exists":
            with self.inside(e, "not") as n:
                self.take()
                self.expression(n, 2)
            return
        if level == 5:
            self.primary(e)
            return
        operators = (("or",), ("and",), (*_COMPARE, "between", "in", "like", "is", "not"), ("+", "-", "||"), ("*", "/", "%"))[level]
        start = len(e.children)
        self.expression(e, level + 1)
        while self.peek() in operators:
            word = self.peek()
            if level == 2 and word == "not" and self.peek(1) not in ("in", "like", "between"):
                return
            name = {0: "or", 1: "and", 2: "compare", 3: "binary", 4: "binary"}[level]
            negated = level == 2 and word == "not"
            if negated:
                self.take()
                word = self.peek()
            if word in ("between", "in", "like", "is"):
                name = {"in": "in", "like": "like", "is": "is"}.get(word, word)
            held = e.children[start:]
            e.children = e.children[:start]
            with self.inside(e, name) as op:
                first = next((h for h in held if h.line is not None), None)
                if first is not None:
                    op.line, op.column = first.line, first.column
                if negated:
                    op.element("not")
                self.take()
                if name in ("compare", "binary"):
                    add_op(op, word)
                for h in held:
                    op.add(h)
                if word == "between":
                    self.expression(op, 3)
                    self.skip("and")
                    self.expression(op, 3)
                elif word == "in":
                    if self.peek() == "(" and self.peek(1) in ("select", "with"):
                        self.subquery(op)
                    else:
                        with self.inside(op, "list") as v:
                            self.skip("(")
                            self.listed(v)
                            self.skip(")")
                elif word == "is":
                    if self.skip("not"):
                        op.element("not")
                    op.element("null")
                    self.take()
                else:
                    self.expression(op, level + 1)

    def subquery(self, e: Node) -> None:
        with self.inside(e, "subquery") as q:
            self.skip("(")
            if self.peek() == "with":
                self.ctes(q)
            else:
                self.query(q)
            self.skip(")")

    def variable(self, e: Node) -> None:
        with self.inside(e, "var") as v:
            v.add_text(self.take())

    def primary(self, e: Node) -> None:
        word, kind = self.peek(), self.kind()
        if word == "(":
            if self.peek(1) in ("select", "with"):
                self.subquery(e)
                return
            self.take()
            self.expression(e)
            self.skip(")")
        elif word == "exists" or (word == "not" and self.peek(1) == "exists"):
            with self.inside(e, "exists") as x:
                if self.skip("not"):
                    x.element("not")
                self.take()
                self.subquery(x)
        elif word == "case":
            with self.inside(e, "case") as c:
                self.take()
                if self.peek() != "when":
                    self.expression(c)
                while self.skip("when"):
                    self.expression(c)
                    self.skip("then")
                    self.expression(c)
                if self.skip("else"):
                    self.expression(c)
                self.skip("end")
        elif word in ("cast", "try_cast") and self.peek(1) == "(":
            with self.inside(e, "cast") as c:
                self.take()
                self.skip("(")
                self.expression(c)
                self.skip("as")
                self.type_name(c)
                self.skip(")")
        elif word == "*":
            with self.inside(e, "star"):
                self.take()
        elif word == "-" or word == "+":
            with self.inside(e, "unary") as u:
                add_op(u, self.take())
                self.primary(u)
        elif kind in ("string", "number") or word in ("null", "true", "false"):
            with self.inside(e, "literal") as v:
                v.add_text(self.take())
        elif word[:1] == "@":
            self.variable(e)
        elif word[:1] == "#":
            self.reference(e)
        elif kind == "name":
            self.named(e)
        else:
            self.take()

    def named(self, e: Node) -> None:
        """A column, or a call with its window."""
        k = self.k
        parts = [self.bare(self.take())]
        while self.skip("."):
            parts.append("*" if self.peek() == "*" else self.bare(self.peek() and self.tokens[self.k][1]))
            self.take()
        if self.peek() == "(":
            self.k = k
            with self.inside(e, "call") as c:
                self.reference(c)
                self.skip("(")
                self.listed(c)
                self.skip(")")
                if self.skip("over"):
                    with self.inside(c, "window") as w:
                        self.skip("(")
                        if self.peek() == "partition":
                            with self.inside(w, "partition_by") as p:
                                self.skip("partition", "by")
                                self.listed(p)
                        if self.peek() == "order":
                            self.order_by(w)
                        self.skip(")")
            return
        column = e.element("column").at(self.where.span(self.tokens[k][2], self.tokens[self.k - 1][3]))
        if parts[-1] == "*":
            column.name = "star"
        if len(parts) > 1:
            ref = column.element("ref")
            for p in parts[:-2]:
                ref.element("schema").add_text(p)
            ref.element("name").add_text(parts[-2])
        if parts[-1] != "*":
            column.element("name").add_text(parts[-1])


class _Element:
    """An element that begins at the next token and ends at the last one taken."""

    def __init__(self, reader: Reader, parent: Node, name: str):
        self.reader, self.parent, self.name = reader, parent, name

    def __enter__(self) -> Node:
        r = self.reader
        r.now = self.parent
        r.comments()
        self.first = r.k
        self.node = self.parent.element(self.name)
        r.now = self.node
        return self.node

    def __exit__(self, *error) -> None:
        r = self.reader
        if self.first < len(r.tokens):
            end = r.tokens[min(max(r.k - 1, self.first), len(r.tokens) - 1)][3]
            line, column = self.node.line, self.node.column
            self.node.at(r.where.span(r.tokens[self.first][2], end))
            if line is not None:
                self.node.line, self.node.column = line, column
        r.now = self.parent


def structure(text: str) -> Node:
    """file/statement/... with select, from (relations, joins, where, group_by, having, order_by), insert, update and others."""
    return Reader(text).file()
