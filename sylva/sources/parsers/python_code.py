"""Python by ast, comments by tokenize, in the names of the structure vocabulary."""

from __future__ import annotations

import ast
import io
import tokenize

from ..operators_table import add_op
from ..tree import Node, document

_OPERATORS = {
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**", ast.MatMult: "@", ast.LShift: "<<", ast.RShift: ">>",
    ast.BitAnd: "&", ast.BitOr: "|", ast.BitXor: "^", ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Is: "is", ast.IsNot: "is not",
    ast.In: "in", ast.NotIn: "not in", ast.And: "and", ast.Or: "or", ast.Not: "not", ast.USub: "-", ast.UAdd: "+", ast.Invert: "~",
}
#: Elements of statements and expressions; others take their ast class name in lower case.
_NAMES = {
    ast.If: "if", ast.For: "for", ast.While: "while", ast.Return: "return", ast.Call: "call", ast.Import: "import", ast.ImportFrom: "import", ast.Try: "try", ast.With: "with",
    ast.Raise: "raise", ast.Assign: "assign", ast.AugAssign: "assign", ast.AnnAssign: "assign", ast.Lambda: "lambda", ast.Dict: "dict", ast.List: "list", ast.Set: "set",
    ast.Tuple: "tuple", ast.Subscript: "subscript", ast.Await: "await", ast.Yield: "yield", ast.IfExp: "conditional", ast.ListComp: "comprehension", ast.Pass: "pass", ast.Assert: "assert",
}
_BODIES = ("body", "orelse", "finalbody", "handlers")


def structure(text: str) -> Node:
    tree = ast.parse(text)
    lines = text.split("\n")
    root = Node("element", "module")
    root.at((1, 1, len(lines), len(lines[-1].encode()) + 1))
    for s in tree.body:
        _put(root, s, lines)
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                e = Node("element", "comment").at((t.start[0], len(t.line[: t.start[1]].encode()) + 1, t.end[0], len(t.line[: t.end[1]].encode()) + 1))
                e.add_text(t.string)
                _place(root, e)
    except (tokenize.TokenError, IndentationError):
        pass
    return document(root)


def _place(root: Node, e: Node) -> None:
    """Among the children of the module, by position."""
    k = next((k for k, c in enumerate(root.children) if c.line and c.line > e.line), len(root.children))
    e.parent = root
    root.children.insert(k, e)


def _element(parent: Node, name: str, n: ast.AST) -> Node:
    e = parent.element(name)
    if hasattr(n, "lineno"):
        e.at((n.lineno, n.col_offset + 1, n.end_lineno, n.end_col_offset + 1))
    return e


def _source(n: ast.AST, lines: list[str]) -> str:
    rows = [x.encode() for x in lines[n.lineno - 1 : n.end_lineno]]
    if len(rows) == 1:
        return rows[0][n.col_offset : n.end_col_offset].decode("utf-8", "replace")
    return b"\n".join([rows[0][n.col_offset :], *rows[1:-1], rows[-1][: n.end_col_offset]]).decode("utf-8", "replace")


def _operation(parent: Node, name: str, n: ast.AST, op: ast.AST, operands: list, lines: list[str]) -> None:
    e = _element(parent, name, n)
    if len(operands) > 1:
        _put(e.element("left", field="left"), operands[0], lines)
    add_op(e, _OPERATORS[type(op)])
    _put(e.element("right" if len(operands) > 1 else "argument"), operands[-1], lines)


def _put(parent: Node, n: ast.AST, lines: list[str]) -> None:
    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
        e = _element(parent, "function", n)
        if isinstance(n, ast.AsyncFunctionDef):
            e.element("async")
        for d in n.decorator_list:
            _put(_element(e, "decorator", d), d, lines)
        e.element("name", field="name").add_text(n.name)
        params = e.element("params")
        a = n.args
        for p in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]:
            param = _element(params, "param", p)
            param.element("name").add_text(p.arg)
            if p.annotation:
                _element(param, "type", p.annotation).add_text(_source(p.annotation, lines))
        if n.returns:
            _element(e, "returns", n.returns).element("type").add_text(_source(n.returns, lines))
        body = e.element("body")
        for s in n.body:
            _put(body, s, lines)
    elif isinstance(n, ast.ClassDef):
        e = _element(parent, "class", n)
        e.element("name", field="name").add_text(n.name)
        for b in n.bases:
            _put(_element(e, "base", b), b, lines)
        body = e.element("body")
        for s in n.body:
            _put(body, s, lines)
    elif isinstance(n, ast.Expr):
        _put(parent, n.value, lines)
    elif isinstance(n, ast.BinOp):
        _operation(parent, "binary", n, n.op, [n.left, n.right], lines)
    elif isinstance(n, ast.BoolOp):
        _operation(parent, "logical", n, n.op, [n.values[0], n.values[-1]], lines)
    elif isinstance(n, ast.UnaryOp):
        _operation(parent, "unary", n, n.op, [n.operand], lines)
    elif isinstance(n, ast.Compare):
        _operation(parent, "compare", n, n.ops[0], [n.left, n.comparators[-1]], lines)
    elif isinstance(n, ast.Name):
        _element(parent, "name", n).add_text(n.id)
    elif isinstance(n, ast.Attribute):
        e = _element(parent, "member", n)
        _put(e.element("object", field="object"), n.value, lines)
        e.element("property", field="property").add_text(n.attr)
    elif isinstance(n, ast.Constant):
        kind = "string" if isinstance(n.value, (str, bytes)) else "bool" if isinstance(n.value, bool) else "none" if n.value is None else "int" if isinstance(n.value, int) else "float"
        e = _element(parent, kind, n)
        if isinstance(n.value, str):
            e.element("string_content").add_text(n.value)
        else:
            e.add_text(_source(n, lines))
    elif isinstance(n, ast.JoinedStr):
        _element(parent, "string", n).element("string_content").add_text(_source(n, lines))
    elif isinstance(n, ast.Call):
        e = _element(parent, "call", n)
        _put(e, n.func, lines)
        arguments = e.element("arguments")
        for a in n.args:
            _put(arguments, a, lines)
        for k in n.keywords:
            kw = _element(arguments, "keyword", k)
            kw.element("name").add_text(k.arg or "**")
            _put(kw, k.value, lines)
    elif isinstance(n, (ast.Import, ast.ImportFrom)):
        e = _element(parent, "import", n)
        if isinstance(n, ast.ImportFrom):
            e.element("module").add_text("." * n.level + (n.module or ""))
        for a in n.names:
            e.element("name").add_text(a.name)
    else:
        e = _element(parent, _NAMES.get(type(n), type(n).__name__.lower()), n)
        for field, value in ast.iter_fields(n):
            values = [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, ast.AST) and not isinstance(v, (ast.expr_context, ast.operator))]
            inner = e.element("else" if field == "orelse" else field) if values and field in _BODIES else e
            for v in values:
                _put(inner, v, lines)
