"""Languages with braces (and Ruby): declarations with names, types, modifiers, parameters and bodies; statements, imports, calls, binary operations and comments.

No grammar of these languages can be had offline: declarations and expressions come from patterns, statements from
their keywords and brackets. A grammar library can be plugged in with register().
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..operators_table import add_op
from ..tree import Node, Positions, document
from .statements import GRAMMARS, RUBY, Code, Statements, ruby_blocks


@dataclass(frozen=True)
class Shape:
    root: str
    #: Declarations: element name -> pattern with a group called name; the text before it on the line gives modifiers.
    declarations: tuple[tuple[str, str], ...]
    modifiers: frozenset = frozenset()
    #: Marker of a declaration without a modifier of access, by element name.
    default_access: dict = field(default_factory=dict)
    access: frozenset = frozenset()
    line_comment: str = "//"
    #: A marker made from the name itself.
    by_name: Callable[[str], str] | None = None
    #: Calls hold what is called in a function element: a reference, or a member of an object.
    call_function: bool = False
    #: Further elements: a pattern with a group called at, and their name.
    more: tuple[tuple[str, str], ...] = ()
    #: Names of the list of parameters and of one of them.
    parameters: tuple[str, str] = ("params", "param")
    #: Markup elements stand in expressions.
    markup: bool = False


#: Comments over lines by a language's root element and line comment; the rest have those of C (fixed values).
BLOCK_COMMENTS = {("chunk", "--"): r"--\[\[.*?\]\]|", ("haskell", "--"): r"\{-.*?-\}|", ("compilation_unit", "(*"): r"\(\*.*?\*\)", ("source_file", "#"): r"#=.*?=#|"}
#: Stands for each character of a string literal.
FILL = "\x01"
_ID = r"[A-Za-z_$][\w$]*"
_C_TYPES = (("namespace", rf"\bnamespace\s+(?P<name>[\w.]+)"), ("class", rf"\bclass\s+(?P<name>{_ID})"), ("interface", rf"\binterface\s+(?P<name>{_ID})"), ("enum", rf"\benum\s+(?P<name>{_ID})"), ("struct", rf"\bstruct\s+(?P<name>{_ID})"), ("record", rf"\brecord\s+(?P<name>{_ID})"))
_METHOD = rf"(?:(?<=[\s>\]])|^)(?P<name>{_ID})(?:<[^<>()]*>)?\s*(?=\()"
_ACCESS = frozenset("public private protected internal".split())
_JS = (
    ("class", rf"\bclass\s+(?P<name>{_ID})"), ("interface", rf"\binterface\s+(?P<name>{_ID})"), ("enum", rf"\benum\s+(?P<name>{_ID})"), ("function", rf"\bfunction\b\s*\*?\s*(?P<name>{_ID})\s*(?=[(<])"),
    ("typealias", rf"\btype\s+(?P<name>{_ID})\s*(?:<[^=]*>)?\s*(?==)"), ("variable", rf"\b(?P<kind>let|const|var)\s+(?P<name>{_ID}|[\[{{][^=;]*?[\]}}](?=\s*=))"),
)
_BINARY = re.compile(rf"(?P<left>[\w.$]+(?:\([^()]*\))?|\x01+)\s*(?P<op>===|!==|==|!=|<=|>=|&&|\|\||\?\?|[-+*/%]|(?<=\s)[<>](?=\s))(?!=)\s*(?=(?P<right>[\w.$]+|\x01+))")
_IMPORT = re.compile(r"^[ \t]*(?:using|import|use|require|from|#include)\b[^\n;(]*", re.M)
#: Words before a name that are no type.
_NO_TYPES = frozenset("function func fn def class interface enum struct record namespace package trait impl mod let const var type module macro import using".split())
_NOT_FIELDS = frozenset("return using import package new throw else goto await yield case namespace class enum struct interface record var".split())
_NOT_CALLS = frozenset("pub import super if for while switch catch return function func fn new sizeof match elif using lock foreach typeof await def class".split())

_LAMBDA = (r"(?P<at>(?:\([^()]*\)|\b[A-Za-z_$][\w$]*)\s*(?::\s*[\w<>\[\]. |]+?)?\s*=>)", "lambda")
_TYPED_NAME = rf"(?P<type>[A-Za-z_][\w.]*(?:<[^;(){{}}=]*>)?(?:\[\])?\??)\s+(?P<name>{_ID})\s*(?=[;=](?!=))"

SHAPES: dict[str, Shape] = {
    "csharp": Shape("unit", (*_C_TYPES, ("property", rf"(?P<name>{_ID})\s*(?=\{{\s*(?:get|set|init)\b)"), ("method", _METHOD), ("field", _TYPED_NAME)), frozenset("static async virtual override abstract sealed readonly partial const".split()) | _ACCESS, {"class": "internal", "method": "private", "property": "private", "interface": "internal", "enum": "internal", "struct": "internal", "field": "private"}, _ACCESS, more=(_LAMBDA, (r"(?<![\w.])(?P<at>\d+)(?![\w.])", "int"), (r"\b(?P<at>new\s+(?P<type>[A-Za-z_][\w.]*(?:<[^;(){}]*>)?)(?=\s*\())", "new"), (r"(?P<at>\b\w+!\.\w+)", "member"), (r"(?P<at>\b\w+!)(?![=\w])", "postfix_unary_expression")), parameters=("parameters", "parameter")),
    "java": Shape("program", (*_C_TYPES[1:], ("method", _METHOD)), frozenset("static final abstract synchronized".split()) | _ACCESS, {"class": "package-private", "method": "package-private", "interface": "package-private", "enum": "package-private"}, _ACCESS),
    "rust": Shape("file", (("function", rf"\bfn\s+(?P<name>{_ID})"), ("struct", rf"\bstruct\s+(?P<name>{_ID})"), ("enum", rf"\benum\s+(?P<name>{_ID})"), ("trait", rf"\btrait\s+(?P<name>{_ID})"), ("impl", rf"\bimpl\b(?:<[^>]*>)?\s+(?P<name>[\w:<> ]+?)\s*(?={{)"), ("mod", rf"\bmod\s+(?P<name>{_ID})"), ("let", rf"(?<!while )(?<!if )\blet\s+(?:mut\s+)?(?P<name>{_ID})"), ("macro", rf"(?P<name>{_ID})!\s*(?=[(\[{{])")), frozenset("pub async unsafe const static mut".split()), {"function": "private", "struct": "private", "enum": "private", "trait": "private"}, frozenset(["pub"])),
    "go": Shape("file", (("function", rf"\bfunc\s+(?:\([^)]*\)\s*)?(?P<name>{_ID})"), ("struct", rf"\btype\s+(?P<name>{_ID})\s+struct\b"), ("interface", rf"\btype\s+(?P<name>{_ID})\s+interface\b"), ("package", rf"\bpackage\s+(?P<name>{_ID})"), ("variable", rf"\bvar\s+(?P<name>{_ID})")), by_name=lambda n: "exported" if n[:1].isupper() else "unexported"),
    "javascript": Shape("program", _JS, frozenset("async static export default".split()), call_function=True, more=(_LAMBDA,), markup=True),
    "typescript": Shape("program", _JS, frozenset("async static export default public private protected readonly abstract declare".split()), call_function=True, more=(_LAMBDA,), markup=False),
    "tsx": Shape("program", _JS, frozenset("async static export default public private protected readonly abstract declare".split()), call_function=True, more=(_LAMBDA,), markup=True),
    "ruby": Shape("program", (("class", rf"\bclass\s+(?P<name>[\w:]+)"), ("module", rf"\bmodule\s+(?P<name>[\w:]+)"), ("method", rf"\bdef\s+(?:self\.)?(?P<name>[\w]+[?!=]?)")), line_comment="#", more=((r"^\s*(?P<at>(?P<name>(?!(?:def|class|module|end|if|unless|while|until|return|else|elsif|case|when|do|begin|rescue|ensure|yield|then|and|or|not)\b)[a-z_]\w*)[ \t]+(?=[\x01:\w@\[]).*)$", "call"),)),
    "cpp": Shape("translation_unit", (*_C_TYPES[:2], _C_TYPES[4], _C_TYPES[3], ("function_definition", _METHOD)), frozenset("static virtual inline const".split())),
    "c": Shape("translation_unit", (_C_TYPES[4], _C_TYPES[3], ("function_definition", _METHOD)), frozenset("static inline const".split())),
    "css": Shape("stylesheet", (("rule_set", r"(?:^|[};])\s*(?P<name>[^{};@]+?)\s*(?=\{)"),)),
    "bash": Shape("program", (("function_definition", rf"(?:\bfunction\s+(?P<name>{_ID})|^\s*(?P<name2>{_ID})\s*\(\))"),), line_comment="#"),
    "php": Shape("program", (_C_TYPES[0], *_C_TYPES[1:4], ("function", rf"\bfunction\s+(?P<name>{_ID})")), frozenset("static final abstract".split()) | _ACCESS),
    "scala": Shape("compilation_unit", (("class_definition", rf"\bclass\s+(?P<name>{_ID})"), ("object_definition", rf"\bobject\s+(?P<name>{_ID})"), ("trait_definition", rf"\btrait\s+(?P<name>{_ID})"), ("function_definition", rf"\bdef\s+(?P<name>{_ID})"))),
    "lua": Shape("chunk", (("function_declaration", r"\bfunction\s+(?P<name>[\w.:]+)"),), line_comment="--"),
    "haskell": Shape("haskell", (("signature", rf"^(?P<name>{_ID})\s*::"), ("data_type", r"^data\s+(?P<name>\w+)")), line_comment="--"),
    "ocaml": Shape("compilation_unit", (("value_definition", rf"\blet\s+(?:rec\s+)?(?P<name>{_ID})"), ("type_definition", rf"\btype\s+(?P<name>{_ID})")), line_comment="(*"),
    "r": Shape("program", (("function_definition", r"(?P<name>[\w.]+)\s*<-\s*function\b"),), line_comment="#"),
    "julia": Shape("source_file", (("function_definition", r"\bfunction\s+(?P<name>[\w.!]+)"), ("struct_definition", r"\bstruct\s+(?P<name>\w+)")), line_comment="#"),
}
LANGUAGES = frozenset(SHAPES)
#: Names that grammars give these elements in languages whose names stay as they are (fixed values).
RAW_NAMES = {
    "c": {"call": "call_expression", "binary": "binary_expression", "import": "preproc_include"},
    "cpp": {"call": "call_expression", "binary": "binary_expression", "import": "preproc_include"},
    "php": {"call": "function_call_expression", "binary": "binary_expression", "import": "namespace_use_declaration"},
    "scala": {"call": "call_expression", "binary": "infix_expression", "import": "import_declaration"},
    "lua": {"call": "function_call", "binary": "binary_expression"},
    "julia": {"call": "call_expression", "binary": "binary_expression", "import": "import_statement"},
    "r": {"binary": "binary_operator"},
    "css": {"import": "import_statement"},
    "go": {},
}
#: Parts of statements that stand in elements of their own (fixed values).
WRAPPERS = frozenset("condition consequence alternative body value".split())
_ATOM = r"[\w.$\x01]+(?:\([^()]*\)|\[[^\[\]]*\])*"
_NEW = (rf"\bnew\s+{_ATOM}", "new")
_AWAIT = (rf"\bawait\s+{_ATOM}", "await")
_ASSIGN = (rf"(?<![\w.?<>=!$])(?<![\w>\]?]\s){_ATOM}\s*(?<![<>=!])=(?![=>])\s*[^;{{}}\n]+(?=;)", "assign")
_CONDITION = rf"(?<![\w.$])(?!(?:return|case|else|throw|yield)\b){_ATOM}(?:\s*(?:[<>]=?|[=!]==?|&&|\|\|)\s*{_ATOM})*"
_TERNARY = (rf"{_CONDITION}\s*\?\s*(?![.?\[>,)])[^;{{}}?:\n]+:\s*[^;{{}}:,)\n]+", "ternary")
#: Expressions inside statements, by patterns.
EXPRESSIONS = {
    "csharp": (_AWAIT, _ASSIGN, _TERNARY),
    "java": (_NEW, _ASSIGN, _TERNARY),
    "javascript": (_AWAIT, _NEW, _TERNARY),
    "rust": ((r"[\w.]+(?:\([^()]*\))?\.await\b", "await"), (r"(?<![\w|])\|[^|;{}\n]*\|\s*(?=[\w({&*!])[^;,{}\n()]*(?:\([^()]*\))*", "closure")),
    "ruby": ((r"(?<![\w.])return\b[^\n]*?(?=\s+(?:if|unless)\b|\n|$)", "return"),),
}
EXPRESSIONS |= {"typescript": EXPRESSIONS["javascript"], "tsx": EXPRESSIONS["javascript"]}


def parser(language: str, mode: str) -> Callable[[str], Node]:
    shape = SHAPES[language]
    return lambda text: _parse(text, shape, language)


def _blank(text: str, shape: Shape, where: Positions, comments: list[Node]) -> str:
    """The text with comments blanked out and literals filled, so that patterns and braces see code alone."""
    c = re.escape(shape.line_comment) + r"[^\n]*"
    c = BLOCK_COMMENTS.get((shape.root, shape.line_comment), "") + (c if shape.line_comment != "(*" else "")
    skip = re.compile(rf"{c}|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)

    def hide(m: re.Match) -> str:
        if m.group().startswith((shape.line_comment, "/*", "{-")):
            comments.append(Node("element", "comment").at(where.span(*m.span())))
            comments[-1].add_text(m.group())
            return re.sub(r"[^\n]", " ", m.group())
        return re.sub(r"[^\n]", FILL, m.group())

    return skip.sub(hide, text)


def _matching(code: Code, at: int, open_: str, close: str) -> int:
    return code.after(at)


def _parse(text: str, shape: Shape, language: str = "") -> Node:
    where, root, comments = Positions(text), Node("element", shape.root), []
    root.at(where.span(0, len(text)))
    code = Code(_blank(text, shape, where, comments))
    raw = RAW_NAMES.get(language, {})
    blocks = {start: end for _, start, end in ruby_blocks(code)} if language == "ruby" else {}
    found: list[tuple[int, int, Node]] = []
    taken: set[int] = set()
    # statements and their parts, calls and variables hold all of their text: they take in what lies between their elements
    whole: dict[int, tuple[int, int]] = {}
    places: dict[int, list[tuple[int, int, Node]]] = {}
    classes = set(re.findall(rf"\bclass\s+({_ID})", code)) if shape.default_access else set()
    for name, pattern in shape.declarations:
        for m in re.finditer(pattern, code, re.M):
            word = m.groupdict().get("name") or m.groupdict().get("name2")
            at = m.start("name") if m.group("name") else m.start("name2")
            if word in _NOT_CALLS or at in taken or (name == "field" and m.group("type") in _NOT_FIELDS):
                continue
            line = code.rfind("\n", 0, m.start()) + 1
            begin = max(line, code.rfind(";", line, m.start()) + 1, code.rfind("{", line, m.start()) + 1, code.rfind("}", line, m.start()) + 1)
            before = code[begin : m.start()]
            if name in ("method", "function_definition") and "P<name2>" not in pattern and pattern is _METHOD:
                after = code[_matching(code, code.index("(", m.end()), "(", ")") :].lstrip()
                bare = before
                while (less := re.sub(r"<[^<>]*>", "", bare)) != bare:
                    bare = less
                if (not bare.strip() and word not in classes) or re.search(r"[=.(,]|\b(?:return|new|await|throw|else)\s*$", bare) or not after.startswith(("{", ";", "=>", "throws", "where", ":", "const")):
                    continue
            if name == "function" and shape.root == "file" and shape.default_access and _signature(code, m.end()):
                continue
            if name == "method" and shape.default_access and not _typed(before, shape):
                e = Node("element", "ctor" if shape.root == "program" else "constructor")
            else:
                e = Node("element", name)
            words = re.findall(r"[\w-]+", before) + re.findall(r"[\w-]+", m.group()[: at - m.start()])
            for w in dict.fromkeys(words):
                if w in shape.modifiers or (w == m.groupdict().get("kind")):
                    e.element(w)
                    if w == "pub" and (r := re.search(r"\bpub\((\w+)\)", before + m.group())):
                        e.children[-1].element(r.group(1))
            if name in shape.default_access and not set(words) & shape.access:
                e.element(shape.default_access[name])
            if shape.by_name:
                e.element(shape.by_name(word))
            start = begin + len(before) - len(before.lstrip())
            if name == "field":
                _type(e, m.group("type"))
            elif name in ("method", "property", "function_definition") and e.name not in ("constructor", "ctor"):
                kind = re.sub(rf"\b(?:{'|'.join(sorted(shape.modifiers | {'public'}))})\b", " ", text[start:at]).strip()
                if kind and not set(re.findall(r"\w+", kind)) & _NO_TYPES and not kind.startswith(("@", "[")):
                    _type(e if name == "property" else e.element("returns", field="returns"), kind)
            if shape.root == "unit" and (held := code.lists_before(start)) < start:
                e.element("attributes").add_text(text[held:start].strip())
            e.element("name", field="name").at(where.span(at, at + len(word))).add_text(word)
            end = blocks.get(start) or _body(e, code, text, m.end(), where, shape)
            taken.add(at)
            found.append((start, end, e.at(where.span(start, end))))
            if name in ("field", "variable", "let") and all(c.name in ("name", "type", "body") or not c.children for c in e.children):
                spot = {"name": (at, at + len(word)), "type": m.span("type") if name == "field" else (start, start)}
                whole[id(e)] = (start, end)
                places[id(e)] = [(*spot.get(c.name, (start, start)), c) for c in e.children if c.name != "body"]
    for m in re.finditer(rf"(?P<name>{_ID}(?:\.{_ID})*)\s*\(", code):
        if m.start("name") in taken or m.group("name") in _NOT_CALLS or re.search(r"\b(?:function|def|fn|func|new)\s+$|[!@]$", code[max(0, m.start() - 12) : m.start()]):
            continue
        end = _matching(code, m.end() - 1, "(", ")")
        if shape.by_name and re.match(r"[ \t]+[A-Za-z*\[(]", code[end : end + 40]):
            continue  # a method of an interface
        e = Node("element", raw.get("call", "call")).at(where.span(m.start(), end))
        if shape.call_function:
            _called(e.element("function", field="function"), m.group("name"))
        else:
            e.element("name").add_text(m.group("name"))
        whole[id(e)] = (m.start(), end)
        places[id(e)] = [(m.start(), m.end("name"), e.children[0])]
        found.append((m.start(), end, e))
    for pattern, name in shape.more:
        for m in re.finditer(pattern, code, re.M):
            if m.groupdict().get("name") not in _NOT_CALLS:
                e = Node("element", name).at(where.span(m.start("at"), m.end("at")))
                if m.groupdict().get("name"):
                    e.element("name").add_text(m.group("name"))
                elif m.groupdict().get("type"):
                    _type(e, m.group("type"))
                    whole[id(e)], places[id(e)] = m.span("at"), [(*m.span("type"), e.children[0])]
                elif name == "member":
                    e.element("property", field="property").add_text(text[m.start("at") : m.end("at")].rpartition(".")[2])
                else:
                    e.add_text(text[m.start("at") : m.end("at")])
                found.append((m.start("at"), m.end("at"), e))
    if shape.markup:
        _jsx(code, text, where, found)
    operands: dict[int, list[tuple[int, int, Node]]] = {}
    chain: list[tuple[int, int, Node]] = []  # the operation at hand, from its first operand on
    for m in _BINARY.finditer(code):
        if m.group("left") in _NOT_CALLS:
            continue
        e = Node("element", raw.get("binary", "binary"))
        left, at = Node("element", "left", attrs={"field": "left"}), m.span("left")
        if chain and chain[-1][1] == at[1]:
            # what was the right operand so far begins a further operation: the one before is its left
            begin, end, before = chain.pop()
            left.add(before)
            at = (begin, end)
            whole[id(left)], places[id(left)] = at, [(begin, end, before)]
        else:
            found += chain
            left.add_text(text[slice(*at)])
            chain = []
        e.add(left)
        add_op(e, m.group("op"))
        e.element("right", field="right").add_text(text[m.start("right") : m.end("right")])
        whole[id(e)] = (at[0], m.end("right"))
        places[id(e)] = list(zip((at[0], m.start("op"), m.start("right")), (at[1], m.end("op"), m.end("right")), e.children, strict=True))
        operands[id(e)] = [places[id(e)][0], places[id(e)][2]]
        chain = [(at[0], m.end("right"), e.at(where.span(at[0], m.end("right"))))]
    found += chain
    for m in _IMPORT.finditer(code):
        e = Node("element", raw.get("import", "import")).at(where.span(m.start(), m.end()))
        e.element("name").add_text(text[m.start() : m.end()].split(None, 1)[-1].strip().strip("\"'<>"))
        found.append((m.start(), m.end(), e))
    for c in _grouped(comments, text) if shape.line_comment == "//" else comments:
        start = where.starts[c.line - 1] + len(text[where.starts[c.line - 1] :].encode()[: c.column - 1].decode("utf-8", "ignore"))
        found.append((start, start + 1, c))
    def put(name: str, start: int, end: int) -> None:
        e = Node("element", name, attrs={"field": name} if name in WRAPPERS else {}).at(where.span(start, end))
        whole[id(e)] = (start, end)
        found.append((start, end, e))

    if language in GRAMMARS:
        Statements(code, GRAMMARS[language], put).run()
    for pattern, name in EXPRESSIONS.get(language, ()):
        for m in re.finditer(pattern, code):
            put(name, *m.span())
    if language == "ruby":
        for kind, start, end in ruby_blocks(code):
            if kind not in ("class", "module", "def", "do"):
                put(RUBY[kind], start, end)
    stack: list[tuple[int, Node]] = [(len(text) + 1, root)]
    for start, end, e in sorted(found, key=lambda x: (x[0], -x[1], x[2].name not in WRAPPERS)):
        while stack[-1][0] <= start:
            stack.pop()
        parent = stack[-1][1]
        # the body of a declaration takes what the declaration holds
        inner = parent if id(parent) in whole else next((c for c in parent.children if c.name == "body" and c.kind == "element" and id(c) not in whole), parent)
        holder: Node | None = parent
        while holder is not None:
            place = next(((a, b, c) for a, b, c in operands.get(id(holder), ()) if a <= start and end <= b), None)
            holder = None
            if place:
                inner = place[2]
                whole.setdefault(id(inner), place[:2])
                holder = next((c for c in inner.children if id(c) in operands), None)
        if e.name == "field" and any(n.name in ("method", "constructor", "ctor", "property") for _, n in stack):
            e.name = "variable"
        inner.add(e)
        if id(inner) in whole:
            places.setdefault(id(inner), []).append((start, min(end, whole[id(inner)][1]), e))
        stack.append((end, e))
    for e in root.descendants() if whole else ():
        if id(e) in whole:
            _filled(e, *whole[id(e)], places.get(id(e), []), text)
    return document(root)


def _filled(e: Node, start: int, end: int, inner: list[tuple[int, int, Node]], text: str) -> None:
    """Puts the text between the elements of a statement among them."""
    e.children, at = [], start
    for a, b, c in inner:
        e.add_text(text[at:a])
        e.add(c)
        at = max(at, b)
    e.add_text(text[at:end])


def _typed(before: str, shape: Shape) -> bool:
    """Whether a type stands before a name."""
    return bool(set(re.findall(r"[\w<>\[\]?.]+", before)) - shape.modifiers - {"public"})


def _signature(code: str, at: int) -> bool:
    """Whether a declaration ends without a body."""
    stop = re.compile(r"[{;]").search(code, at)
    return bool(stop and stop.group() == ";")


def _called(e: Node, name: str) -> None:
    holder, dot, last = name.rpartition(".")
    if not dot:
        e.element("ref")
        e.add_text(name)
        return
    member = e.element("member")
    member.element("object", field="object").add_text(holder)
    member.element("property", field="property").add_text(last)


_TAG = re.compile(r"<(?P<name>[A-Za-z][\w.]*)(?=[\s/>])")


def _jsx(code: str, text: str, where: Positions, found: list) -> None:
    """Markup elements with their tags, attributes, expressions and texts."""

    def put(name: str, a: int, b: int, content: str | None = None) -> None:
        e = Node("element", name).at(where.span(a, b))
        if content:
            e.add_text(content)
        found.append((a, b, e))

    def element(m: re.Match) -> int:
        at = m.end()
        while at < len(code):  # attributes
            if code[at] == "{":
                at = _matching(code, at, "{", "}")
            elif code[at] == ">" or code.startswith("/>", at):
                break
            elif a := re.compile(r"[\w-]+(\s*=\s*)?").match(code, at):
                end = a.end()
                if a.group(1):
                    value = code[end : end + 1]
                    stop = _matching(code, end, "{", "}") if value == "{" else re.compile(r"\x01*").match(code, end).end()
                    if value == "{":
                        put("jsx_expression", end, stop, text[end:stop])
                    end = stop
                put("jsx_attribute", at, end)
                at = max(end, at + 1)
            else:
                at += 1
        closed = code.startswith("/>", at)
        at = min(at + 1 + closed, len(code))
        put("jsx_self_closing_element" if closed else "jsx_opening_element", m.start(), at)
        if not closed:
            at = children(at)
            end = code.find(">", at) + 1 or len(code)
            put("jsx_closing_element", at, end)
            put("jsx_element", m.start(), end)
            return end
        return at

    def children(at: int) -> int:
        begin = at
        while at < len(code) and not code.startswith("</", at):
            if code[at] not in "{<":
                at += 1
                continue
            said(begin, at)
            if code[at] == "{":
                end = _matching(code, at, "{", "}")
                put("jsx_expression", at, end)
                search(at + 1, end)
                at = end
            else:
                m = _TAG.match(code, at)
                at = element(m) if m else at + 1
            begin = at
        said(begin, at)
        return at

    def said(a: int, b: int) -> None:
        if text[a:b].strip():
            put("jsx_text", a, b, text[a:b].strip())

    def search(at: int, end: int) -> None:
        while m := _TAG.search(code, at, end):
            before = code[:m.start()].rstrip()
            at = element(m) if not before or before[-1] in "({[,;:?=&|>" or before.endswith("return") else m.end()

    search(0, len(code))


def _type(parent: Node, text: str) -> None:
    """A type with markers of generic and nullable types; its string value is the text."""
    e = parent.element("type", field="type")
    if text.endswith("?"):
        e.element("nullable")
    m = re.match(r"([\w.]+)<(.*)>(.*)$", text, re.S)
    if not m:
        e.add_text(text)
        return
    e.element("generic")
    e.add_text(m.group(1))
    arguments = e.element("arguments")
    arguments.add_text("<")
    depth, at, parts = 0, 0, []
    for k, c in enumerate(m.group(2)):
        depth += (c in "<([") - (c in ">)]")
        if c == "," and not depth:
            parts.append(m.group(2)[at:k])
            at = k + 1
    parts.append(m.group(2)[at:])
    for k, p in enumerate(parts):
        if k:
            arguments.add_text("," + p[: len(p) - len(p.lstrip())])
        _type(arguments, p.strip())
    arguments.add_text(">")
    e.add_text(m.group(3))


def _grouped(comments: list[Node], text: str) -> list[Node]:
    """Line comments on adjacent lines as one; a comment right above code is leading, one after code on its line trailing."""
    rows = text.split("\n")
    out: list[Node] = []
    for c in comments:
        last = out[-1] if out else None
        own_line = not rows[c.line - 1].encode()[: c.column - 1].strip()
        said = c.children[0].text
        if last is not None and said.startswith("//") and last.children[0].text.startswith("//") and own_line and last.end_line + 1 == c.line and not rows[last.line - 1].encode()[: last.column - 1].strip():
            last.children[0].text += "\n" + said
            last.end_line, last.end_column = c.end_line, c.end_column
        else:
            out.append(c)
    for c in out:
        before = rows[c.line - 1].encode()[: c.column - 1].strip()
        below = rows[c.end_line].strip() if c.end_line < len(rows) else ""
        if before:
            c.element("trailing")
        elif below and not below.startswith(("//", "/*", "}", "*")):
            c.element("leading")
    return out


def _body(e: Node, code: str, text: str, at: int, where: Positions, shape: Shape) -> int:
    """Parameters and body that follow a declaration's name; where the declaration ends."""
    m = re.compile(r"\s*(?:<[^<>()]*>)?\s*\(").match(code, at)
    if m:
        end = _matching(code, m.end() - 1, "(", ")")
        params = e.element(shape.parameters[0]).at(where.span(m.end() - 1, end))
        for p in filter(str.strip, re.split(r",(?![^<(\[]*[>)\]])", text[m.end() : end - 1])):
            param = params.element(shape.parameters[1])
            typed = re.match(r"\s*(?P<marks>(?:(?:this|ref|out|in|params|final)\s+)*)(?P<type>[\w.]+(?:<.*>)?(?:\[\])?\??)\s+(?P<name>\w+)\s*(?:=.*)?$", p, re.S) if shape.root in ("unit", "program") and shape.default_access else None
            if typed:
                for w in typed.group("marks").split():
                    param.element(w)
                _type(param, typed.group("type"))
                param.add_text(" ")
                param.element("name", field="name").add_text(typed.group("name"))
                continue
            if ":" in p or "?" in p:
                param.element("optional" if "?" in p.split(":")[0] or "=" in p else "required")
            param.add_text(p.strip())
        at = end
    stop = re.compile(r"[{;]").search(code, at)
    if stop and stop.group() == "{" and "\n\n" not in code[at : stop.start()]:
        end = _matching(code, stop.start(), "{", "}")
        e.element("body").at(where.span(stop.start(), end))
        return end
    if stop and stop.group() == ";":
        return stop.end()
    line = code.find("\n", at)
    return line if line >= 0 else len(code)
