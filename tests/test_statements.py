import pytest

from sylva.plans.evaluate import evaluate
from sylva.sources.parsers import parse
from sylva.sources.parsers.statements import Code

CSHARP = """class C { public async Task<int> M(int a, List<int> xs) {
    if (a > 1) { return a; } else if (a < 0) return -1; else { throw new E("x"); }
    foreach (var x in xs) { Use(x); }
    for (int i = 0; i < 3; i++) total += i;
    try { await Go(); } catch (E e) when (e.X) { Log(e); } finally { Done(); }
    while (a > 0) { a = a - 1 - b; }
    do { a++; } while (a < 3);
    switch (a) { case 1: F(); break; default: break; }
    using (var f = Open()) { f.Read("if (no) return;"); }
    var y = a > 1 ? 2 : 3; // return here
    return y;
} }"""
SCRIPT = """class A { m(x) { if (x > 1) { return x }
  for (const k of xs) { f(k) }
  const r = await g(1)
  throw new Error("x")
} }
function h(a) { return a ? 1 : 2; }
switch (z) { case 1: q(); break; default: w() }
const o = { if: 1, return: 2 }; o.if = 3;
"""
RUST = """fn f(x: i32) -> i32 {
    if x > 1 { return x; } else { loop { break; } }
    for i in 0..3 { g(i); }
    let y = match x { 1 => 2, n if n > 3 => { h(n) } _ => 0, };
    while let Some(z) = it.next() { k(z); }
    y
}"""
GO = "package p\nfunc F(a int) int {\n\tif a > 1 { return a } else { go G(); defer H() }\n\tfor i := 0; i < 3; i++ { use(i) }\n\tswitch a { case 1: x(); default: y() }\n\treturn 2\n}"
RUBY = "class A\n  def go(x)\n    if x > 1\n      foo x\n    end\n    return 1 unless x\n    while x\n      x.each do |y|\n        baz y\n      end\n    end\n  end\n  def z\n  end\nend\n"
JAVA = "class A { A() {} int f(int a) { for (String s : xs) { g(s); } if (a > 1) return 1; else return 2; try { x(); } finally { y(); } } }"
COUNTS = [
    ("csharp", CSHARP, {"//if": 2, "//else": 2, "//return": 3, "//return[.='return y;']": 1, "//throw": 1, "//foreach": 1, "//for": 1, "//try": 1, "//catch": 1, "//finally_clause": 1, "//while[condition='a > 0']": 1, "//do_statement/condition": 1, "//switch_section": 2, "//using": 1, "//await": 1, "//ternary": 1, "//if[condition/binary[op='>']]/consequence/block/return": 1, "//if/alternative/else/if": 1, "//binary[.='a - 1 - b']": 1, "//method/body/if": 1}),
    ("typescript", SCRIPT, {"//if": 1, "//for": 1, "//return": 2, "//await": 1, "//new": 1, "//throw": 1, "//ternary[.='a ? 1 : 2']": 1, "//switch_case": 1, "//switch_default": 1, "//function//return": 1}),
    ("rust", RUST, {"//if": 1, "//else": 1, "//return": 1, "//loop": 1, "//for": 1, "//match": 1, "//arm": 3, "//while": 1, "//let": 1, "//function/body/if/condition[.='x > 1']": 1}),
    ("go", GO, {"//if": 1, "//if/alternative/block": 1, "//return": 2, "//for": 1, "//case": 1, "//default": 1, "//go": 1, "//defer": 1, "//function[.//return]": 1}),
    ("ruby", RUBY, {"//class/method": 2, "//if": 1, "//while": 1, "//method[name='go']//while": 1, "//return": 1}),
    ("java", JAVA, {"//ctor": 1, "//foreach": 1, "//if/alternative": 1, "//else": 0, "//return": 2, "//try/finally": 1}),
    ("cpp", "int f() { if (a) { return 1; } for (;;) { g(); } }", {"//if_statement": 1, "//return_statement": 1, "//for_statement": 1, "//call_expression": 1, "//compound_statement": 2}),
]


@pytest.mark.parametrize("language,text,counts", COUNTS, ids=[c[0] for c in COUNTS])
def test_statements(language, text, counts):
    doc = parse(text, language)
    assert {x: len(evaluate(x, doc)) for x in counts} == counts


@pytest.mark.parametrize("text", ["if (", "if (a", "}}} if (x) {", "switch { case", "for", "do", "else { } catch", "return", "if (a) { ( } ]", "while (x) if (y) for (z) return"])
@pytest.mark.parametrize("language", ["csharp", "typescript", "rust", "go", "ruby", "java", "c", "php"])
def test_broken_text_still_gives_a_tree(language, text):
    assert parse(text, language).children


def test_brackets():
    code = Code("a(b[c{d}])}")
    assert (code.after(1), code.after(3), code.after(5)) == (10, 9, 8) and Code("((").after(0) == 2


def test_attributes_of_any_length():
    listed = "\n".join(f'  [Rule("{k}", new[] {{ {k} }})]' for k in range(200))
    doc = parse(f"class C {{\n  [MaxLength(5)]\n{listed}\n  public string Name {{ get; set; }}\n  int[] other;\n}}", "csharp")
    assert len(evaluate("//property[attributes[contains(., 'MaxLength')][contains(., '199')]]", doc)) == 1


def test_text_of_statements_is_whole():
    doc = parse(CSHARP, "csharp")
    for n in evaluate("//if | //foreach | //for | //try | //while | //using | //return", doc):
        lines = CSHARP.split("\n")
        source = "\n".join([lines[n.line - 1][n.column - 1 :], *lines[n.line : n.end_line]]) if n.end_line > n.line else lines[n.line - 1][n.column - 1 : n.end_column - 1]
        assert n.string_value() == source


@pytest.mark.parametrize(
    "language,text,comments,names",
    [
        ("lua", "--[[ a\n function no() ]] function yes() end -- z\n", 2, ["yes"]), ("ocaml", "(* let no = \n 1 *) let yes = 2\n", 1, ["yes"]), ("haskell", "{- data No\n -}\nyes :: Int -- c\n", 2, ["yes"]),
        ("julia", "#= function no() =# function yes() end # c\n", 2, ["yes"]), ("scala", "class A { /* class No */ def f() = 1 // x\n }", 2, ["A", "f"]), ("go", "func F() { /* x */ } // y\n", 2, ["F"]),
    ],
)
def test_block_comments(language, text, comments, names):
    doc = parse(text, language)
    assert len(evaluate("//comment", doc)) == comments and [n.string_value() for n in evaluate("//name", doc)] == names
