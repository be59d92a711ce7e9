"""Query building, rendering, tree text, comments in code."""

import json

import pytest

from sylva.functions.items import data_to_xml, node_to_data, sequence_warnings
from sylva.functions.rendering import RenderError, render
from sylva.functions.text import gutter, rule_message, snippet
from sylva.functions.tree_text import marked_source, tree_text
from sylva.plans.builder import Pick, build_query
from sylva.plans.evaluate import evaluate
from sylva.sources.parsers import parse
from sylva.sources.tree import subtree_text

XML = "<class><name>Calc</name><method><name>Hello</name><returns>int</returns><parameter/><body><return/><block/></body></method></class>"


@pytest.fixture(scope="module")
def nodes():
    by: dict = {}
    for n in parse(XML, "xml").descendants():
        if n.kind == "element":
            by.setdefault(n.name, []).append(n)
    return by


@pytest.mark.parametrize(
    "picks,expected",
    [
        ([], ""), ([("method",)], "//method"), ([("class",), ("method", None, True)], "//class/method"), ([("class",), ("parameter", None, True)], "//class//parameter"), ([("method", None, True), ("parameter",)], "//method[parameter]"),
        ([("class", None, True), ("parameter",)], "//class[.//parameter]"), ([("method", "@name='d'")], "//method[@name='d']"), ([("class",), ("method",), ("return", None, True)], "//class/method//return"),
        ([("method", None, True), ("parameter",), ("body",)], "//method[parameter][body]"), ([("method", None, True), ("body",), ("return",)], "//method[body/return]"), ([("method", None, True), ("parameter",), ("return",)], "//method[parameter][.//return]"),
        ([("name", ".='Hello'", False, 1), ("body", None, True)], "//method[name[.='Hello']]/body"), ([("name", ".='Hello'", False, 1), ("block", None, True)], "//method[name[.='Hello']]//block"),
        ([("class",), ("name", ".='Hello'", False, 1), ("body", None, True)], "//class/method[name[.='Hello']]/body"),
    ],
)
def test_build_query(nodes, picks, expected):
    made = [Pick(nodes[n][rest[2] if len(rest) > 2 else 0], rest[0] if rest else None, rest[1] if len(rest) > 1 else False) for n, *rest in picks]
    query = build_query(made)
    assert query == expected
    if query and "@" not in query:
        assert evaluate(query, parse(XML, "xml"))


def test_tree_text():
    assert tree_text(parse(XML, "xml")) == 'class/\n  ├─ name = "Calc"\n  └─ method[parameter]/\n      ├─ name = "Hello"\n      ├─ returns = "int"\n      └─ body[return and block]'


def test_rendering():
    assert json.loads(render('<document><a kind="number">1</a><t>x</t><t>y</t></document>', "xml", "json")) == {"a": 1, "t": ["x", "y"]}
    assert render('{"$type": "document", "a": "1"}', "json", "yaml") == "a: '1'\n"
    assert "public class A\n{\n    public int X { get; set; }\n}" in render("<unit><class><public/><name>A</name><body><property><public/><type>int</type><name>X</name></property></body></class></unit>", "xml", "csharp")
    with pytest.raises(RenderError):
        render("<a/>", "xml", "rust")


def test_data_trees():
    doc = parse('{"a": {"b": "x", "c": {}}, "d": [1, 2]}', "json")
    a = evaluate("//a", doc)[0]
    assert node_to_data(a) == {"c": True, "b": "x"}
    assert node_to_data(doc) == {"$type": "document", "a": {"c": True, "b": "x"}, "d": ["1", "2"]}
    assert subtree_text(data_to_xml({"$type": "m", "public": True, "name": "N", "children": [{"k": "v"}]})) == "<m><public/><name>N</name><k>v</k></m>"


def test_warnings():
    m = evaluate("map { 'm': (1, 2), 'n': 1 }", parse("<a/>", "xml"))[0]
    assert len(sequence_warnings(m)) == 1 and '"m"' in sequence_warnings(m)[0]


def test_code_trees():
    text = "using System;\n// a\n// b\nclass C {\n  int x = 1; // c\n  [Max(5)]\n  public List<Dictionary<string, User?>> All(int a) { return a + b; }\n}\n"
    doc = parse(text, "csharp")
    count = lambda x: len(evaluate(x, doc))
    assert count("//comment") == 2 and count("//comment[leading][contains(., '// b')]") == 1 and count("//comment[trailing]") == 1
    assert count("//type[generic]/arguments/type[.='string']") == 1 and count("//type[.='List<Dictionary<string, User?>>']") == 1 and count("//type[nullable]") == 1
    assert count("//binary[op='+']/op/plus") == 1 and count("//import[name='System']") == 1 and count("//method[attributes]") == 1


def test_text_helpers():
    assert snippet(["héllo wörld"], 1, 8, 1, 14, None) == "wörld"
    assert snippet(["a", "b"], 5, 1, 5, 2, "v") == "v"
    assert rule_message("{value}|{line}|{nope}", "a\n  b" + "x" * 60, 3, 4, "f").startswith("a b" + "x" * 44 + "...|3|{nope}")
    assert gutter([str(k) for k in range(9)], 1, 1, 2).count("\n") == 4
    assert marked_source("abc\ndéf", [(1, 2, 1, 3), (2, 2, 2, 4)]) == "a»b«c\nd»é«f"


def test_playground():
    from sylva.functions import playground as p

    assert p.to_xml('{"a": [1, 2]}', "json", indent=None) == "<document><a>1</a><a>2</a></document>"
    assert p.validated("//a[b]") == {"valid": True} and p.validated("//a[")["valid"] is False and p.validated(" ")["valid"] is False
    assert p.found('{"port": 80}', "json", "port") == [{"type": "node", "value": "80", "line": 1, "column": 10, "end_line": 1, "end_column": 12, "source": "80"}]
    assert p.schema('{"a": {"b": 1}, "c": [1, 2]}', "json") == {"document": 1, "document/a": 1, "document/a/b": 1, "document/c": 2}
    assert "\x1b[" in p.coloured("return 1", "python")
