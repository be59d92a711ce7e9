"""Registered queries over texts of programming and data languages, and their SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpora import table
from .operators.matching import run_rules
from .operators.rules import Rule
from .registry import query
from .sources.documents import from_table


def _sources(spark, sf_dir: str, name: str, key: str, text: Column, path: str) -> DataFrame:
    return from_table(table(spark, sf_dir, name), text, F.lit(path), None, key)


def _values(sources: DataFrame, expressions: Sequence[tuple[str, str]], **options) -> DataFrame:
    """doc_id and one column for each expression: its value, a number where it counts."""
    found = run_rules(sources, [Rule(x, normalize=False) for _, x in expressions], quoted=False, **options)
    pick = lambda k: F.max(F.when(F.col("rule_index") == k, F.col("value")))
    columns = [(pick(k).cast("bigint") if x.startswith("count(") else pick(k)).alias(name) for k, (name, x) in enumerate(expressions)]
    return found.groupBy("doc_id").agg(*columns)


def _lines(*rows: str) -> str:
    return "\n".join(rows) + "\n"


_CSHARP = _lines(
    "class C {", "  public int M(int a) {", "    if (a > %d) { return a; } else { throw new E(); }", "    foreach (var x in xs) { Use(x); }", "    while (a < 3) { a = a + 1; }",
    "    try { Go(); } catch (E e) { Log(e); }", "    return a > 1 ? 2 : 3;", "  }", "}",
)


@query("""SELECT s_suppkey AS doc_id, 1 AS ifs, 'a > ' || s_nationkey AS condition, 2 AS returns, 1 AS loops, 'while (a < 3) { a = a + 1; }' AS while_text, 1 AS catches, 'a > 1 ? 2 : 3' AS choice FROM supplier""")
def code_statements_csharp(spark, sf_dir):
    src = _sources(spark, sf_dir, "supplier", "s_suppkey", F.format_string(_CSHARP, "s_nationkey"), "c.cs")
    return _values(src, [("ifs", "count(//method/body/if)"), ("condition", "string(//if/condition)"), ("returns", "count(//return)"), ("loops", "count(//foreach/body/block/call)"), ("while_text", "string(//while)"), ("catches", "count(//try/catch/body//call)"), ("choice", "string(//return/ternary)")])


@query("""SELECT s_suppkey AS doc_id, 2 AS required, 1 AS optional, 1 AS constants, 'f' || s_suppkey AS called, 1 AS awaits, 2 AS cases, 1 AS lambdas, 'T' AS alias FROM supplier""")
def code_statements_typescript(spark, sf_dir):
    text = _lines("type T = string;", "async function go(a: number, b: T, c?: string) {", "  const r = await f%d(a)", "  switch (r) { case 1: stop(); break; case 2: run() }", "  return [1].map(x => x);", "}")
    src = _sources(spark, sf_dir, "supplier", "s_suppkey", F.format_string(text, "s_suppkey"), "c.ts")
    return _values(src, [("required", "count(//param[required])"), ("optional", "count(//param[optional])"), ("constants", "count(//variable[const])"), ("called", "string(//await/call/function[ref])"), ("awaits", "count(//await)"), ("cases", "count(//switch_statement//switch_case)"), ("lambdas", "count(//lambda)"), ("alias", "string(//typealias/name)")])


@query("""SELECT s_suppkey AS doc_id, 1 AS public, 1 AS crate, 1 AS private, 3 AS arms, 'x > ' || s_nationkey AS condition, 1 AS loops, 1 AS macros, 'y' AS bound FROM supplier""")
def code_statements_rust(spark, sf_dir):
    text = _lines("pub fn a(x: i32) -> i32 {", "    if x > %d { return x; }", "    let y = match x { 1 => 2, n if n > 3 => { b(n) } _ => 0, };", "    loop { break; }", "}", "pub(crate) fn b() { say!(1); }", "fn c() {}")
    src = _sources(spark, sf_dir, "supplier", "s_suppkey", F.format_string(text, "s_nationkey"), "c.rs")
    return _values(src, [("public", "count(//function[pub[not(*)]])"), ("crate", "count(//function[pub[crate]])"), ("private", "count(//function[private])"), ("arms", "count(//match//arm)"), ("condition", "string(//if/condition)"), ("loops", "count(//loop)"), ("macros", "count(//macro)"), ("bound", "string(//let/name)")])


@query("""SELECT s_suppkey AS doc_id, 1 AS exported, 1 AS unexported, 'F' || s_suppkey AS name, 1 AS fors, 2 AS branches, 1 AS defers, 'p' AS package FROM supplier""")
def code_statements_go(spark, sf_dir):
    text = _lines("package p", "func F%d(a int) int {", "\tfor i := 0; i < 3; i++ { use(i) }", "\tswitch a { case 1: x(); default: y() }", "\tdefer h()", "\treturn 2", "}", "func g() {}")
    src = _sources(spark, sf_dir, "supplier", "s_suppkey", F.format_string(text, "s_suppkey"), "c.go")
    return _values(src, [("exported", "count(//function[exported])"), ("unexported", "count(//function[unexported])"), ("name", "string(//function[exported]/name)"), ("fors", "count(//for[body//call])"), ("branches", "count(//switch//(case | default))"), ("defers", "count(//defer)"), ("package", "string(//package/name)")])


@query("""SELECT s_suppkey AS doc_id, 'A' || s_suppkey AS name, 1 AS ctors, 1 AS hidden, 1 AS loops, 2 AS returns, 1 AS cleanups FROM supplier""")
def code_statements_java(spark, sf_dir):
    text = _lines("public class A%d {", "  A%d() { }", "  int f(int a) {", "    for (String s : xs) { g(s); }", "    try { g(); } finally { h(); }", "    if (a > 1) return 1; else return 2;", "  }", "}")
    src = _sources(spark, sf_dir, "supplier", "s_suppkey", F.format_string(text, "s_suppkey", "s_suppkey"), "c.java")
    return _values(src, [("name", "string(//class[public]/name)"), ("ctors", "count(//ctor)"), ("hidden", "count(//method[package-private])"), ("loops", "count(//foreach)"), ("returns", "count(//if//return)"), ("cleanups", "count(//try/finally)")])


@query("""SELECT s_suppkey AS doc_id, 'm' || s_suppkey AS name, 1 AS ifs, 1 AS whiles, 2 AS methods FROM supplier""")
def code_statements_ruby(spark, sf_dir):
    text = _lines("class A", "  def m%d(x)", "    if x > 1", "      puts x", "    end", "    while x", "      x = nil", "    end", "  end", "  def z", "  end", "end")
    src = _sources(spark, sf_dir, "supplier", "s_suppkey", F.format_string(text, "s_suppkey"), "c.rb")
    return _values(src, [("name", "string(//class/method[if]/name | //class//method[.//if]/name)"), ("ifs", "count(//if)"), ("whiles", "count(//while)"), ("methods", "count(//class//method)")])


@query("""SELECT s_suppkey AS doc_id, 'f' || s_suppkey AS name, 1 AS ifs, 1 AS returns, 1 AS calls FROM supplier""")
def code_raw_names_cpp(spark, sf_dir):
    src = _sources(spark, sf_dir, "supplier", "s_suppkey", F.format_string("int f%d(int a) { if (a) { return 1; } g(a); }\n", "s_suppkey"), "c.cpp")
    return _values(src, [("name", "string(//function_definition/name)"), ("ifs", "count(//if_statement)"), ("returns", "count(//return_statement)"), ("calls", "count(//call_expression)")])


@query("""SELECT n_nationkey AS doc_id, 't' || n_nationkey AS source, CAST(n_regionkey AS VARCHAR) AS bound, 1 AS joins, 1 AS groups, 'n' AS alias FROM nation""")
def tsql_statements(spark, sf_dir):
    text = "SELECT a, COUNT(*) AS n FROM t%d JOIN u ON t%d.i = u.i WHERE x > %d GROUP BY a\n"
    src = _sources(spark, sf_dir, "nation", "n_nationkey", F.format_string(text, "n_nationkey", "n_nationkey", "n_regionkey"), "q.sql")
    return _values(src, [("source", "string((//from//name)[1])"), ("bound", "string(//where/compare[op/compare/greater]/literal)"), ("joins", "count(//join)"), ("groups", "count(//group_by)"), ("alias", "string((//alias)[1])")])


@query("""SELECT n_nationkey AS doc_id, n_name AS text, 2 AS properties, 1 AS numbers FROM nation""")
def json_structure(spark, sf_dir):
    src = _sources(spark, sf_dir, "nation", "n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))), "n.json")
    return _values(src, [("text", "string(//property[key/string='name']/value/string)"), ("properties", "count(//property)"), ("numbers", "count(//property/value/number)")], mode="structure")


@query("""SELECT n_nationkey AS doc_id, n_name AS text, 2 AS properties FROM nation""")
def yaml_structure(spark, sf_dir):
    src = _sources(spark, sf_dir, "nation", "n_nationkey", F.format_string("name: %s\nregion: %d\n", "n_name", "n_regionkey"), "n.yaml")
    return _values(src, [("text", "string(//property[key/string='name']/value/string)"), ("properties", "count(//property)")], mode="structure")


@query("""SELECT n_nationkey AS doc_id, n_name AS by_name, 'first name' AS key, n_name AS by_key FROM nation""")
def sanitized_names(spark, sf_dir):
    src = _sources(spark, sf_dir, "nation", "n_nationkey", F.format_string('{"first name": "%s", "1x": 2}', "n_name"), "n.json")
    return _values(src, [("by_name", "string(//first_name)"), ("key", "string(//first_name/@key)"), ("by_key", "string(//*[@key='first name'])")])


@query("""SELECT n_nationkey AS doc_id, CAST(n_regionkey + 1 AS BIGINT) AS items, 'v' || n_regionkey AS last_one FROM nation""")
def json_sequences(spark, sf_dir):
    """An array under a key is the key repeated."""
    values = F.transform(F.sequence(F.lit(0), F.col("n_regionkey").cast("int")), lambda k: F.concat(F.lit("v"), k.cast("string")))
    src = _sources(spark, sf_dir, "nation", "n_nationkey", F.to_json(F.struct(values.alias("tags"))), "n.json")
    return _values(src, [("items", "count(//tags)"), ("last_one", "string(//tags[last()])")])


@query("""SELECT n_nationkey AS doc_id, n_name || chr(9) || 'é' || chr(10) || '"x"' AS json, n_name || chr(10) || 'it''s' AS yaml FROM nation""")
def escapes_and_block_scalars(spark, sf_dir):
    text = F.format_string('{"a": "%s\\t\\u00e9\\n\\"x\\""}', "n_name")
    json = _values(_sources(spark, sf_dir, "nation", "n_nationkey", text, "n.json"), [("json", "string(//a)")])
    yaml = _values(_sources(spark, sf_dir, "nation", "n_nationkey", F.format_string("a: |-\n    %s\n    it's\nb: 'it''s'\n", "n_name"), "n.yaml"), [("yaml", "string(//a)")])
    return json.join(yaml, "doc_id")


@query("""SELECT n_nationkey AS doc_id, 1 AS shallow, 3 AS deep, replace(n_name, ' ', '') AS tight FROM nation""")
def parse_depth_and_whitespace(spark, sf_dir):
    src = _sources(spark, sf_dir, "nation", "n_nationkey", F.format_string("<a><b> %s <c><d/></c></b></a>", "n_name"), "n.xml")
    cut = _values(src, [("shallow", "count(//a//*)")], parse_depth=2)
    full = _values(src, [("deep", "count(//a//*)")])
    tight = _values(src, [("tight", "string(//b)")], ignore_whitespace=True)
    return cut.join(full, "doc_id").join(tight, "doc_id")


@query("""SELECT n_nationkey AS doc_id, 'K' || n_nationkey AS name, 'int' AS lifted, true AS flag FROM nation""")
def lifted_fields(spark, sf_dir):
    """Fields of an element become properties of its data, empty markers flags."""
    src = _sources(spark, sf_dir, "nation", "n_nationkey", F.format_string("class C { public static int K%d(int a) { } }\n", "n_nationkey"), "c.cs")
    tree = run_rules(src, [Rule("//method")], fields=("tree",))
    return tree.select("doc_id", F.get_json_object("tree", "$.name").alias("name"), F.coalesce(F.get_json_object("tree", "$.returns.type"), F.get_json_object("tree", "$.returns")).alias("lifted"), (F.get_json_object("tree", "$.static") == "true").alias("flag"))


@query("""SELECT n_nationkey AS doc_id, n_name AS value FROM nation""")
def registered_parser(spark, sf_dir):
    """A parser of a further language, plugged in by register: pairs parted by pipes."""
    from .sources import parsers
    from .sources.tree import Node, document

    def pairs(text: str) -> Node:
        root = Node("element", "pairs").at((1, 1, 1, len(text.encode()) + 1))
        for piece in text.split("|"):
            key, _, value = piece.partition("=")
            root.element(key).add_text(value)
        return document(root)

    parsers.register("text", "raw", pairs)
    src = from_table(table(spark, sf_dir, "nation"), F.format_string("k=%d|name=%s", "n_nationkey", "n_name"), F.lit("n.txt"), "text", "n_nationkey")
    return _values(src, [("value", "string(//pairs/name)")], mode="raw")
