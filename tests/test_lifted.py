import json
import random

import pytest
from pyspark.sql import functions as F

from sylva.operators.matching import run_rules
from sylva.operators.rules import Rule
from sylva.plans import lifted, relational
from sylva.plans.evaluate import evaluate
from sylva.sources.documents import from_table
from sylva.sources.nodes import node_table
from sylva.sources.parsers import parse
from sylva.sources.shred import typed_nodes


def document(rng, k):
    line = lambda: {"n": rng.randrange(5), "quantity": rng.choice([1, 2, 2.5, 30]), "flag": rng.choice("RAN"), **({"part": {"name": rng.choice(["bolt", "nut", ""]), "size": rng.randrange(3)}} if rng.random() < 0.6 else {})}
    out = {"key": k, "line": [line() for _ in range(rng.choice([0, 1, 2, 4, 6]))]}
    if rng.random() < 0.5:
        out["note"] = {"line": {"n": 9, "flag": "R", "quantity": 2}, "text": " a  b "}
    return json.dumps(out)


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, document(rng, k)) for k in range(40)], "k long, t string")
    return from_table(df, "t", F.concat(F.lit("d/"), F.col("k").cast("string")), "json", "k").cache()


@pytest.fixture(scope="module")
def nodes(sources):
    return node_table(sources).cache()


def lifted_values(nodes, xpath):
    out = {}
    for r in lifted.rows(nodes, xpath, normalize=False).orderBy("doc_id", "item_order").collect():
        out.setdefault(r["doc_id"], []).append(r["value"])
    return out


def interpreted(sources, xpath):
    out = {}
    for r in run_rules(sources, [Rule(xpath, normalize=False)], quoted=False).orderBy("doc_id", "item_index").collect():
        out.setdefault(r["doc_id"], []).append(r["value"])
    return out


EXPRESSIONS = [
    # for, let, return
    "for $l in //line return $l/n", "for $l in //line, $q in $l/quantity return concat($l/n, ':', $q)", "for $l in //line return for $m in //line[n = $l/n] return concat($l/n, '-', $m/flag)",
    "let $s := sum(//quantity) return $s * 2", "let $r := //line[flag = 'R'] return count($r)", "let $r := //line[flag = 'R'] return for $l in $r return $l/n + count($r)", "for $l in //line let $p := $l/part return concat($p/name, '/', string-length($p/name))",
    "for $n in //line/n return for $k in (1 to 2) return $n * $k", "for $k in (3, 1, 2) return $k + 1", "for $l in //line return if ($l/flag = 'R') then $l/n else 'no'", "for $l in //line return if ($l/n > 2) then $l/quantity else ()",
    "for $l in //line return count($l/part/*)", "for $a in //line/flag, $b in ('x', 'y') return $a || $b", "(for $l in //line return $l/n)[2]", "for $l in //line return sum(($l/n, $l/quantity))",
    # maps over context, paths that end in values
    "//line ! n", "//line/string(n)", "//line ! (n, quantity)", "//line/(n + 1)", "//line/part/name/string-length()", "//n ! (. * 2)", "//line[n > 1]/$file", "//line/name()", "//part/../n", "//line ! (if (part) then part/name else 'none')", "//line/(n | quantity)", "//line/(if (part) then part/name else n)",
    # variables in predicates
    "let $m := max(//n) return //line[n = $m]/flag", "for $l in //line return count(//line[quantity = $l/quantity])", "for $l in //line return //line[n < $l/n]/n", "//line[quantity = //line[flag = 'R']/quantity]/n",
    "//line[not(quantity = //line[flag = 'R']/quantity)]/n", "//line[quantity != //line[flag = 'R']/quantity]/n", "//line[quantity > //line[flag = 'R']/n]/n", "//line[n <= //part/size]/n", "//line[some $q in quantity satisfies $q > 1]/n", "//line[every $q in (n, quantity) satisfies $q > 1]/n",
    "count(//line[quantity = //line[flag = 'R']/quantity])", "//line[n = (1, 3)]/n", "//line[(n, quantity) = 2]/flag", "//line[part[size = 1] or flag = 'R']/n", "//line[exists(part) and not(flag = 'R')]/n", "//line[empty(part)]/n",
    # quantifiers and comparisons
    "some $l in //line satisfies $l/n = 3", "every $l in //line satisfies $l/n >= 0", "some $a in //line, $b in //note/line satisfies $a/flag = $b/flag", "//n = //size", "//n < //size", "//n != //size", "//flag = 'R'", "//quantity >= 30", "count(//line) = 2", "count(//line) gt 2 and exists(//note)",
    # functions over sequences
    "string-join(sort(distinct-values(//flag)), ',')", "distinct-values(//quantity)", "sort(//flag)", "reverse(//n)", "head(//n)", "tail(//n)", "subsequence(//n, 2, 2)", "avg(//quantity)", "min(//n)", "max(//quantity)", "string-join(//line/flag, '')",
    "string-join(for $l in //line return concat($l/n, $l/flag), ' ')", "for-each(//n, function($x) { $x + 1 })", "filter(//n, function($x) { $x > 1 })", "tokenize(string(//text), ' +')", "//line[1]/n", "//line[last()]/n", "(//line)[last()]/n", "(//line)[position() > 1]/n", "//line[flag = 'R']/following-sibling::line[1]/n",
    "//n | //size", "//line/n intersect //n", "//n except //note//n", "(//flag, 'z', //note/line/flag)", "1 to 3", "()", "//line/ancestor::note/text",
    # values
    "normalize-space(//text)", "upper-case(//note/line/flag)", "substring(//text, 2, 2)", "contains(//text, 'b')", "starts-with(//key, '1')", "string(//key) || 'x'", "number(//key) + 1", "//key idiv 7", "//key mod 7", "//key div 4", "-//key", "round(//key div 4)", "abs(-3)",
    "string(//key) instance of xs:string", "//line instance of element()*", "//key instance of xs:integer", "xs:integer(//key) + 1", "xs:integer(//key) gt 20", "string(//text) castable as xs:integer", "xs:string(//key)", "if (//key > 20) then 'high' else 'low'", "not(//note)", "true()", "boolean(//note)",
    # what is an error for some documents
    "string(//line/n)", "xs:integer(//note/line/flag)", "for $l in //line return string($l/part/name)", "//key + //line/n", "concat(//line/flag, 'x')", "1 idiv //key",
]


@pytest.mark.parametrize("xpath", EXPRESSIONS)
def test_equals_the_interpreter(sources, nodes, xpath):
    assert lifted_values(nodes, xpath) == interpreted(sources, xpath)


BUILT = [
    "map { 'a': 1, 'b': 'x \"y\" \\\\ z', 'c': true(), 'd': 2.5 }", "array { for $n in //line/n return $n * 10 }", "//line ! map { 'n': number(n), 'flag': string(flag) }", "map { 'lines': array { //line ! map { 'n': string(n) } }, 'n': count(//line), 'key': string(//key) }",
    "map { 'tags': //line/flag, 'one': //key, 'none': //nothing, 'inner': map { 'x': //size } }", "[1, 'a', //key]", "[//line/n, (), map { 'a': array { } }]", "for $l in //line return map { 'flag': $l/flag, 'sizes': array { $l/part/size }, 'quantity': $l/quantity * 2 }", "map { concat('k', //key): 1 }", "map { }", "//line[part] ! [n, part/name]",
]


@pytest.mark.parametrize("xpath", BUILT)
def test_maps_and_arrays_equal_the_interpreter(sources, nodes, xpath):
    def trees(found, order):
        out = {}
        for r in found.orderBy("doc_id", order).collect():
            out.setdefault(r["doc_id"], []).append((r["item_type"], r["value"], r["tree"]))
        return out

    assert trees(lifted.rows(nodes, xpath, normalize=False), "item_order") == trees(run_rules(sources, [Rule(xpath, normalize=False)], fields=["tree"]), "item_index")


@pytest.mark.parametrize("xpath", ["map { 'a': 1 } = 1", "$unknown", "//line[$nothing = 1]", "fold-left(//n, 0, function($a, $x) { $a + $x })", "sort(//n, (), function($x) { -$x })", "'a' + 1", "(1, 'a')", "//line/@*", "//line/(n, 'x')", "array { 1 } + 1", "string(map { })", "(1, map { })"])
def test_what_has_no_plan_says_so(nodes, xpath):
    with pytest.raises(relational.Unsupported):
        lifted.rows(nodes, xpath, normalize=False)


def test_plans_have_no_python(spark, sources):
    df = spark.createDataFrame([(1, [(1, "a"), (2, "b")])], "k long, line array<struct<n:int,flag:string>>")
    for xpath in ("for $l in //line return concat($l/n, $l/flag)", "//line[n = //line[flag = 'a']/n]/n"):
        plan = lifted.rows(typed_nodes(df, "k"), xpath)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_independent_parts_are_found_once(nodes):
    """The returned lines of a document do not depend on the line that is compared: one semi join, no pairs of lines."""
    work = lifted.Lifted(nodes)
    s = work.items(lifted.parse("//line[quantity = //line[flag = 'R']/quantity]"), work.top)
    plan = s.df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and s.scope is work.top


def test_columns(spark, sources, nodes):
    found = {r["doc_id"]: r for r in lifted.columns(nodes, n="count(//line)", total="string(sum(//quantity))", name="string(//line/n)").collect()}
    for r in sources.collect():
        tree = parse(r["content"], "json")
        n = evaluate("count(//line)", tree)[0]
        row = found[r["doc_id"]]
        assert row["n"] == n and float(row["total"]) == evaluate("sum(//quantity)", tree)[0]
        assert row["name"] == (None if n > 1 else evaluate("string(//line/n)", tree)[0])


TYPED = "k long, key int, line array<struct<n:int, tags:array<string>, part:struct<name:string, size:double>>>, deep array<array<int>>, s struct<a:string, b:array<struct<c:int>>>, none string, flag boolean"


def typed_rows(rng):
    part = lambda: None if rng.random() < 0.3 else (rng.choice(["x", "", None]), 1.5)
    line = lambda: (rng.choice([None, 3]), rng.choice([None, [], ["p"], ["p", "", "q"]]), part())
    return [(k, k, rng.choice([None, [], [line() for _ in range(rng.randrange(4))]]), rng.choice([None, [[1], [2, 3]]]), rng.choice([None, ("a", [(1,), (2,)]), (None, None)]), None, rng.choice([True, False])) for k in range(60)]


def as_data(x):
    if hasattr(x, "asDict"):
        return {k: as_data(v) for k, v in x.asDict().items() if v is not None}
    return [as_data(v) for v in x] if isinstance(x, list) else x


def test_typed_rows_become_the_tree_of_their_json(spark):
    df = spark.createDataFrame(typed_rows(random.Random(1)), TYPED)
    got = {}
    for r in typed_nodes(df, "k").orderBy("doc_id", "pre").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for row in df.collect():
        data = as_data(row)
        own = got[data.pop("k")]
        tree = parse(json.dumps(data), "json")
        want = [tree, *tree.descendants()]
        place = {r["pre"]: k for k, r in enumerate(own)}
        assert [(r["kind"], r["name"], r["text"], r["depth"]) for r in own] == [(n.kind, n.name, n.text, n.depth) for n in want]
        assert [None if r["parent"] is None else place[r["parent"]] for r in own] == [None if n.parent is None else n.parent.pre for n in want]
        assert [sum(r["pre"] < o["pre"] <= r["post"] for o in own) for r in own] == [n.post - n.pre for n in want]
        assert [r["ord"] for r in own if r["kind"] == "element"] == [n.ord for n in want if n.kind == "element"]
        assert [r["string_value"] for r in own if r["string_value"] is not None] == [n.string_value() for n in want if n.kind == "text" or n.kind == "element" and n.depth > 1 and all(c.kind == "text" for c in n.children) and not (n.name in ("line", "part", "s", "b") and not n.children)]
