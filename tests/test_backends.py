"""The relational and typed backends agree with the interpreter; node tables keep their invariants."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sylva.plans import relational, typed
from sylva.plans.evaluate import evaluate, string_of
from sylva.plans.xpath import normalized
from sylva.sources.documents import inline
from sylva.sources.nodes import node_table
from sylva.sources.parsers import parse
from sylva.sources.tree import Node

HTML = [
    "<body><nav><ul><li><a href='/1'>one</a><li>two<li class='x'><b>three</b></ul></nav><p>a<p>b <i>c</i></p><!-- n --><div><p>d</p></div></body>",
    "<p>7</p><p>12</p><div id='q'><p>30</p><span/></div>",
    "",
]
PATHS = [
    "//li", "//li/a", "//nav//li", "//li[1]", "//li[last()]", "//li[position() < 3]", "//p[.='b c']", "//p[i]", "//p[not(i)]", "//*[p]", "//ul/li[2]/following-sibling::li", "//b/ancestor::nav", "//b/..", "//li[a or b]",
    "//li[a and not(b)]", "//div[count(p) = 1]", "//div[count(.//p) > 0]", "//div[count(zz) = 0]", "//p[. > 10]", "//p[contains(., 'c')]", "//li[starts-with(., 't')]", "//a[@href='/1']", "//li[@class]", "//div[@id='q']/p",
    "//p | //li", "//p intersect //div/p", "//p except //div/p", "//comment()", "//li/text()", "/", "//li/preceding-sibling::li", "//ul/descendant::b", "//i/preceding::p", "//a/following::p", "//*[self::b or self::i]", "//li[b]/b", "//nav[ul/li/a]", "//p[string-length(.) > 1]",
]


@pytest.fixture(scope="module")
def nodes(spark):
    return node_table(inline(spark, [(f"{k}.html", "html", t) for k, t in enumerate(HTML)])).cache()


@pytest.mark.parametrize("xpath", PATHS)
def test_relational_equals_interpreter(nodes, xpath):
    got = sorted((r["doc_id"], r["pre"]) for r in relational.plan(nodes, xpath).select("doc_id", "pre").collect())
    want = sorted((k, n.pre) for k, t in enumerate(HTML) for n in evaluate(normalized(xpath), parse(t, "html")))
    assert got == want


@pytest.mark.parametrize("xpath", ["//a/@href", "//li/string()", "count(//p)", "sum(//div/p)"])
def test_relational_values(nodes, xpath):
    number = lambda v: float(v) if isinstance(v, (int, float)) else string_of(v)
    got = sorted((r["doc_id"], number(r["value"])) for r in relational.plan(nodes.where("doc_id != 0") if "sum" in xpath else nodes, xpath).collect())
    want = sorted((k, number(v)) for k, t in enumerate(HTML) for v in evaluate(normalized(xpath), parse(t, "html")) if not ("sum" in xpath and k == 0))
    assert got == want


def test_relational_refuses_what_it_cannot_plan(nodes):
    for xpath in ("for $x in //a return $x", "map { 'a': 1 }", "//a[b = //c]"):
        with pytest.raises(relational.Unsupported):
            relational.plan(nodes, xpath)


ROWS = [
    (1, "ann", [(1, "O", 10.5), (2, "F", 99.0), (3, "O", 7.0)]),
    (2, "bob", []),
    (3, None, [(9, "P", 1.0)]),
]
TYPED = [
    "count(order)", "order[status='O']/key", "order[2]/key", "order[last()]/key", "sum(order/key)", "max(order/key)", "some $o in order satisfies $o/key > 2", "every $o in order satisfies $o/key > 1",
    "string-join(order/status, ',')", "distinct-values(order/status)", "for $o in order return $o/key * 2", "if (order) then 'y' else 'n'", "not(order)", "exists(order[key = 9])", "order[key > 1 and status = 'O']/key",
    "count(order[total > 8])", "concat(name, '!')", "upper-case(name)", "let $n := count(order) return $n + 1", "order/key ! (. + 1)", "reverse(order/key)", "(order/key)[1]", "contains(string-join(order/status, ''), 'F')",
]


@pytest.mark.parametrize("xpath", TYPED)
def test_typed_equals_interpreter(spark, xpath):
    """A typed plan gives what the expression gives over the JSON of the row."""
    schema = "id int, name string, order array<struct<key:int,status:string,total:double>>"
    df = spark.createDataFrame(ROWS, schema).where("name is not null")
    got = {r["id"]: r["v"] for r in df.select("id", typed.column(df, xpath).alias("v")).collect()}

    def plain(v):
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if isinstance(v, bool) else (float(v) if v.replace(".", "").isdigit() else v)

    for r in df.select("id", F.to_json(F.struct(*df.columns)).alias("j")).collect():
        doc = parse(r["j"], "json")
        root = next(c for c in doc.children)
        from sylva.plans.evaluate import Context, compiled

        want = [plain(string_of(x) if isinstance(x, (Node, str)) else x) for x in compiled(xpath)(Context(root))]
        own = got[r["id"]]
        own = [] if own is None else [plain(x) for x in own] if isinstance(own, list) else [plain(own)]
        assert own == want, r["j"]


def test_typed_filter_reaches_the_scan(spark, tiny):
    df = spark.read.parquet(f"{tiny}/orders.parquet")
    plan = df.where(typed.condition(df, "o_totalprice > 400000")).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_root_descendant_is_a_filter(spark, nodes):
    plan = relational.plan(nodes, "//li")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


json_values = st.recursive(st.none() | st.booleans() | st.integers(-999, 999) | st.text("ab <&\"'é\n", max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("xyz ", min_size=1, max_size=3), c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(json_values)
def test_tree_invariants(value):
    doc = parse(json.dumps(value), "json")
    every = [doc, *doc.descendants()]
    assert [n.pre for n in every] == list(range(len(every)))
    for n in every:
        inside = list(n.descendants())
        assert n.post == (inside[-1].pre if inside else n.pre)
        assert [c.ord for c in n.children] == list(range(len(n.children)))
        assert all(c.parent is n and c.depth == n.depth + 1 for c in n.children)
        if n.kind == "element":
            assert n.string_value() == "".join(d.text for d in inside if d.kind == "text")


LINE_RULES = [
    "//line", "//line[contains(., 'ab')]", "/document/line[starts-with(., 'a')]", "//line[string-length(.) < 3 and . != '']", "//line[not(contains(., 'é'))]", "//line[. = 'x' or ends-with(., 'b')]", "//line[lower-case(.) = 'ab']",
    "//line[contains(., 'zz')]", "//line[2]", "//line[. > 3]", "//line[true()][string-length(normalize-space(.)) >= 2]",
]


def test_line_rules_equal_the_interpreter(spark):
    from sylva.operators.matching import SCHEMA, run_rules
    from sylva.operators.rules import Rule
    from sylva.plans import lines

    texts = ["ab\nAB\n\nx é\r\nabb\r", "", "\n\n", "x", "a" * 500 + "\nb 12\n5\n", "tail\r\n"]
    sources = inline(spark, [(f"d/{k}.txt", "text", t) for k, t in enumerate(texts)] + [("j.json", "json", '{"line": "ab"}')])
    rules = [Rule(x, f"r{k}", severity="warning", message="{file}:{line} {value}" if k % 2 else None, include=("d/*",) if k == 1 else ()) for k, x in enumerate(LINE_RULES)]
    assert [lines.predicates(r.expression) is not None for r in rules] == [x not in ("//line[2]", "//line[. > 3]") for x in LINE_RULES]
    names = [c.split()[0].strip("`") for c in SCHEMA.split(", ")]
    for command in ("query", "check"):
        got = run_rules(sources, rules, command, ("source", "lines"))
        want = run_rules(sources, rules, command, ("source", "lines"), parse_depth=9)
        assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, map(tuple, want.select(names).collect())))


def test_line_rules_stay_out_of_python(spark, tiny):
    from sylva.corpora import documents_text
    from sylva.operators.matching import run_rules
    from sylva.operators.rules import Rule

    found = run_rules(documents_text(spark, tiny), [Rule("//line[contains(., 'password')]"), Rule("//line[string-length(.) > 9]")], "check")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_places_of_line_matches_are_not_computed_unless_asked_for(spark):
    from sylva.operators.matching import run_rules
    from sylva.operators.rules import Rule
    from sylva.sources.documents import from_table

    df = spark.createDataFrame([(k, f"a {k}\nb\na b\n") for k in range(4)], "k long, t string")
    src = from_table(df, "t", F.lit("x.txt"), "text", "k")
    found = run_rules(src, [Rule("//line[contains(., 'a')]", id="a"), Rule("//line[contains(., 'b')]", id="b")])
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan(found) and "Window" not in plan(found.groupBy("rule_id").count()) and "Python" not in plan(found)
    assert sorted((r["rule_id"], r["line"], r["item_index"]) for r in found.where("doc_id = 1").collect()) == [("a", 1, 0), ("a", 3, 1), ("b", 2, 0), ("b", 3, 1)]
