import json

import pytest
from pyspark.sql import functions as F

from sylva.operators.engine import Engine, git_changes
from sylva.operators.mutation import Mapping, MutationError, apply_mapping, declared, spliced
from sylva.operators.reports import grouped, schema_paths, schema_text
from sylva.operators.rules import Rule
from sylva.operators.sinks import Report, ViewError, view
from sylva.sources.documents import from_table, inline
from sylva.sources.nodes import node_table


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(inline(spark, [("a.json", "json", '{\n  "host": "x",\n  "port": 80\n}'), ("b.json", "json", '{"port": 8080, "tags": ["q", "r"]}'), ("c.yaml", "yaml", "port: 80\nname: n\n"), ("bad.json", "json", "{")]))


def test_query(engine):
    report = engine.query("//port", fields="file,line,value")
    rows = [(r["file"], r["line"], r["column"], r["value"]) for r in report.matches.collect()]
    assert rows == [("a.json", 3, 11, "80"), ("b.json", 1, 10, "8080"), ("c.yaml", 1, 7, "80")]
    assert report.summary()["success"] is None
    assert engine.query("//port", limit=2).matches.count() == 2
    assert [r["rule_index"] for r in engine.query(["//host", "//tags"]).matches.collect()] == [0, 1, 1]


def test_query_echo_and_projections(engine):
    report = engine.query("port", fields="value")
    assert report.summary()["query"] == "//port"
    assert report.project("count") == 3
    assert [r["value"] for r in report.project("value", single=True).collect()] == ["80"]
    with pytest.raises(ViewError):
        report.project("count", single=True)
    with pytest.raises(ViewError):
        report.project("nope")


def test_invalid_expression_is_fatal(engine):
    report = engine.query("//a[")
    row = report.matches.first()
    assert row["severity"] == "fatal" and row["origin"] == "xpath"
    assert report.summary()["success"] is False and report.exit_status() == 1


def test_check(engine):
    rules = [Rule("//port[. = 80]", "p80", severity="warning", message="{file}:{line}:{col} {value}"), Rule("//tags", "tags", include=("b.*",)), Rule("//port", "yaml-port", language="yml")]
    report = engine.check(rules)
    rows = [(r["file"], r["rule_id"], r["severity"], r["reason"], r["message"]) for r in report.matches.orderBy("file", "rule_index", "item_index").collect()]
    assert rows == [
        ("a.json", "p80", "warning", "[p80] check failed", "a.json:3:11 80"),
        ("b.json", "tags", "error", "[tags] check failed", None),
        ("b.json", "tags", "error", "[tags] check failed", None),
        ("c.yaml", "p80", "warning", "[p80] check failed", "c.yaml:1:7 80"),
        ("c.yaml", "yaml-port", "error", "[yaml-port] check failed", None),
    ]
    s = report.summary()
    assert s["success"] is False and s["totals"] == {"results": 5, "files": 3, "errors": 3, "warnings": 2}


def test_rule_examples(engine):
    good = Rule("//port[. = 1]", "r", language="json", valid=('{"port": 2}',), invalid=('{"port": 1}',))
    assert engine.check(good).matches.count() == 0
    wrong = Rule("//port[. = 1]", "r", language="json", valid=('{"port": 1}',), invalid=('{"port": 2}',))
    assert [(r["command"], r["severity"], r["rule_id"]) for r in engine.check(wrong).matches.collect()] == [("test", "error", "r")] * 2
    assert engine.check(Rule("//x", valid=("a",))).matches.first()["severity"] == "fatal"


def test_expectations(engine):
    assert engine.test([("//port", 3), ("//nope", "none"), ("//tags", "some")]).exit_status() == 0
    assert engine.test([("//port", 2)]).exit_status() == 1
    assert engine.test([("//port", 2)], limit=1).exit_status() == 1  # the limit comes first


def test_errors_can_be_asked_for(engine):
    from sylva.operators.matching import run_rules

    rows = run_rules(engine.sources, [Rule("//port")], errors=True).where("severity = 'fatal'").collect()
    assert [(r["file"], r["origin"]) for r in rows] == [("bad.json", "input")]


def test_tree_modes_per_rule(engine):
    rules = [Rule("//port"), Rule("//property", tree_mode="structure")]
    counts = {r["rule_index"]: r["count"] for r in engine.query(rules).matches.groupBy("rule_index").count().collect()}
    assert counts == {0: 3, 1: 6}


def test_map_items(engine):
    row = engine.query("(map { 'p': string(//port), 't': //tags ! string() })").matches.where("file = 'b.json'").first()
    assert row["item_type"] == "map" and json.loads(row["tree"]) == {"p": "8080", "t": ["q", "r"]}
    assert row["value"] is None


def test_atomic_quotes(engine):
    assert engine.query("string(//host)").matches.where("file = 'a.json'").first()["value"] == '"x"'
    assert engine.query("string(//host)", quoted=False).matches.where("file = 'a.json'").first()["value"] == "x"


def test_groups_nest(engine):
    found = engine.check([Rule("//port", "p"), Rule("//tags", "t")], examples=False).matches
    rows = grouped(found, ["file", "rule_id"], ["line"]).collect()
    assert [r["file"] for r in rows] == ["a.json", "b.json", "c.yaml"]
    assert [(g["rule_id"], len(g["results"])) for g in rows[1]["results"]] == [("p", 1), ("t", 2)]
    with pytest.raises(ValueError):
        grouped(found, ["value"], ["line"])


def test_views():
    assert view("query") == ("file", "line", "tree")
    assert view("query", "+value,-tree") == ("file", "line", "value")
    assert view("check", "file,reason") == ("file", "reason")
    for bad in ("file,+tree", "nope", "-file,-line,-tree"):
        with pytest.raises(ViewError):
            view("query", bad)


def test_sinks(engine):
    report = engine.check(Rule("//port[. = 80]", "p", "bad port"), fields=("lines",))
    gcc = report.to_gcc()
    assert gcc == 'a.json:3:11: error: bad port\n3 |   "port": 80\n              ^~\n\nc.yaml:1:7: error: bad port\n1 | port: 80\n          ^~\n\n2 errors in 2 files'
    data = json.loads(report.to_json(("file", "line", "reason"), by=("file",)))
    assert data["group"] == "file" and data["summary"]["totals"]["errors"] == 2
    assert data["results"][0] == {"file": "a.json", "results": [{"line": 3, "reason": "bad port"}]}
    assert "reason: bad port" in report.to_yaml(("reason",))
    xml = report.to_xml(("reason", "severity"))
    assert '<match line="3" column="11" end_line="3" end_column="13">' in xml and "<errors>2</errors>" in xml
    assert json.loads(report.to_hook())["decision"] == "block"
    assert Report(report.matches.where("false"), "check").to_hook() == ""
    assert report.to_text(("file", "line", "reason")).startswith("a.json:3")


def test_schema(spark, engine):
    rows = schema_paths(node_table(engine.sources.where("language = 'json'"))).collect()
    assert {r["path"]: (r["count"], list(r["values"])) for r in rows}["document/tags"] == (2, ["q", "r"])
    assert "  port (2) = " in schema_text(rows)


@pytest.mark.parametrize(
    "language,text,xpath,value,kind,expected",
    [
        ("json", '{"a": 1}', "//a", "2", None, '{"a": 2}'),
        ("json", '{"a": "x"}', "//a", "y", None, '{"a": "y"}'),
        ("json", '{"a": 1}', "//a", "x", None, '{"a": "x"}'),
        ("yaml", "p:\n  - v: old\n  - v: old\n", "//p/v[.='old']", "new", None, "p:\n  - v: new\n  - v: new\n"),
        ("json", '{"a": 1}', "//b", "1", None, '{"a": 1, "b": "1"}'),
        ("json", '{"a": 1}', "//b", "x", "string", '{"a": 1, "b": "x"}'),
        ("json", "{}", "//b/c", "true", "boolean", '{"b": {"c": true}}'),
        ("json", '{\n  "a": {\n    "x": 1\n  }\n}\n', "//a/y", "2", "number", '{\n  "a": {\n    "x": 1,\n    "y": 2\n  }\n}\n'),
        ("json", '{"l": [{"k": 1}, {"k": 2}]}', "//l[k=2]/k", "5", None, '{"l": [{"k": 1}, {"k": 5}]}'),
        ("json", '{"é": 1, "k": 2}', "//k", "3", None, '{"é": 1, "k": 3}'),
        ("yaml", "a: 1\nb: 'q'\n", "//b", "it's", None, "a: 1\nb: 'it''s'\n"),
        ("yaml", "a: 1\n", "//c", "x", "string", "a: 1\nc: x\n"),
        ("yaml", "db:\n  host: h\nz: 1\n", "//db/port", "1", "number", "db:\n  host: h\n  port: 1\nz: 1\n"),
        ("ini", "[s]\nk = v\n", "//s/k", "w", None, "[s]\nk = w\n"),
        ("env", "A=1\nB='x'\n", "//B", "y", None, "A=1\nB='y'\n"),
    ],
)
def test_upserts(language, text, xpath, value, kind, expected):
    assert apply_mapping(text, language, Mapping(xpath, value, kind))[0] == expected


def test_upsert_refusals():
    with pytest.raises(MutationError):
        apply_mapping("[s]\nk=v\n", "ini", Mapping("//zz", "1"))
    with pytest.raises(MutationError):
        apply_mapping('{"a": 1}', "json", Mapping("//b[c='1']/d", "1"))
    assert apply_mapping('{"a": 1}', "json", Mapping("//b", "1"), insert=False) == ('{"a": 1}', [])
    assert spliced("abc", [(0, 1, "x"), (0, 1, "x"), (2, 3, "z")]) == "xbz"
    with pytest.raises(MutationError):
        spliced("abc", [(0, 2, "x"), (1, 3, "y")])


@pytest.mark.parametrize(
    "expression,expected",
    [
        ("database[host='localhost'][port=5432]", [("//database/host", "localhost", "string"), ("//database/port", "5432", "number")]),
        ("database[host='l'][user[name='admin'][password='secret']]", [("//database/host", "l", "string"), ("//database/user/name", "admin", "string"), ("//database/user/password", "secret", "string")]),
        ("database/host", [("//database/host", "null", "null")]), ("database/host[port=8080]", [("//database/host/port", "8080", "number")]), ("a[b[c[d='deep']]]", [("//a/b/c/d", "deep", "string")]),
        ("parent[sub[marker]]", [("//parent/sub/marker", "null", "null")]), ("config[enabled][name='test']", [("//config/enabled", "null", "null"), ("//config/name", "test", "string")]), ('db[host="x"]', [("//db/host", "x", "string")]),
        ("config[debug=true()][verbose=false()]", [("//config/debug", "true", "boolean"), ("//config/verbose", "false", "boolean")]), ("s[k='it''s']/p[n=1]", [("//s[k='it''s']/p/n", "1", "number")]),
    ],
)
def test_declared(expression, expected):
    assert [(m.xpath, m.value, m.kind) for m in declared(expression)] == expected


def test_declared_refusals_and_selectors():
    for bad in ("config[debug=true]", "a[", "a[b=]", "a]", "", "a[b='x'] c"):
        with pytest.raises(MutationError):
            declared(bad)
    assert declared("database[host='x']/port", "1") == [Mapping("//database[host='x']/port", "1")]
    assert declared("//database/port", "1") == [Mapping("//database/port", "1")]


def test_declared_sets(spark):
    def one(text, language, expression, value=None):
        return Engine(inline(spark, [(None, language, text)])).set(expression, value).matches.first()["output"]

    assert json.loads(one("{}", "json", "database[host='localhost'][port=5432][user[name='admin']]")) == {"database": {"host": "localhost", "port": 5432, "user": {"name": "admin"}}}
    assert json.loads(one("{}", "json", "database/host")) == {"database": {"host": None}}
    yaml = "servers:\n  - host: localhost\n    port: 5432\n  - host: prod-db\n    port: 5432\n"
    assert one(yaml, "yaml", "servers[host='localhost']/port", "5433") == yaml.replace("5432", "5433", 1)
    assert one("name: test\n", "yaml", "database[host='localhost'][port=5432]") == "name: test\ndatabase:\n  host: localhost\n  port: 5432\n"


def test_set_and_update(engine):
    report = engine.set("//port", "81")
    rows = {r["file"]: (r["status"], r["output"]) for r in report.matches.where("severity is null").collect()}
    assert rows["b.json"] == ("updated", '{"port": 81, "tags": ["q", "r"]}')
    assert report.matches.where("severity = 'fatal'").count() == 1  # the text that does not parse
    assert engine.update("//nope", "1").failed
    assert not engine.update("//port", "1").failed
    assert engine.set([Mapping("//port", "81")], verify=True).failed


def test_run_sees_earlier_changes(spark):
    e = Engine(inline(spark, [("a.json", "json", '{"port": 80}'), ("b.yaml", "yaml", "port: 80\n")]))
    report = e.run("""
files: ["*.json", "*.yaml"]
set: {mappings: [{xpath: //port, value: 81}], files: ["*.json"]}
operations:
  - check: {rules: [{id: old, xpath: "//port[. = 80]"}]}
  - test: {assertions: [{xpath: //port, expect: 2}]}
""")
    rows = report.matches.where("rule_id = 'old'").collect()
    assert [r["file"] for r in rows] == ["b.yaml"]


def test_changed_only(spark, engine):
    changed = spark.createDataFrame([("b.json", 1, 1)], "path string, first int, last int")
    assert [r["file"] for r in engine.query("//port", hunks=changed).matches.collect()] == ["b.json"]
    assert engine.query("//port", changed=changed).matches.count() == 1


def test_git_source(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.json").write_text('{"k": 1}\n')
    git("add", ".")
    git("commit", "-qm", "x")
    (tmp_path / "a.json").write_text('{"k": 1}\n{"k": 2}\n')
    paths, hunks = git_changes(spark, str(tmp_path), "HEAD")
    assert [r[0] for r in paths.collect()] == ["a.json"] and [tuple(r) for r in hunks.collect()] == [("a.json", 2, 2)]


def test_only_parsed_where_a_rule_applies(spark):
    """Sources that no rule applies to are filtered out below Python."""
    df = spark.createDataFrame([(1, "a.json", "{}")], "i long, p string, t string")
    found = Engine(from_table(df, "t", F.col("p"), None, "i")).query(Rule("//x", include=("*.yaml",)))
    assert found.matches.count() == 0
