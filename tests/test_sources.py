import pytest
from pyspark.sql import functions as F

from sylva.sources import config, diffs, globs
from sylva.sources.documents import PATHLESS, SourceError, from_files, from_table, inline, language_of, resolve_input, scoped
from sylva.sources.languages import canonical, claims, of_path


@pytest.mark.parametrize(
    "pattern,path,yes",
    [
        ("src/*.py", "src/a.py", True), ("src/*.py", "src/b/a.py", False), ("src/**/*.py", "src/a.py", True), ("src/**/*.py", "src/b/c/a.py", True), ("**/x", "a/b/x", True), ("src/**", "src/a/b", True),
        ("src/**", "srcx/a", False), ("a?.py", "ab.py", False), ("a?.py", "a?.py", True), ("[a].py", "[a].py", True), ("*", "a", True), ("*", "a/b", False),
    ],
)
def test_globs(pattern, path, yes):
    import re

    assert bool(re.fullmatch(globs.to_regex(pattern)[1:-1], path)) == yes


def test_paths():
    assert globs.normalized_path("\\\\?\\C:\\a\\b") == "C:/a/b"
    assert globs.absolute_path("../b", "/a/c") == "/a/b"
    assert globs.literal_prefix("/a/b/*/c.py") == "/a/b"


def test_languages():
    assert canonical("js") == "javascript" and canonical("nope") == "unknown"
    assert of_path("A/B.CS") == "csharp" and of_path("x") == "unknown"
    assert claims("yml") == ["yaml"]


def test_language_column(spark):
    df = spark.createDataFrame([("a.py",), ("b.unknown",), ("c",), ("d.X.YAML",)], "p string")
    assert [r[0] for r in df.select(language_of(F.col("p"))).collect()] == ["python", "unknown", "unknown", "yaml"]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"k": 1}')
    (tmp_path / "a" / "y.json").write_text("﻿{}")
    (tmp_path / "z.nope").write_text("?")
    found = from_files(spark, [f"{tmp_path}/**/*.json"])
    assert sorted((r["path"].rpartition("/")[2], r["content"]) for r in found.collect()) == [("x.json", '{"k": 1}'), ("y.json", "{}")]
    assert from_files(spark, [f"{tmp_path}/**"], exclude=["**/y.json"]).count() == 1
    with pytest.raises(SourceError):
        from_files(spark, [f"{tmp_path}/**"], max_files=1)
    with pytest.raises(SourceError):
        from_files(spark, [])


def test_input_modes(spark):
    assert resolve_input(spark, string="{}", language="json").first()["path"] == PATHLESS
    assert resolve_input(spark, string="{}", paths=["a/b.json"]).first()["language"] == "json"
    assert resolve_input(spark, piped="a: 1", language="yml").first()["language"] == "yaml"
    for bad in ({"string": "{}"}, {"string": "{}", "paths": ["a.json", "b.json"]}):
        with pytest.raises(SourceError):
            resolve_input(spark, **bad)
    with pytest.raises(SourceError):
        inline(spark, [(None, "klingon", "x")])


def test_unknown_languages_are_left_out(spark):
    df = spark.createDataFrame([(1, "a.json", "{}"), (2, "b.zzz", "x")], "i long, p string, t string")
    assert [r["doc_id"] for r in from_table(df, "t", F.col("p"), None, "i").collect()] == [1]


def test_scopes(spark):
    src = inline(spark, [(p, "json", "{}") for p in ("src/a.json", "src/b.json", "lib/a.json")])
    paths = lambda d: sorted(r["path"] for r in d.collect())
    assert paths(scoped(src, files=["src/*"])) == ["src/a.json", "src/b.json"]
    assert paths(scoped(src, files=["**/a.json"], root_files=["src/*"])) == ["src/a.json"]
    assert paths(scoped(src, files=[])) == []
    assert paths(scoped(src, exclude=["src/*"])) == ["lib/a.json"]


def test_diffs(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n@@ -5,2 +5,0 @@\n-c\n-d\n@@ -9,0 +8,3 @@\n+e\n--- /dev/null\n+++ b/new\n@@ -0,0 +1,2 @@\n+q"
    hunks = diffs.hunks_of_diff(spark.createDataFrame([(text,)], "diff string"))
    assert sorted(map(tuple, hunks.collect())) == [("new", 1, 2), ("x", 1, 1), ("x", 8, 10)]
    between = diffs.hunks_between(spark, "f", "a\nb\nc\n", "a\nB\nc\nd\n")
    assert sorted(map(tuple, between.collect())) == [("f", 2, 2), ("f", 4, 4)]


def test_config():
    ops = config.parse("files: ['src/**']\nexclude: [a]\ncheck: {rules: [{xpath: //a}], exclude: [b]}\noperations:\n  - query: {queries: [{xpath: //b}], files: [x]}\n")
    assert [(o.kind, o.files, o.root_files, o.exclude) for o in ops] == [("check", None, ["src/**"], ["a", "b"]), ("query", ["x"], ["src/**"], ["a"])]
    assert config.parse('[check]\nrules = [{xpath = "//a"}]\n', "toml")[0].kind == "check"
    for bad in ("nope: 1", "check: {rule: []}", "check: {rules: [{id: x}]}", "operations: [{fly: {}}]"):
        with pytest.raises(config.ConfigError):
            config.parse(bad)
