"""The command line, debug output, bounded reports, diagnostics."""

import io
import json

import pytest

from sylva import __main__ as command
from sylva.functions.highlight import COLOURS, RESET, category, highlighted
from sylva.operators import sinks
from sylva.operators.engine import Engine
from sylva.operators.reports import grouped_rows
from sylva.operators.rules import Rule
from sylva.operators.sinks import ReportError
from sylva.plans.builder import PathPick, build_query_from_paths
from sylva.sources.documents import diagnosed, inline
from sylva.sources.parsers import parse


@pytest.fixture
def folder(tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text('{"port": 80}\n')
    (tmp_path / "b.json").write_text('{"port": 81}\n')
    monkeypatch.chdir(tmp_path)
    return tmp_path


def run(spark, capsys, *argv):
    status = command.main(list(argv), spark)
    return status, capsys.readouterr().out


def test_query_check_test(spark, folder, capsys):
    assert run(spark, capsys, "query", "-x", "//port", "-p", "value", "*.json") == (0, "80\n81\n")
    status, out = run(spark, capsys, "check", "-x", "//port[. = 80]", "--reason", "plain port", "-f", "gcc", "*.json")
    assert status == 1 and "a.json:1:10: error: plain port" in out and "1 error in 1 file" in out
    assert run(spark, capsys, "test", "-x", "//port", "-e", "2", "*.json")[0] == 0
    assert run(spark, capsys, "query", "-x", "//port", "-s", '{"port": 5}', "-l", "json", "-p", "count") == (0, "1\n")
    status, out = run(spark, capsys, "query", "-x", "//port", "-f", "json", "-v", "line,value", "*.json")
    assert [r["value"] for r in json.loads(out)["results"]] == ["80", "81"]


def test_set_debug_run(spark, folder, capsys, monkeypatch):
    assert run(spark, capsys, "set", "-x", "//port", "--value", "9", "a.json")[0] == 0
    assert (folder / "a.json").read_text() == '{"port": 9}\n'
    assert run(spark, capsys, "set", "-x", "//port", "--value", "7", "--stdout", "b.json")[1] == '{"port": 7}\n' and "81" in (folder / "b.json").read_text()
    assert "»81«" in run(spark, capsys, "debug", "-x", "//port[. = 81]", "*.json")[1]
    assert run(spark, capsys, "init")[0] == 0 and (folder / "sylva.yaml").exists()
    with pytest.raises(FileExistsError):
        command.starter(".")
    status, out = run(spark, capsys, "run", "-f", "gcc")
    assert status == 0 and "warning: replace this rule" in out
    monkeypatch.setattr("sys.stdin", io.StringIO("<document><a>x</a></document>"))
    assert run(spark, capsys, "render", "-l", "yaml")[1].strip() == "a: x"
    assert "json" in run(spark, capsys, "languages")[1] and run(spark, capsys, "version")[1].strip()


def test_problems_are_rows(spark, folder, capsys):
    status, out = run(spark, capsys, "check", "-x", "//a", "-f", "gcc", "nothing/*.json")
    assert status == 1 and "matched 0 files" in out
    assert diagnosed(spark, [])[1] and "limit is 1" in diagnosed(spark, [f"{folder}/*.json"], max_files=1)[1][0] and diagnosed(spark, [f"{folder}/*.json"])[1] == []


def test_reports_have_a_bound_and_lines_have_none(spark, monkeypatch, tmp_path):
    report = Engine(inline(spark, [(f"{k}.json", "json", '{"k": [1, 2]}') for k in range(3)])).check(Rule("//k", "r"), fields=())
    monkeypatch.setattr(sinks, "MAX_MATCHES", 5)
    for made in (lambda: report.to_gcc(), lambda: report.to_json(("value",)), lambda: report.to_xml(("value",)), lambda: report.to_text(("value",))):
        with pytest.raises(ReportError):
            made()
    report.save(str(tmp_path / "out"), "gcc")
    assert spark.read.text(str(tmp_path / "out")).count() == 6
    assert [r["text"][:7] for r in report.lines("github").collect()] == ["::error"] * 6
    rows = grouped_rows(report.matches, ["file"], ["value"]).collect()
    assert [(r["file"], r["value"]) for r in rows] == [(f"{k}.json", v) for k in range(3) for v in ("1", "2")]


def test_debug_limit_runs_on(spark):
    e = Engine(inline(spark, [("a.txt", "text", "x\nx"), ("b.txt", "text", "x\nx"), ("c.txt", "text", "x")]))
    assert [(r["file"], r["matches"], r["output"]) for r in e.debug("//line", limit=3).orderBy("file").collect()] == [("a.txt", 2, "»x«\n»x«"), ("b.txt", 1, "»x«\nx")]


def test_highlighting_and_paths():
    code = "def f(x):\n    return 1  # ü\n"
    out = highlighted(code, parse(code, "python"), "python")
    assert out.replace(RESET, "").translate({0x1B: None}) and f"{COLOURS['comment']}# ü{RESET}" in out and f"{COLOURS['keyword']}return{RESET}" in out
    for colour in (*COLOURS.values(), RESET):
        out = out.replace(colour, "")
    assert out == code
    assert (category("ref", "rust"), category("ref", "go"), category("nope"), category("plus")) == ("type", "identifier", "default", "operator")
    assert build_query_from_paths([]) == "" and build_query_from_paths([PathPick(("a", "b")), PathPick(("a", "c"), ".='1'", True)]) == "//a[b]/c[.='1']"
