"""Registered queries of sources, scopes, reports, sinks and changes, and their SQL."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import __version__
from .corpora import documents_text, events_json, table
from .operators.engine import Engine
from .operators.matching import run_rules
from .operators.mutation import Mapping, declared, mutate, write_back
from .operators.reports import grouped_rows, schema_paths, schema_text
from .operators.rules import Rule
from .operators.sinks import view
from .registry import query
from .sources import diffs
from .sources.documents import PATHLESS, SourceError, from_files, from_paths, from_table, inline, resolve_input, scoped
from .sources.languages import languages_table
from .sources.nodes import node_table
from .staging import shared_dir, temporary


def _text_files(spark, sf_dir: str) -> str:
    """A folder with one subfolder of text files for each region: the names of its nations."""
    folder = f"{temporary(spark, 'files')}/all"
    table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("value")).repartition(1).write.partitionBy("n_regionkey").text(folder)
    return re.sub("^file:/*", "/", folder)


def _region_of(file: str):
    return F.regexp_extract(file, r"n_regionkey=(\d+)", 1).cast("int")


def _regions(spark, sf_dir: str) -> DataFrame:
    """One JSON text for each region."""
    path = F.format_string("r/%d.json", "r_regionkey")
    return from_table(table(spark, sf_dir, "region"), F.format_string('{"name": "%s"}', "r_name"), path, None, "r_regionkey")


def _rows(spark, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# -- sources -------------------------------------------------------------------------------------


@query("""SELECT CAST(n_regionkey AS INT) AS region, n_name AS value FROM nation""")
def files_scan(spark, sf_dir):
    """All files of two overlapping patterns, each once."""
    folder = _text_files(spark, sf_dir)
    found = Engine(from_files(spark, [f"{folder}/**/*.txt", f"{folder}/n_regionkey=1/*.txt"], language="text")).query("//line[. != '']", fields=("value",))
    return found.matches.select(_region_of("file").alias("region"), "value")


@query("""SELECT CAST(n_regionkey AS INT) AS region, count(*) AS n FROM nation WHERE n_regionkey IN (0, 2) GROUP BY ALL""")
def files_pruned(spark, sf_dir):
    """Folders that patterns cannot reach are not listed, excluded files not read."""
    folder = _text_files(spark, sf_dir)
    sources = from_files(spark, [f"{folder}/n_regionkey=0/*", f"{folder}/n_regionkey=1/*", f"{folder}/n_regionkey=2/**"], exclude=["**/n_regionkey=1/**"], language="text")
    return run_rules(sources, [Rule("//line[. != '']")]).groupBy(_region_of("file").alias("region")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(n_regionkey AS INT) AS region, n_name AS value FROM nation WHERE n_regionkey < 2""")
def piped_paths(spark, sf_dir):
    """Paths read as lines."""
    folder = _text_files(spark, sf_dir)
    paths = [r["path"] for r in from_files(spark, [f"{folder}/**/*.txt"], language="text").select("path").collect()]
    listed = "\n".join(["", *sorted(p for p in paths if "=0/" in p or "=1/" in p), " "])
    return run_rules(from_paths(spark, listed, language="text"), [Rule("//line[. != '']")]).select(_region_of("file").alias("region"), "value")


@query(f"""SELECT 'src/' || r_regionkey || '.json' AS file, r_name AS value FROM region UNION ALL SELECT '{PATHLESS}', r_name FROM region""")
def inline_texts(spark, sf_dir):
    """Texts with a path of their own, and without any."""
    names = [(r["r_regionkey"], r["r_name"]) for r in table(spark, sf_dir, "region").collect()]
    sources = inline(spark, [(f"src\\{k}.json", "json", json.dumps({"name": n})) for k, n in names] + [(None, "yaml", f"name: {n}") for _, n in names])
    return run_rules(sources, [Rule("//name")]).select("file", "value")


@query(f"""SELECT * FROM (VALUES ('string', '{PATHLESS}', 'json'), ('string with path', 'a/b.json', 'json'), ('piped text', '{PATHLESS}', 'yaml'), ('no language', 'inline text needs a language', ''), ('two paths', 'inline text takes one path at most', '')) t(mode, path, language)""")
def input_modes(spark, sf_dir):
    asked = {
        "string": {"string": "{}", "language": "json"}, "string with path": {"string": "{}", "paths": ["a/b.json"]}, "piped text": {"piped": "a: 1", "language": "yml"},
        "no language": {"string": "{}"}, "two paths": {"string": "{}", "paths": ["a.json", "b.json"]},
    }
    rows = []
    for mode, given in asked.items():
        try:
            r = resolve_input(spark, **given).first()
            rows.append((mode, r["path"], r["language"]))
        except SourceError as e:
            rows.append((mode, str(e), ""))
    return _rows(spark, "mode string, path string, language string", *rows)


@query("""SELECT n_nationkey AS doc_id, CASE WHEN n_regionkey = 0 THEN 'json' ELSE 'yaml' END AS language FROM nation WHERE n_regionkey IN (0, 1) AND length(n_name) < 9""")
def language_and_size_filter(spark, sf_dir):
    """Sources of unknown languages are left out; others by their size."""
    ext = F.element_at(F.array(*map(F.lit, ("json", "yml", "zzz", "nope", "x"))), (F.col("n_regionkey") + 1).cast("int"))
    sources = from_table(table(spark, sf_dir, "nation"), F.col("n_name"), F.concat(F.lit("n."), ext), None, "n_nationkey")
    return sources.where(F.length("content") < 9).select("doc_id", "language")


@query("""SELECT 'src/' || n_nationkey || '.json' AS path FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey < 20 AND n_name NOT LIKE '%1'""")
def scopes_of_files(spark, sf_dir):
    """Root, operation and command line scopes meet, an excluded file leaves; an empty scope has none."""
    t = table(spark, sf_dir, "nation")
    sources = from_table(t, F.lit("{}"), F.format_string("src/%d.json", "n_nationkey"), None, "n_nationkey")
    of = lambda where: [f"src/{r[0]}.json" for r in t.where(where).select("n_nationkey").collect()]
    out = scoped(sources, files=of("n_regionkey in (1, 2)"), exclude=of("n_name like '%1'"), root_files=["src/*.json"], cli_files=of("n_nationkey < 20"))
    return out.unionByName(scoped(sources, files=[])).select("path")


@query("""SELECT n_nationkey AS doc_id FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey < 13""")
def changed_twice(spark, sf_dir):
    """Sources that two comparisons both name."""
    t = table(spark, sf_dir, "nation")
    path = F.format_string("n/%d.json", "n_nationkey")
    sources = from_table(t, F.lit("{}"), path, None, "n_nationkey")
    a, b = t.where("n_regionkey in (1, 2)").select(path.alias("path")), t.where("n_nationkey < 13").select(path.alias("path"))
    return diffs.only_changed(diffs.only_changed(sources, a), b).select("doc_id")


@query("""SELECT CAST(r_regionkey + 2 AS INT) AS line, r_name AS value FROM region WHERE r_regionkey > 0""")
def inline_hunks(spark, sf_dir):
    """Matches inside what changed between two texts: every name but the first is new."""
    names = [r["r_name"] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    new = "\n".join(["head", *names])
    hunks = diffs.hunks_between(spark, "a.txt", f"head\n{names[0]}", new)
    sources = inline(spark, [("a.txt", "text", new)])
    return diffs.in_hunks(run_rules(sources, [Rule("//line")]), hunks).select("line", "value")


# -- rules and verdicts --------------------------------------------------------------------------


@query("""SELECT n_nationkey AS doc_id, CASE WHEN n_regionkey < 2 THEN 'for-json' ELSE 'for-yaml' END AS rule_id FROM nation""")
def rule_languages(spark, sf_dir):
    """A rule of a language only sees its sources, also by an alias."""
    file = F.when(F.col("n_regionkey") < 2, "n.json").otherwise("n.yaml")
    sources = from_table(table(spark, sf_dir, "nation"), F.format_string('{"name": "%s"}', "n_name"), file, None, "n_nationkey")
    rules = [Rule("//name", "for-json", language="json"), Rule("//name", "for-yaml", language="yml"), Rule("//name", "for-go", language="go")]
    return run_rules(sources, rules, "check").select("doc_id", "rule_id")


@query("""SELECT 'wrong' AS rule_id, 'example that should not match does' AS reason UNION ALL SELECT 'wrong', 'example that should match does not'""")
def rule_examples(spark, sf_dir):
    rules = [Rule("//n[. = 1]", "right", language="json", valid=('{"n": 2}',), invalid=('{"n": 1}',)), Rule("//n[. = 1]", "wrong", language="json", valid=('{"n": 1}',), invalid=('{"n": 2}',))]
    return Engine(_regions(spark, sf_dir)).check_examples(rules).select("rule_id", "reason")


@query("""SELECT * FROM (VALUES ('clean', 'true', 0), ('errors', 'false', 1), ('single', 'none', 1), ('query', 'none', 0), ('expected', 'true', 0)) t(name, success, status)""")
def verdicts_and_status(spark, sf_dir):
    e = Engine(_regions(spark, sf_dir))
    reports = {"clean": e.check(Rule("//nope", "x")), "errors": e.check(Rule("//name", "x")), "single": e.query("//nope"), "query": e.query("//name"), "expected": e.test([("//name", 5), ("//nope", "none")])}
    return _rows(spark, "name string, success string, status int", *[(n, str(r.summary()["success"]).lower(), r.exit_status(n == "single")) for n, r in reports.items()])


@query("""SELECT 'fatal' AS severity, 'xpath' AS origin, true AS named UNION ALL SELECT 'fatal', 'config', true""")
def diagnostics_as_rows(spark, sf_dir):
    """What is wrong with an expression or with patterns is a fatal row of the report."""
    broken = Engine(_regions(spark, sf_dir)).query("//a[").matches.select("severity", "origin", F.col("reason").startswith("//a[").alias("named"))
    nothing = Engine.of_files(spark, [f"{re.sub("^file:/*", "/", shared_dir(spark))}/nothing-here-{uuid.uuid4().hex}/*.json"]).check(Rule("//a"))
    return broken.unionByName(nothing.matches.select("severity", "origin", F.col("reason").contains("matched 0 files").alias("named")))


@query("""SELECT count(*) AS found FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 10""")
def check_without_limit(spark, sf_dir):
    report = Engine(events_json(spark, sf_dir)).check(Rule("//k[. > 10]"))
    return report.matches.agg(F.count("*").alias("found"))


@query("""SELECT 5 AS n, 'AFRICA' AS first_value, 5 AS results""")
def count_and_single(spark, sf_dir):
    report = Engine(_regions(spark, sf_dir)).query("//name", fields=("value",))
    return _rows(spark, "n int, first_value string, results int", (report.project("count"), report.project("value", single=True).first()["value"], report.project("totals")["results"]))


@query("""SELECT 'r/' || r_regionkey || '.json' AS file, 1 AS matches, '{"name": »"' || r_name || '"«}' AS output FROM region WHERE r_regionkey < 3""")
def debug_marks(spark, sf_dir):
    """Texts with their matches marked; the limit runs on from file to file."""
    return Engine(_regions(spark, sf_dir)).debug("//name", limit=3).select("file", F.col("matches").cast("int").alias("matches"), "output")


# -- reports -------------------------------------------------------------------------------------


@query("""SELECT string_agg('r/' || r_regionkey || '.json:1' || chr(10) || r_name, chr(10) || chr(10) ORDER BY r_regionkey) AS text FROM region""")
def text_report(spark, sf_dir):
    return _rows(spark, "text string", (Engine(_regions(spark, sf_dir)).query("//name", fields=("value",)).to_text(("file", "line", "value")),))


@query("""SELECT r_regionkey AS k, 'r/' || r_regionkey || '.json' AS file, r_name AS value, 5 AS errors, false AS success FROM region""")
def json_and_yaml_reports(spark, sf_dir):
    """The same results in the JSON and the YAML document of a report."""
    import yaml

    report = Engine(_regions(spark, sf_dir)).check(Rule("//name", "x"), fields=())
    a, b = json.loads(report.to_json(("file", "value"))), yaml.safe_load(report.to_yaml(("file", "value")))
    rows = [(int(r["file"][2:-5]), r["file"], s["value"], b["summary"]["totals"]["errors"], a["summary"]["success"]) for r, s in zip(a["results"], b["results"], strict=True)]
    return _rows(spark, "k long, file string, value string, errors int, success boolean", *rows)


@query("""SELECT 'r/' || r_regionkey || '.json' AS file, r_name AS value, '1' AS line, '5' AS errors FROM region""")
def xml_report(spark, sf_dir):
    """The XML document of a report, read back by a query."""
    xml = Engine(_regions(spark, sf_dir)).check(Rule("//name", "x"), fields=()).to_xml(("value",))
    x = "for $g in //group return map { 'file': string($g/@file), 'value': string($g/match/value), 'line': string($g/match/@line), 'errors': string(//totals/errors) }"
    found = run_rules(inline(spark, [("r.xml", "xml", xml)]), [Rule(x, normalize=False)])
    return found.select(*[F.get_json_object("tree", f"$.{n}").alias(n) for n in ("file", "value", "line", "errors")])


@query("""SELECT string_agg('r/' || r_regionkey || '.json:1:10: error: bad name' || chr(10) || '1 | {"name": "' || r_name || '"}' || chr(10) || '             ^' || repeat('~', length(r_name) + 1), chr(10) || chr(10) ORDER BY r_regionkey) || chr(10) || chr(10) || '5 errors in 5 files' AS gcc,
  'block' AS decision FROM region""")
def gcc_and_hook_reports(spark, sf_dir):
    report = Engine(_regions(spark, sf_dir)).check(Rule("//name", "x", "bad name"))
    return _rows(spark, "gcc string, decision string", (report.to_gcc(), json.loads(report.to_hook())["decision"]))


@query("""SELECT CAST(r_regionkey AS INT) AS k, '{"file":"r/' || r_regionkey || '.json","line":1,"value":"' || r_name || '"}' AS text FROM region""")
def saved_report_lines(spark, sf_dir):
    """A report saved as JSON lines by the tasks that hold them, read again."""
    path = f"{temporary(spark, 'report')}/all"
    Engine(_regions(spark, sf_dir)).query("//name", fields=("value",)).save(path, "json", ("file", "line", "value"))
    return spark.read.text(path).select(F.regexp_extract("value", r"r/(\d+)", 1).cast("int").alias("k"), F.col("value").alias("text"))


@query("""SELECT 'r/' || r_regionkey || '.json' AS file, 'x' AS rule_id, CAST(1 AS INT) AS line, r_name AS value FROM region""")
def grouped_without_arrays(spark, sf_dir):
    found = Engine(_regions(spark, sf_dir)).check(Rule("//name", "x"), fields=()).matches
    return grouped_rows(found, ["file", "rule_id"], ["value"]).select("file", "rule_id", "line", "value")


@query("""SELECT * FROM (VALUES ('query', 'file,line,tree'), ('check', 'reason,severity,lines'), ('set', 'file,line,status,reason'), ('+value,-tree', 'file,line,value'), ('file,reason', 'file,reason'), ('mixed', 'a list of fields and changes to the default cannot be mixed')) t(asked, fields)""")
def report_views(spark, sf_dir):
    rows = [(c, ",".join(view(c))) for c in ("query", "check", "set")] + [(s, ",".join(view("query", s))) for s in ("+value,-tree", "file,reason")]
    try:
        view("query", "file,+tree")
    except ValueError as e:
        rows.append(("mixed", str(e)))
    return _rows(spark, "asked string, fields string", *rows)


@query("""SELECT 'r/' || r_regionkey || '.json' AS file, r_name AS shown, 5 AS outputs, 'updated' AS status FROM region""")
def captured_outputs(spark, sf_dir):
    """New texts captured in the report instead of written to files."""
    report = Engine(_regions(spark, sf_dir)).set("//name", "x")
    data = report.envelope(("file", "status"))
    names = {f"r/{r['r_regionkey']}.json": r["r_name"] for r in table(spark, sf_dir, "region").collect()}
    rows = [(r["file"], names[r["file"]], sum(json.loads(o["content"]) == {"name": "x"} for o in data["outputs"]), r["status"]) for r in data["results"]]
    return _rows(spark, "file string, shown string, outputs int, status string", *rows)


@query("""SELECT 'document (25)' || chr(10) || '  name (25) = ' || string_agg('"' || n_name || '"', ', ' ORDER BY n_nationkey) FILTER (n_nationkey < 5) || ', … (+20)' || chr(10) || '  region (25) = ' || (SELECT string_agg('"' || r || '"', ', ' ORDER BY k) FROM (SELECT n_regionkey AS r, min(n_nationkey) AS k FROM nation GROUP BY n_regionkey)) AS text FROM nation""")
def schema_tree_text(spark, sf_dir):
    """The schema of a corpus as a tree: counts, the first values, how many more."""
    src = from_table(table(spark, sf_dir, "nation"), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))), F.lit("n.json"), None, "n_nationkey")
    return _rows(spark, "text string", (schema_text(schema_paths(node_table(src, inner_values=False)).collect()),))


@query("""SELECT 0 AS status, count(*) AS languages, 1 AS json FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18), (19), (20), (21), (22), (23), (24), (25), (26), (27), (28), (29)) t(k)""")
def languages_and_version(spark, sf_dir):
    t = languages_table(spark)
    return t.agg(F.lit(0 if __version__ else 1).alias("status"), F.count("*").alias("languages"), F.count_if(F.col("language") == "json").cast("int").alias("json"))


# -- changes -------------------------------------------------------------------------------------


@query("""SELECT event_id AS doc_id, replace(props, json_extract_string(props, '$.k'), '7') AS output FROM events WHERE json_extract_string(props, '$.k') <> '7' AND CAST(json_extract_string(props, '$.k') AS INT) < 50""")
def update_existing(spark, sf_dir):
    """Only what is there is set; sources without it stay unchanged."""
    text = F.when(F.get_json_object("props", "$.k").cast("int") < 50, F.col("props")).otherwise(F.lit("{}"))
    src = from_table(table(spark, sf_dir, "events"), text, F.format_string("e/%d.json", "event_id"), None, "event_id")
    return Engine(src).update("//k", "7").matches.where("status = 'updated'").select("doc_id", "output")


@query("""SELECT n_nationkey AS doc_id, '{"db": {"host": "' || n_name || '", "port": ' || n_regionkey || ', "on": true}}' AS json, 'a: 1' || chr(10) || 'db:' || chr(10) || '  host: h' || chr(10) AS yaml FROM nation""")
def declared_sets(spark, sf_dir):
    """One expression sets several values; the path that lacks is made."""
    t = table(spark, sf_dir, "nation")
    json_src = from_table(t, F.format_string('{"db": {"host": "%s", "port": %d}}', "n_name", "n_regionkey"), F.lit("n.json"), None, "n_nationkey")
    a = mutate(json_src, declared("db[on=true()]")).select("doc_id", F.col("output").alias("json"))
    b = mutate(from_table(t, F.lit("a: 1\n"), F.lit("n.yaml"), None, "n_nationkey"), declared("db[host='h']")).select("doc_id", F.col("output").alias("yaml"))
    return a.join(b, "doc_id")


@query("""SELECT n_nationkey AS doc_id, '{' || chr(10) || '    "a": {' || chr(10) || '        "x": ' || n_regionkey || ',' || chr(10) || '        "y": 2' || chr(10) || '    }' || chr(10) || '}' || chr(10) AS output FROM nation""")
def inserted_with_indent(spark, sf_dir):
    """A new member follows the indentation that is there."""
    text = F.format_string('{\n    "a": {\n        "x": %d\n    }\n}\n', "n_regionkey")
    src = from_table(table(spark, sf_dir, "nation"), text, F.lit("n.json"), None, "n_nationkey")
    return mutate(src, [Mapping("//a/y", "2", "number")]).select("doc_id", "output")


@query("""SELECT n_nationkey AS doc_id, '[s]' || chr(10) || 'k = w' || chr(10) || 'n = ' || n_regionkey || chr(10) AS ini, '{"a": 9, "b": [8, 2, 3]}' AS json FROM nation""")
def literal_and_limited_sets(spark, sf_dir):
    """Languages without a renderer get the text as it is; a mapping's limit and equal spans count once."""
    t = table(spark, sf_dir, "nation")
    ini = from_table(t, F.format_string("[s]\nk = v\nn = %d\n", "n_regionkey"), F.lit("n.ini"), None, "n_nationkey")
    src = from_table(t, F.lit('{"a": 1, "b": [1, 2, 3]}'), F.lit("n.json"), None, "n_nationkey")
    a = mutate(ini, [Mapping("//s/k", "w")]).select("doc_id", F.col("output").alias("ini"))
    b = mutate(src, [Mapping("//a | //a", "9"), Mapping("//b", "8", None, 1)]).select("doc_id", F.col("output").alias("json"))
    return a.join(b, "doc_id")


@query("""SELECT 'r/' || r_regionkey || '.json' AS file, '{"name": "x"}' AS output FROM region""")
def written_back(spark, sf_dir):
    """New texts as a table of versions."""
    changed = Engine(_regions(spark, sf_dir)).set("//name", "x").matches
    return write_back(changed, f"{temporary(spark, 'versions')}/all").select("file", "output")


@query("""SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL) WHERE length(l) > 0 GROUP BY doc_id""")
def native_line_counts(spark, sf_dir):
    return run_rules(documents_text(spark, sf_dir), [Rule("//line[string-length(.) > 0]")]).groupBy("doc_id").agg(F.count("*").alias("lines"))
