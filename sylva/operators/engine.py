"""The operations: query, check, test, set, update and run, over a table of sources."""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.xpath import problem
from ..sources import config as configs
from ..sources import diffs
from ..sources.documents import diagnosed, inline, scoped
from ..staging import settle
from .debugging import marked_sources
from .matching import SCHEMA, limited, run_rules
from .mutation import Mapping, declared, mutate
from .reports import expectation
from .rules import Rule
from .sinks import DEFAULT_VIEW, Report, view


def _as_rules(xpaths: str | Rule | Iterable[str | Rule]) -> list[Rule]:
    items = [xpaths] if isinstance(xpaths, (str, Rule)) else list(xpaths)
    return [x if isinstance(x, Rule) else Rule(x) for x in items]


def _diagnostics(spark, rows: list[dict]) -> DataFrame:
    names = [c.split()[0].strip("`") for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)


def _fatal(message: str, origin: str, command: str, index: int = 0) -> dict:
    return {"file": "", "line": 1, "column": 1, "end_line": 1, "end_column": 1, "command": command, "rule_index": index, "item_index": 0, "reason": message, "severity": "fatal", "origin": origin}


def invalid(rules: Sequence[Rule], command: str) -> list[dict]:
    """Fatal rows for expressions that cannot be read; any of them stops the operation."""
    out = []
    for k, r in enumerate(rules):
        try:
            wrong = problem(r.expression)
        except ValueError as e:
            wrong = (str(e), 0, 0)
        if wrong:
            out.append(_fatal(f"{r.xpath}: {wrong[0]} at {wrong[1]}", "xpath", command, k))
    return out


class Engine:
    """Operations over sources (doc_id, path, language, content); problems are rows that every report gets first (see diagnosed)."""

    def __init__(self, sources: DataFrame, problems: Sequence[str] = ()):
        self.sources, self.spark, self.problems = sources, sources.sparkSession, tuple(problems)

    @classmethod
    def of_files(cls, spark, patterns: Sequence[str], exclude: Sequence[str] = (), **options) -> Engine:
        """An engine over files; what is wrong with the patterns becomes fatal rows instead of an exception."""
        return cls(*diagnosed(spark, patterns, exclude, **options))

    def debug(self, xpaths, limit: int | None = None, **parsing) -> DataFrame:
        """file, matches, output: each source that matches, its matches marked; the limit runs on from file to file."""
        found = self.query(xpaths, limit, ("value",), **parsing).matches
        return marked_sources(self.sources, found)

    def _wrong(self, rules: Sequence[Rule], command: str) -> list[dict]:
        """Fatal rows that stop an operation: problems of the input, then expressions that cannot be read."""
        return [_fatal(p, "config", command) for p in self.problems] + invalid(rules, command)

    def _changed(self, hunks: DataFrame | None, changed: DataFrame | None) -> DataFrame:
        """Sources that changed; files without a changed line are left out before they are parsed."""
        out = self.sources if changed is None else diffs.only_changed(self.sources, changed)
        return out if hunks is None else diffs.only_changed(out, diffs.changed_files(hunks))

    def _matches(self, rules: Sequence[Rule], command: str, fields: Iterable[str], hunks: DataFrame | None, changed: DataFrame | None, **parsing) -> DataFrame:
        found = run_rules(self._changed(hunks, changed), rules, command, fields, **parsing)
        return found if hunks is None else diffs.in_hunks(found, hunks)

    def query(self, xpaths, limit: int | None = None, fields: Sequence[str] | str | None = None, hunks: DataFrame | None = None, changed: DataFrame | None = None, **parsing) -> Report:
        """Matches of expressions, in order, at most limit; no verdict."""
        rules = _as_rules(xpaths)
        shown = view("query", fields) if fields is None or isinstance(fields, str) else fields
        if wrong := self._wrong(rules, "query"):
            return Report(_diagnostics(self.spark, wrong), "query", derive=False)
        found = self._matches(rules, "query", shown, hunks, changed, **parsing)
        return Report(limited(found, limit), "query", derive=False, query="; ".join(r.expression for r in rules))

    def check(self, rules, fields: Sequence[str] | None = None, examples: bool = True, hunks: DataFrame | None = None, changed: DataFrame | None = None, **parsing) -> Report:
        """Matches of rules as problems; rules with examples are tried on them first. There is no limit."""
        rules = _as_rules(rules)
        if wrong := self._wrong(rules, "check"):
            return Report(_diagnostics(self.spark, wrong), "check")
        found = self._matches(rules, "check", DEFAULT_VIEW["check"] if fields is None else fields, hunks, changed, **parsing)
        if examples and any(r.valid or r.invalid for r in rules):
            found = found.unionByName(self.check_examples(rules))
        return Report(found, "check")

    def check_examples(self, rules: Sequence[Rule]) -> DataFrame:
        """Error rows for valid examples that match their rule and invalid ones that do not."""
        texts, known = [], []
        for k, r in enumerate(rules):
            for kind, own in (("valid", r.valid), ("invalid", r.invalid)):
                for text in own:
                    if not r.language:
                        return _diagnostics(self.spark, [_fatal(f"rule {r.id or r.xpath} has examples but no language", "config", "test", k)])
                    texts.append((None, r.language, text))
                    known.append((k, kind))
        examples = inline(self.spark, texts)
        every = run_rules(examples, [Rule(r.xpath, r.id, language=r.language, tree_mode=r.tree_mode) for r in rules], "test")
        table = self.spark.createDataFrame([(n, k, kind) for n, (k, kind) in enumerate(known)], "doc_id long, own int, kind string")
        counts = table.join(every.select("doc_id", "rule_index"), (every["doc_id"] == table["doc_id"]) & (every["rule_index"] == table["own"]), "left").groupBy(table["doc_id"], "own", "kind").agg(F.count("rule_index").alias("n"))
        failed = counts.where(F.when(F.col("kind") == "valid", F.col("n") > 0).otherwise(F.col("n") == 0))
        said = F.concat(F.lit("example that should "), F.when(F.col("kind") == "valid", "not match does").otherwise("match does not"))
        ids = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(k), F.lit(r.id))])
        fills = {"file": F.lit(""), "line": F.lit(1), "column": F.lit(1), "end_line": F.lit(1), "end_column": F.lit(1), "command": F.lit("test"), "rule_index": F.col("own"), "item_index": F.col("doc_id").cast("int"), "reason": said, "severity": F.lit("error"), "rule_id": F.element_at(ids, F.col("own")), "doc_id": F.col("doc_id")}
        kinds = dict(c.strip().split(" ", 1) for c in SCHEMA.replace("`", "").split(", "))
        return failed.select(*[fills.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])

    def test(self, assertions: Sequence[tuple[str, str | int]], limit: int | None = None, fields: Sequence[str] = (), **parsing) -> Report:
        """Matches of assertions, each compared with what is expected of its count after the limit."""
        rules = [Rule(x) for x, _ in assertions]
        if wrong := self._wrong(rules, "test"):
            return Report(_diagnostics(self.spark, wrong), "test")
        found = run_rules(self.sources, rules, "test", fields, **parsing)
        if limit is not None:
            parts = [limited(found.where(F.col("rule_index") == k), limit) for k in range(len(rules))]
            found = reduce(DataFrame.unionByName, parts)
        counts = {r["rule_index"]: r["count"] for r in found.groupBy("rule_index").count().collect()}
        one = self.spark.range(1)
        flags = [expectation(F.lit(counts.get(k, 0)), e) for k, (_, e) in enumerate(assertions)]
        failed = not one.select(reduce(lambda a, b: a & b, flags).alias("ok")).first()["ok"] if flags else False
        return Report(found, "test", failed=failed, expected=", ".join(str(e) for _, e in assertions))

    def set(self, mappings: str | Mapping | Sequence[Mapping], value: str | None = None, verify: bool = False, **options) -> Report:
        """Updates or inserts values; output holds the new texts. With verify a source that would change is a failure."""
        if isinstance(mappings, str):
            mappings = declared(mappings, value)
        changed = mutate(self.sources, [mappings] if isinstance(mappings, Mapping) else mappings, "set", **options)
        # looked at twice, so it is written once
        changed = settle(changed, "changed") if verify else changed
        failed = bool(verify and changed.where("status = 'updated'").limit(1).count())
        return Report(changed, "set", failed=failed)

    def update(self, xpath: str, value: str, **options) -> Report:
        """Sets values of nodes that exist; it fails if there are none."""
        changed = settle(mutate(self.sources, [Mapping(xpath, value)], "update", **options), "changed")
        return Report(changed, "update", failed=not changed.where("status = 'updated'").limit(1).count())

    def run(self, operations: Sequence[configs.Operation] | str, changed_by: dict[str, DataFrame] | None = None) -> Report:
        """All operations of a configuration in order; texts that a set changes are what later ones see."""
        if isinstance(operations, str):
            operations = configs.parse(operations)
        sources, reports = self.sources, []
        for op in operations:
            own = scoped(sources, op.files, op.exclude, op.root_files)
            for spec in [*op.diff_files, *op.diff_lines]:
                if changed_by and spec in changed_by:
                    own = diffs.only_changed(own, changed_by[spec])
            s, engine = op.settings, Engine(own)
            parsing = {"mode": s["tree-mode"]} if s.get("tree-mode") else {}
            if op.kind == "check":
                reports.append(engine.check([_rule(r) for r in s.get("rules") or []], ("lines", "source"), **parsing))
            elif op.kind == "query":
                reports.append(engine.query([q["xpath"] for q in s.get("queries") or []], s.get("limit"), ("lines",), **parsing))
            elif op.kind == "test":
                reports.append(engine.test([(a["xpath"], a.get("expect", "some")) for a in s.get("assertions") or []], s.get("limit"), ("lines",), **parsing))
            else:
                mappings = [Mapping(m["xpath"], str(m["value"]), m.get("value-kind"), s.get("limit")) for m in s.get("mappings") or []]
                if s.get("expression"):
                    mappings += declared(s["expression"], None if s.get("value") is None else str(s["value"]))
                done = engine.set(mappings, verify=bool(s.get("verify")))
                if not s.get("verify"):
                    done.matches = settle(done.matches, "changed")
                reports.append(done)
                new = done.matches.select("doc_id", F.col("output").alias("_new"))
                sources = sources.join(new, "doc_id", "left").withColumn("content", F.coalesce("_new", "content")).drop("_new")
        if not reports:
            return Report(_diagnostics(self.spark, []), "run")
        every = [r.matches.withColumn("rule_index", F.col("rule_index") + 1000 * k) for k, r in enumerate(reports)]
        return Report(reduce(DataFrame.unionByName, every), "run", failed=any(r.failed for r in reports), derive=any(r.derive for r in reports))


def _rule(r: dict) -> Rule:
    examples = r.get("expect") or []
    listed = lambda v: tuple(v) if isinstance(v, list) else (v,) if v else ()
    return Rule(
        r["xpath"], r.get("id"), r.get("reason"), r.get("severity", "error"), r.get("message"), listed(r.get("include")), listed(r.get("exclude")), r.get("language"), r.get("tree-mode"),
        tuple(e["valid"] for e in examples if "valid" in e), tuple(e["invalid"] for e in examples if "invalid" in e),
    )


def git_changes(spark, folder: str, spec: str) -> tuple[DataFrame, DataFrame]:
    """Changed paths and changed line ranges of a git working tree against a revision."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True).stdout
    names = git("diff", "--name-only", "--diff-filter=ACMR", spec).splitlines()
    paths = spark.createDataFrame([(n,) for n in names], "path string")
    diff = spark.createDataFrame([(git("diff", "-U0", spec),)], "diff string")
    return paths, diffs.hunks_of_diff(diff)


