"""The command line: python -m sylva query|check|test|set|update|run|debug|render|languages|init|version."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from . import __version__

DEFAULT_CONFIG = "sylva.yaml"
#: What init writes: one rule that matches itself, to be replaced.
STARTER = """# Checks of this project; run them with: python -m sylva run
check:
  files: ["sylva.yaml"]
  rules:
    - id: first-rule
      xpath: "//check/rules[id='first-rule']"
      severity: warning
      reason: "replace this rule with your own"
"""


def starter(folder: str = ".", force: bool = False) -> Path:
    """Writes the starter configuration; an existing one is kept unless forced."""
    path = Path(folder) / DEFAULT_CONFIG
    if path.exists() and not force:
        raise FileExistsError(f"{path} exists already; --force overwrites it")
    path.write_text(STARTER)
    return path


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("sylva", description="Structural queries over semi-structured text.")
    verbs = out.add_subparsers(dest="verb", required=True)

    def verb(name: str, about: str, *, files: bool = True) -> argparse.ArgumentParser:
        p = verbs.add_parser(name, help=about, description=about)
        if files:
            p.add_argument("files", nargs="*", help="globs; none reads paths, or with --language a text, from standard input")
            p.add_argument("-l", "--language")
            p.add_argument("-s", "--string", help="a text instead of files")
            p.add_argument("--exclude", action="append", default=[])
            p.add_argument("-t", "--tree", choices=("data", "structure", "raw"), help="tree mode")
            p.add_argument("-W", "--ignore-whitespace", action="store_true")
            p.add_argument("-n", "--limit", type=int)
            p.add_argument("-v", "--view", help="fields, or changes such as +value,-tree")
            p.add_argument("-f", "--format", choices=("text", "json", "yaml", "xml", "gcc", "github"), default="text")
            p.add_argument("-g", "--group", action="append", default=[], choices=("file", "command", "rule_id"))
        return p

    p = verb("query", "matches of expressions")
    p.add_argument("-x", "--xpath", action="append", required=True)
    p.add_argument("-p", "--project")
    p.add_argument("--single", action="store_true")
    p = verb("check", "matches as problems")
    p.add_argument("-x", "--xpath", action="append", required=True)
    p.add_argument("--reason")
    p.add_argument("--severity", default="error", choices=("error", "warning", "info"))
    p.add_argument("--message")
    p = verb("test", "a count of matches against what is expected")
    p.add_argument("-x", "--xpath", required=True)
    p.add_argument("-e", "--expect", default="some", help="none, some or a number")
    for name, about in (("set", "sets or inserts values"), ("update", "sets values of what is there")):
        p = verb(name, about)
        p.add_argument("-x", "--xpath", required=True)
        p.add_argument("--value")
        p.add_argument("--stdout", action="store_true", help="print the new texts instead of replacing files")
    p = verb("debug", "whole texts with their matches marked")
    p.add_argument("-x", "--xpath", action="append", required=True)
    p = verb("run", "all operations of a configuration")
    p.add_argument("-c", "--config", default=DEFAULT_CONFIG)
    p = verb("render", "a tree given as XML or JSON on standard input as source", files=False)
    p.add_argument("-l", "--language", required=True)
    p.add_argument("--source", default="xml", choices=("xml", "json"))
    verb("languages", "the languages and their extensions", files=False)
    p = verb("init", "writes a starter configuration", files=False)
    p.add_argument("--force", action="store_true")
    verb("version", "the version", files=False)
    return out


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shown(report, args, command: str) -> str:
    """The report in the asked format."""
    from .operators.sinks import view

    fields = view(command, args.view)
    if args.format in ("json", "yaml"):
        return getattr(report, f"to_{args.format}")(fields, args.group)
    if args.format == "xml":
        return report.to_xml(fields, args.group[:1])
    if args.format == "github":
        return "\n".join(r["text"] for r in report.lines("github").collect())
    return report.to_gcc() if args.format == "gcc" or command == "check" else report.to_text(fields)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.verb == "version":
        print(__version__)
        return 0
    if args.verb == "init":
        print(f"created {starter('.', args.force)}")
        return 0
    if args.verb == "render":
        from .functions.rendering import render

        print(render(sys.stdin.read(), args.source, args.language))
        return 0
    spark = spark or session()
    if args.verb == "languages":
        from .sources.languages import languages_table

        for r in languages_table(spark).orderBy("language").collect():
            print(f"{r['language']:<12} {' '.join(r['extensions'])}")
        return 0
    from .operators.engine import Engine
    from .operators.mutation import replace_files
    from .operators.rules import Rule
    from .sources.documents import resolve_input
    from .sources.globs import absolute_path

    here = str(Path.cwd())
    files = [absolute_path(f, here) for f in args.files]
    if args.string is not None or not files:
        piped = sys.stdin.read() if args.string is None and args.verb != "run" else None
        if args.verb == "run":
            from .sources import config

            files = [absolute_path(f, here) for op in config.load(args.config) for f in op.files or op.root_files or ()]
            engine = Engine.of_files(spark, files, args.exclude)
        else:
            engine = Engine(resolve_input(spark, string=args.string, piped=piped, paths=files, language=args.language))
    else:
        engine = Engine.of_files(spark, files, args.exclude, language=args.language)
    parsing = {"mode": args.tree, "ignore_whitespace": args.ignore_whitespace}
    if args.verb == "debug":
        for r in engine.debug(args.xpath, args.limit, **parsing).orderBy("file").collect():
            print(f"{r['file']}\n{r['output']}")
        return 0
    if args.verb == "query":
        report = engine.query(args.xpath, args.limit, args.view, **parsing)
        if args.project:
            out = report.project(args.project, args.single)
            print("\n".join(str(r[0]) for r in out.collect()) if hasattr(out, "collect") else out)
            return report.exit_status(args.single)
    elif args.verb == "check":
        report = engine.check([Rule(x, None, args.reason, args.severity, args.message) for x in args.xpath], ("lines",), **parsing)
    elif args.verb == "test":
        report = engine.test([(args.xpath, args.expect)], args.limit, **parsing)
    elif args.verb == "run":
        report = engine.run(Path(args.config).read_text())
    else:
        report = engine.set(args.xpath, args.value) if args.verb == "set" else engine.update(args.xpath, args.value)
        if not args.stdout and args.string is None and files:
            replace_files(report.matches)
    if args.verb in ("set", "update") and args.stdout:
        print("".join(r["output"] or "" for r in report.rows()), end="")
    else:
        print(shown(report, args, args.verb))
    return report.exit_status()


if __name__ == "__main__":
    sys.exit(main())
