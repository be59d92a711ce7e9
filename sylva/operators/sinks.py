"""Sinks: matches as lines for people and CI, and as report documents."""

from __future__ import annotations

import json
import xml.sax.saxutils as xs
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import gutter
from .matching import ORDER
from .reports import grouped, totals, verdict

#: Fields a view can show, and what each command shows by default (fixed values).
FIELDS = ("file", "line", "column", "end_line", "end_column", "command", "rule_id", "value", "source", "lines", "tree", "reason", "severity", "message", "origin", "status", "output")
DEFAULT_VIEW = {
    "query": ("file", "line", "tree"),
    "check": ("reason", "severity", "lines"),
    "test": (),
    "set": ("file", "line", "status", "reason"),
    "update": ("file", "line", "status", "reason"),
    "run": ("command", "reason", "severity", "lines", "status", "value"),
}
PROJECTIONS = ("tree", "value", "source", "lines", "schema", "count", "summary", "totals", "results", "report")


class ViewError(ValueError):
    pass


class ReportError(ValueError):
    """A report that does not fit one document."""


#: Matches that one report document holds at most; larger results are saved as lines.
MAX_MATCHES = 200_000


def view(command: str, spec: str | None = None) -> tuple[str, ...]:
    """The fields that a spec asks for: a list, or + and - on the default."""
    if spec is None:
        return DEFAULT_VIEW[command]
    words = [w.strip() for w in spec.split(",") if w.strip()]
    signed = [w for w in words if w[0] in "+-"]
    names = [w.lstrip("+-") for w in words]
    if bad := [n for n in names if n not in FIELDS]:
        raise ViewError(f"unknown field {bad[0]}")
    if not signed:
        return tuple(dict.fromkeys(names))
    if len(signed) != len(words):
        raise ViewError("a list of fields and changes to the default cannot be mixed")
    out = list(DEFAULT_VIEW[command])
    for w in words:
        name = w[1:]
        if w[0] == "+" and name not in out:
            out.append(name)
        elif w[0] == "-" and name in out:
            out.remove(name)
    if not out:
        raise ViewError("no fields are left")
    return tuple(out)


def detail() -> Column:
    return F.coalesce("message", "reason", "value", F.lit(""))


def gcc_lines(matches: DataFrame) -> DataFrame:
    """file:line:column: severity: text, in report order fields."""
    head = F.format_string("%s:%d:%d: %s: %s", F.col("file"), F.col("line"), F.col("column"), F.coalesce("severity", F.lit("error")), detail())
    return matches.select(*ORDER, head.alias("text"))


def github_lines(matches: DataFrame) -> DataFrame:
    """Workflow annotations; percent signs and line ends are escaped."""
    said = F.replace(F.replace(F.replace(detail(), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    level = F.when(F.col("severity") == "warning", "warning").when(F.col("severity") == "info", "notice").otherwise("error")
    head = F.format_string("::%s file=%s,line=%d,endLine=%d,col=%d,endColumn=%d::%s", level, F.col("file"), F.col("line"), F.col("end_line"), F.col("column"), F.col("end_column"), said)
    return matches.select(*ORDER, head.alias("text"))


def json_lines(matches: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One JSON object per match, null fields left out."""
    return matches.select(*ORDER, F.to_json(F.struct(*fields)).alias("text"))


def summary_text(total: dict) -> str:
    """Fatals, errors, warnings and updates in words."""
    parts = []
    for key, one in (("fatals", "fatal"), ("errors", "error"), ("warnings", "warning")):
        n = total[key]
        if n and not (key == "warnings" and total["errors"]):
            parts.append(f"{n} {one}{'s' if n != 1 else ''}")
    files = f"in {total['files']} file{'s' if total['files'] != 1 else ''}"
    if total["updated"]:
        parts.append(f"updated {total['updated']}")
    return f"{', '.join(parts)} {files}" if parts else ""


class Report:
    """What an operation gives: matches, totals and verdict, and their renderings.

    matches stays a DataFrame. The documents made here hold at most MAX_MATCHES of them, else ReportError;
    lines and save have no such limit, their rows stay distributed.
    """

    def __init__(self, matches: DataFrame, command: str, failed: bool = False, derive: bool = True, expected: str | None = None, query: str | None = None):
        self.matches, self.command, self.failed, self.derive, self.expected, self.query = matches, command, failed, derive, expected, query

    def rows(self) -> list:
        """All matches in report order, on the driver."""
        found = self.matches.orderBy(*ORDER).limit(MAX_MATCHES + 1).collect()
        if len(found) > MAX_MATCHES:
            raise ReportError(f"more than {MAX_MATCHES} matches; save them as lines")
        return found

    def lines(self, kind: str = "gcc", fields: Sequence[str] = FIELDS) -> DataFrame:
        """The report as lines of text (gcc, github or json), in order."""
        made = {"gcc": gcc_lines, "github": github_lines}.get(kind)
        if made is None and kind != "json":
            raise ViewError(f"no lines of kind {kind}")
        out = made(self.matches) if made else json_lines(self.matches, fields)
        return out.orderBy(*ORDER).select("text")

    def save(self, path: str, kind: str = "json", fields: Sequence[str] = FIELDS) -> None:
        """Writes the lines below a path, part after part in report order."""
        self.lines(kind, fields).write.text(path)

    def totals(self) -> DataFrame:
        return verdict(totals(self.matches), self.failed, self.derive)

    def summary(self) -> dict:
        row = self.totals().first().asDict()
        out = {"success": row["success"], "totals": {k: v for k, v in row.items() if k != "success" and (v or k in ("results", "files"))}}
        if self.expected is not None:
            out["expected"] = str(self.expected)
        if self.query is not None:
            out["query"] = self.query
        return out

    def exit_status(self, single: bool = False) -> int:
        s = self.summary()
        return int(s["success"] is False or (single and not s["totals"]["results"]))

    def grouped(self, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
        return grouped(self.matches, by, fields)

    def envelope(self, fields: Sequence[str], by: Sequence[str] = (), show_summary: bool | None = None) -> dict:
        """The report as nested data: summary, group, results, captured outputs."""
        shown = [f for f in fields if f in FIELDS]
        extra = [f for f in ("severity", "reason", "origin", "lines") if f not in shown]
        rows = [r.asDict(recursive=True) for r in self.rows()]
        outputs = [{"file": r["file"], "content": r["output"]} for r in rows if r.get("output") is not None and "output" not in shown]

        def one(r: dict, skip: Sequence[str]) -> dict:
            out = {}
            for f in [*shown, *extra]:
                if f not in skip and r.get(f) is not None and not (f in extra and r.get("severity") != "fatal"):
                    out[f] = json.loads(r[f]) if f == "tree" else r[f]
            if r["item_type"] in ("map", "array") and r.get("tree"):
                out["tree"] = json.loads(r["tree"])
            return out

        def nest(part: list[dict], k: int) -> list[dict]:
            if k == len(by):
                return [one(r, by) for r in part]
            keys: dict = {}
            for r in part:
                keys.setdefault(r[by[k]], []).append(r)
            out = []
            for key, own in keys.items():
                if not key and by[k] != "file":
                    out += nest(own, k + 1)
                else:
                    group = {by[k]: key} | ({"group": by[k + 1]} if k + 1 < len(by) else {})
                    # a file's only output stands in its group, which names the file already
                    mine = [o for o in outputs if o["file"] == key] if by[k] == "file" else []
                    if len(mine) == 1:
                        outputs.remove(mine[0])
                        group["output"] = mine[0]["content"]
                    out.append(group | {"results": nest(own, k + 1)})
            return out

        out: dict = {}
        if show_summary or (show_summary is None and self.derive):
            out["summary"] = self.summary()
        if by:
            out["group"] = by[0]
        results = nest(rows, 0)
        if outputs:
            out["outputs"] = outputs
        return out | {"results": results}

    def to_json(self, fields: Sequence[str], by: Sequence[str] = (), **options) -> str:
        return json.dumps(self.envelope(fields, by, **options), indent=2, ensure_ascii=False)

    def to_yaml(self, fields: Sequence[str], by: Sequence[str] = (), **options) -> str:
        import yaml

        return yaml.safe_dump(self.envelope(fields, by, **options), sort_keys=False, allow_unicode=True)

    def to_xml(self, fields: Sequence[str], by: Sequence[str] = ("file",)) -> str:
        data = {"summary": self.summary()} if self.derive else {}
        rows = [r.asDict(recursive=True) for r in self.rows()]
        out = ['<?xml version="1.0" encoding="UTF-8"?>', "<report>"]
        if "summary" in data:
            s = data["summary"]
            out += ["  <summary>", *([f"    <success>{str(s['success']).lower()}</success>"] if s["success"] is not None else []), "    <totals>"]
            out += [f"      <{k}>{v}</{k}>" for k, v in s["totals"].items()]
            out += ["    </totals>", "  </summary>"]
        if by:
            out.append(f"  <group-by>{by[0]}</group-by>")
        out.append("  <results>")

        def put(r: dict, pad: str) -> None:
            place = " ".join(f'{k}="{r[k]}"' for k in ("line", "column", "end_line", "end_column"))
            file = f" file={xs.quoteattr(r['file'])}" if "file" in fields and not by else ""
            out.append(f"{pad}<match{file} {place}>")
            for f in fields:
                if f == "lines" and r.get(f):
                    out.extend([f"{pad}  <lines>", *[f"{pad}    <line>{xs.escape(x)}</line>" for x in r[f]], f"{pad}  </lines>"])
                elif f not in ("file", "line", "column", "end_line", "end_column") and r.get(f) is not None:
                    out.append(f"{pad}  <{f}>{xs.escape(str(r[f]))}</{f}>")
            out.append(f"{pad}</match>")

        groups: dict = {}
        for r in rows:
            groups.setdefault(r[by[0]] if by else None, []).append(r)
        for key, own in groups.items():
            if by:
                out.append(f"    <group {by[0]}={xs.quoteattr(key or '')}>")
            for r in own:
                put(r, "      " if by else "    ")
            if by:
                out.append("    </group>")
        return "\n".join([*out, "  </results>", "</report>"])

    def to_gcc(self) -> str:
        blocks = []
        for r in self.rows():
            head = f"{r['file']}:{r['line']}:{r['column']}: {r['severity'] or 'error'}: {r['message'] or r['reason'] or r['value'] or ''}"
            body = gutter(r["lines"] or [], r["line"], r["column"], r["end_column"])
            blocks.append(head + ("\n" + body if body else ""))
        end = summary_text(self.totals().first().asDict())
        return "\n\n".join(blocks + ([end] if end else []))

    def to_text(self, fields: Sequence[str]) -> str:
        """Matches as blocks of their fields, a place first where it is shown."""
        blocks = []
        for r in self.rows():
            rows = []
            if "file" in fields:
                rows.append(r["file"] + (f":{r['line']}" if "line" in fields else "") + (f":{r['column']}" if "column" in fields else ""))
            if r["severity"] and ("severity" in fields or r["severity"] == "fatal"):
                rows.append(f"{r['severity']}: {r['message'] or r['reason'] or ''}")
            elif "reason" in fields and r["reason"]:
                rows.append(r["reason"])
            for f in fields:
                if f == "lines" and r["lines"]:
                    rows.append(gutter(r["lines"], r["line"], r["column"], r["end_column"]))
                elif f in ("value", "source", "tree", "status", "output", "command", "rule_id", "message") and r[f] is not None:
                    rows.append(r[f])
            blocks.append("\n".join(rows))
        return "\n\n".join(blocks)

    def to_hook(self, kind: str = "post-tool-use") -> str:
        """The JSON that a hook answers with: nothing on success, else the gcc text in the envelope of its kind."""
        if self.exit_status() == 0:
            return ""
        text = self.to_gcc()
        if kind == "pre-tool-use":
            return json.dumps({"hookSpecificOutput": {"hookEventName": "PreToolUse", "permissionDecision": "deny", "permissionDecisionReason": text}})
        if kind == "session-start":
            return json.dumps({"hookSpecificOutput": {"hookEventName": "SessionStart", "additionalContext": text}})
        return json.dumps({"decision": "block", "reason": text})

    def project(self, name: str, single: bool = False):
        """Another end of the report: a DataFrame of one column, or a number."""
        if name not in PROJECTIONS:
            raise ViewError(f"unknown projection {name}")
        if single and name not in ("tree", "value", "source", "lines", "results"):
            raise ViewError(f"{name} is no sequence")
        if name == "count":
            return self.matches.count()
        if name in ("summary", "totals"):
            return self.summary() if name == "summary" else self.summary()["totals"]
        if name == "report":
            return self
        out = self.matches.orderBy(*ORDER)
        out = out.limit(1) if single else out
        return out if name == "results" else out.select(name)
