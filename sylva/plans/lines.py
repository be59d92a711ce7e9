"""Rules over lines of plain text as Catalyst expressions: no row of such a text goes through Python.

A text's tree has one line element for each line, so a rule such as //line[contains(., 'x')] is a filter of its lines. Texts are split into
lines once for all rules, each line is tested for all of them in one compiled expression, and only lines that some rule finds go on.
The place of a match among its rule's in a text is a window over matches, and is not computed where nobody asks for it.
Predicates of strings, lengths and literals are taken; any other rule is left to the interpreter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import message_column
from .typed import Compiler, Value
from .xpath import parse

_ANY = ("axis", "descendant-or-self", ("kind", "node", None), ())
_DOCUMENT = ("axis", "child", ("name", "document"), ())
_TEXT_TESTS = ("contains", "starts-with", "ends-with")


def _is_text(e: tuple) -> bool:
    if e[0] == "paren":
        return _is_text(e[1])
    if e[0] == "call" and e[1] in ("string", "lower-case", "upper-case", "normalize-space"):
        return all(map(_is_text, e[2]))
    return e == ("context",) or (e[0] == "lit" and isinstance(e[1], str))


def _is_number(e: tuple) -> bool:
    return (e[0] == "lit" and isinstance(e[1], int) and not isinstance(e[1], bool)) or (e[0] == "call" and e[1] == "string-length" and all(map(_is_text, e[2])))


def _is_test(e: tuple) -> bool:
    """Whether an expression is a truth value that means the same here as in the interpreter."""
    if e[0] == "paren":
        return _is_test(e[1])
    if e[0] == "call":
        if e[1] in _TEXT_TESTS:
            return len(e[2]) == 2 and all(map(_is_text, e[2]))
        return e[1] in ("true", "false") or (e[1] == "not" and _is_test(e[2][0]))
    if e[0] == "op":
        if e[1] in ("and", "or"):
            return _is_test(e[2]) and _is_test(e[3])
        if e[1] in ("=", "!="):
            return all(map(_is_text, e[2:4])) or all(map(_is_number, e[2:4]))
        return e[1] in ("<", "<=", ">", ">=") and all(map(_is_number, e[2:4]))
    return False


def predicates(expression: str) -> tuple | None:
    """The predicates of an expression that selects lines of a text, or None if it is another one."""
    try:
        e = parse(expression)
    except ValueError:
        return None
    if e[0] != "path" or not e[1] or len(e[2]) != 2 or e[2][0] not in (_ANY, _DOCUMENT):
        return None
    step = e[2][1]
    if step[:3] != ("axis", "child", ("name", "line")) or not all(map(_is_test, step[3])):
        return None
    return step[3]


def _needed(e: tuple) -> list[str]:
    """Literals that a text must hold for the test to be true of one of its lines."""
    if e[0] == "paren":
        return _needed(e[1])
    if e[0] == "op" and e[1] == "and":
        return _needed(e[2]) + _needed(e[3])
    if e[0] == "call" and e[1] in _TEXT_TESTS and e[2][0] == ("context",) and e[2][1][0] == "lit":
        return [e[2][1][1]]
    return []


def matched_lines(texts: DataFrame, rules: Sequence[tuple[int, object, tuple]], command: str, wanted: frozenset, schema: str) -> DataFrame:
    """Matches of (index, rule, predicates) over sources of plain text, in the columns of schema."""
    line_value = Value(F.col("text"), T.StringType())

    def holds(tests: tuple) -> Column:
        return reduce(lambda a, b: a & b, [Compiler(line_value).test(t, line_value) for t in tests], F.lit(True))

    applies = [r.applies(F.col("path"), F.col("language")) for _, r, _ in rules]
    may = [reduce(lambda a, b: a & b, [F.col("content").contains(w) for t in tests for w in _needed(t)], F.lit(True)) & here for here, (_, _, tests) in zip(applies, rules, strict=True)]
    rows = texts.where(F.col("content").isNotNull()).where(reduce(lambda a, b: a | b, may))
    split = F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n", -1)
    rows = rows.select("doc_id", "path", "language", F.posexplode(split).alias("place", "text"))
    found = [here & holds(tests) for here, (_, _, tests) in zip(applies, rules, strict=True)]
    if len(rules) == 1:
        rows = rows.where(found[0]).withColumn("rule", F.lit(rules[0][0]))
    else:
        rows = rows.where(reduce(lambda a, b: a | b, found)).withColumn("rule", F.explode(F.array(*[F.when(x, F.lit(k)) for x, (k, _, _) in zip(found, rules, strict=True)]))).where("rule is not null")
    item = F.dense_rank().over(Window.partitionBy("doc_id", "path", "rule").orderBy("place")) - 1
    rows = rows.select("doc_id", "path", F.struct("text", (F.col("place") + 1).alias("line"), "rule", item.alias("item")).alias("m"))
    text, line, one = F.col("m.text"), F.col("m.line"), F.lit(1)

    def by_rule(value) -> Column:
        """A value of the match's rule."""
        return reduce(lambda c, r: c.when(F.col("m.rule") == r[0], value(r[1])), rules, F.when(F.lit(False), F.lit(None)))

    own = {
        "doc_id": F.col("doc_id"), "file": F.col("path"), "line": line, "column": one, "end_line": line, "end_column": F.octet_length(text) + 1, "command": F.lit(command),
        "rule_id": by_rule(lambda r: F.lit(r.id)), "rule_index": F.col("m.rule"), "item_index": F.col("m.item"), "item_type": F.lit("node"), "value": text,
        "message": by_rule(lambda r: message_column(r.message, text, line, one, F.col("path")) if r.message else F.lit(None)),
    }
    if "source" in wanted:
        own["source"] = F.regexp_replace(text, "\r$", "")
    if "lines" in wanted:
        own["lines"] = F.array(F.regexp_replace(text, "\r$", ""))
    if command == "check":
        own |= {"reason": by_rule(lambda r: F.lit(r.said)), "severity": by_rule(lambda r: F.lit(r.severity))}
    kinds = [c.split(" ", 1) for c in schema.split(", ")]
    return rows.select(*[own.get(n.strip("`"), F.lit(None)).cast(t).alias(n.strip("`")) for n, t in kinds])
