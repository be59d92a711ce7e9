"""Diffs: changed files and changed line ranges, as tables."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HUNK_SCHEMA = "path string, first int, last int"


def hunks_of_diff(diff: DataFrame, text: str = "diff") -> DataFrame:
    """path, first, last: new-side line ranges of unified diffs (one whole diff per row); pure deletions have none."""
    whole = diff.select(F.monotonically_increasing_id().alias("diff"), F.split(text, "\n").alias("rows"))
    lines = whole.select("diff", F.posexplode("rows").alias("at", "line"))
    marked = lines.where(F.col("line").startswith("+++ ") | F.col("line").startswith("@@ "))
    file = F.when(F.col("line").startswith("+++ "), F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]*)", 1))
    before = Window.partitionBy("diff").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ranged = marked.withColumn("path", F.last(file, ignorenulls=True).over(before)).where(F.col("line").startswith("@@ "))
    first = F.regexp_extract("line", r"\+(\d+)", 1).cast("int")
    count = F.coalesce(F.expr(r"try_cast(regexp_extract(line, '\\+\\d+,(\\d+)', 1) as int)"), F.lit(1))
    return ranged.select("path", first.alias("first"), (first + count - 1).alias("last")).where(count > 0).where("path != '/dev/null'")


def hunks_between(spark: SparkSession, path: str, old: str, new: str) -> DataFrame:
    """Changed new-side ranges of one text against an older one."""
    rows = []
    matcher = difflib.SequenceMatcher(None, old.splitlines(), new.splitlines(), autojunk=False)
    for tag, _, _, first, last in matcher.get_opcodes():
        if tag in ("replace", "insert"):
            rows.append((path, first + 1, last))
    return spark.createDataFrame(rows, HUNK_SCHEMA)


def changed_files(hunks_or_paths: DataFrame) -> DataFrame:
    return hunks_or_paths.select("path").distinct()


def only_changed(sources: DataFrame, changed: DataFrame) -> DataFrame:
    """Sources whose path is among the changed ones; applied before parsing."""
    return sources.join(changed.select("path").distinct(), "path", "left_semi").select(sources.columns)


def in_hunks(matches: DataFrame, hunks: DataFrame) -> DataFrame:
    """Matches that overlap a changed range of their file."""
    h = hunks.select(F.col("path").alias("h_path"), "first", "last")
    overlap = (F.col("file") == F.col("h_path")) & (F.col("line") <= F.col("last")) & (F.col("end_line") >= F.col("first"))
    return matches.join(h, overlap, "left_semi")
