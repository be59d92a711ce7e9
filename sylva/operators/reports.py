"""Reports: totals, verdicts, expectations, groups and schemas of matches, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import ORDER

DIMENSIONS = ("file", "command", "rule_id")


def totals(matches: DataFrame) -> DataFrame:
    """One row: results, files, fatals, errors, warnings, infos, updated, unchanged."""
    of = lambda column, value: F.coalesce(F.count_if(F.col(column) == value), F.lit(0)).alias
    return matches.agg(
        F.count("*").alias("results"),
        F.countDistinct(F.when(F.col("file") != "", F.col("file"))).alias("files"),
        of("severity", "fatal")("fatals"), of("severity", "error")("errors"), of("severity", "warning")("warnings"), of("severity", "info")("infos"),
        of("status", "updated")("updated"), of("status", "unchanged")("unchanged"),
    )


def verdict(total: DataFrame, failed: Column | bool = False, derive: bool = True) -> DataFrame:
    """totals with success: derived from fatals, errors and failed, or null unless there are fatals."""
    failed = F.lit(failed) if isinstance(failed, bool) else failed
    derived = (F.col("fatals") == 0) & (F.col("errors") == 0) & ~failed
    return total.withColumn("success", derived if derive else F.when(F.col("fatals") > 0, F.lit(False)))


def expectation(count: Column, expect: str | int) -> Column:
    """Whether a count is as expected: none, some or a number."""
    if expect == "none":
        return count == 0
    if expect == "some":
        return count > 0
    return count == int(expect)


def expectations(matches: DataFrame, expected: Sequence[str | int]) -> DataFrame:
    """rule_index, results, expected, passed for each assertion, those without any match included."""
    spark = matches.sparkSession
    wanted = spark.createDataFrame([(k, str(e)) for k, e in enumerate(expected)], "rule_index int, expected string")
    counts = matches.groupBy("rule_index").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    passed = F.when(F.col("expected") == "none", n == 0).when(F.col("expected") == "some", n > 0).otherwise(n == F.col("expected").try_cast("bigint"))
    return wanted.join(F.broadcast(counts), "rule_index", "left").select("rule_index", n.alias("results"), "expected", passed.alias("passed"))


def grouped(matches: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Groups in first-seen order, each with its results in report order; several dimensions nest.

    A match without a key stays outside the groups of every dimension but file: its key is null.
    """
    for d in by:
        if d not in DIMENSIONS:
            raise ValueError(f"cannot group by {d}")
    keys = [F.when((F.col(d) != "") | F.lit(d == "file"), F.coalesce(d, F.lit("") if d == "file" else F.lit(None))).alias(d) for d in by]
    order = F.struct(*ORDER)
    shown = F.struct(*[f for f in fields if f not in by])
    out = matches.select(*keys, order.alias("_order"), shown.alias("_shown"))
    for k in range(len(by), 0, -1):
        rows = F.sort_array(F.collect_list(F.struct("_order", "_shown")))
        out = out.groupBy(*by[:k]).agg(F.min("_order").alias("_first"), rows.alias("_rows"))
        inner = F.transform("_rows", lambda r: r["_shown"]).alias("results")
        out = out.select(*by[:k], F.col("_first").alias("_order"), inner)
        if k > 1:
            out = out.select(*by[: k - 1], "_order", F.struct(by[k - 1], "results").alias("_shown"))
    return out.orderBy("_order").drop("_order")


def schema_paths(nodes: DataFrame, most: int = 5) -> DataFrame:
    """path, count, n_values and the first values of each path of elements of a node table.

    Values are distinct trimmed own texts, first seen first, at most so many; n_values counts them all. Counts and
    values are aggregated by path before they are shuffled, and the first values are cut in every partition.
    """
    counts = nodes.where("kind = 'element'").groupBy("path").agg(F.count("*").alias("count"))
    text = nodes.where("kind = 'text'").select("path", "doc_id", "pre", F.trim("text").alias("own")).where("own != '' and path is not null")
    values = text.groupBy("path", "own").agg(F.min(F.struct("doc_id", "pre")).alias("first"))
    numbers = values.groupBy("path").agg(F.count("*").alias("n_values"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("first", "own"))
    firsts = values.withColumn("place", place).where(F.col("place") <= most).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("place", "own"))).alias("held"))
    out = counts.join(numbers, "path", "left").join(firsts, "path", "left")
    none = F.array().cast("array<string>")
    return out.select("path", "count", F.coalesce("n_values", F.lit(0)).cast("long").alias("n_values"), F.coalesce(F.transform("held", lambda r: r["own"]), none).alias("values"))


def grouped_rows(matches: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The rows of grouped without arrays, so that a group of any size stays divisible: keys, first (where the group begins), fields, in report order."""
    for d in by:
        if d not in DIMENSIONS:
            raise ValueError(f"cannot group by {d}")
    first = matches.groupBy(*by).agg(F.min(F.struct(*ORDER)).alias("first"))
    same = F.expr(" and ".join(f"m.{d} <=> g.{d}" for d in by))
    rows = matches.alias("m").join(first.alias("g"), same).select(*[f"m.{d}" for d in by], "g.first", *[F.col(f"m.{f}") for f in dict.fromkeys((*ORDER, *fields)) if f not in by])
    return rows.orderBy("first", *[c for c in ORDER if c not in by])


def schema_text(rows: list, depth: int = 4, most: int = 5) -> str:
    """The schema table of a corpus as an indented tree."""
    by_path = {r["path"]: r for r in rows}
    out = []
    for path in sorted(by_path):
        level = path.count("/")
        if level >= depth:
            continue
        values, n = list(by_path[path]["values"])[:most], by_path[path]["n_values"]
        shown = ", ".join(f'"{v}"' for v in values) + (f", … (+{n - len(values)})" if n > len(values) else "")
        out.append("  " * level + f"{path.rpartition('/')[2]} ({by_path[path]['count']})" + (f" = {shown}" if values else ""))
    return "\n".join(out)
