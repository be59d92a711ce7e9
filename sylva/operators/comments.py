"""Comments over the node table: runs of line comments on adjacent lines, and what they stand by.

The runs are gaps and islands over the comments of one parent; a run is leading if the next other
element begins on the line after it, trailing if the one before ends on its own line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def comment_blocks(nodes: DataFrame, element: str = "comment", sign: str = "//") -> DataFrame:
    """doc_id, line, end_line, text, comments, leading, trailing: one row per run of comments."""
    e = nodes.where("kind = 'element' and parent is not null").select("doc_id", "parent", "pre", "ord", "name", "line", "end_line", "string_value")
    siblings = Window.partitionBy("doc_id", "parent").orderBy("pre")
    is_comment, is_line = F.col("name") == element, F.col("string_value").startswith(sign)
    e = e.withColumn("_before", F.lag(F.struct("name", "string_value", "end_line")).over(siblings))
    joined = is_comment & is_line & (F.col("_before.name") == element) & F.col("_before.string_value").startswith(sign) & (F.col("_before.end_line") + 1 == F.col("line"))
    e = e.withColumn("_block", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(siblings))
    runs = e.groupBy("doc_id", "parent", "_block").agg(
        F.min("pre").alias("pre"), F.min("name").alias("name"), F.min("line").alias("line"), F.max("end_line").alias("end_line"), F.count("*").alias("comments"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "string_value"))), lambda r: r["string_value"]), "\n").alias("text"),
    )
    other = F.when(F.col("name") != element, F.struct("line", "end_line"))
    nxt = F.first(other, ignorenulls=True).over(siblings.rowsBetween(1, Window.unboundedFollowing))
    before = F.last(other, ignorenulls=True).over(siblings.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_next", nxt).withColumn("_last", before).where(is_comment)
    trailing = F.coalesce(F.col("_last.end_line") == F.col("line"), F.lit(False))
    leading = ~trailing & F.coalesce(F.col("_next.line") == F.col("end_line") + 1, F.lit(False))
    return runs.select("doc_id", "line", "end_line", "text", "comments", leading.alias("leading"), trailing.alias("trailing"))
