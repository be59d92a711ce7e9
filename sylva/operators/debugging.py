"""Sources with their matches marked, for looking at what an expression finds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tree_text import marked_source


def marked_sources(sources: DataFrame, matches: DataFrame) -> DataFrame:
    """file, matches, output: the whole text of each source with a match, the spans of its matches between marks."""
    spans = matches.where("severity is null").groupBy("doc_id").agg(F.collect_list(F.struct("line", "column", "end_line", "end_column")).alias("spans"))
    rows = sources.join(spans, "doc_id").select(F.col("path").alias("file"), F.size("spans").cast("long").alias("matches"), "content", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marked = [marked_source(c.as_py(), [tuple(s.values()) for s in own.as_py()]) for c, own in zip(b.column("content"), b.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("matches"), pa.array(marked, pa.string())], ["file", "matches", "output"])

    return rows.mapInArrow(run, "file string, matches long, output string")
