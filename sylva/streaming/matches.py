"""Matching over a stream of sources: stateless, so every batch is matched as it comes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.matching import run_rules
from ..operators.rules import Rule
from ..staging import shared_dir


def match_stream(sources: DataFrame, rules: Sequence[Rule], command: str = "query", **options) -> DataFrame:
    """The streaming DataFrame of matches, for any sink."""
    return run_rules(sources, rules, command, **options)


def stream_matches(sources: DataFrame, rules: Sequence[Rule], command: str = "query", **options) -> DataFrame:
    """Runs a stream over all that is there now into a table of the shared folder, and reads it.

    The Parquet sink keeps a log of batches, so a batch that is run again is not there twice.
    """
    spark = sources.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    found = match_stream(sources, rules, command, **options)
    run = found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(found.schema).parquet(f"{folder}/rows")
