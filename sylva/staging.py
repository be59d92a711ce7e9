"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in spark.checkpoint.dir; a folder of our own is set only for a
    session in which the setting is missing and everything runs in one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    own = "file://" + tempfile.mkdtemp(prefix="sylva-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def settle(df: DataFrame, name: str, files: int | None = None, codec: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut, lost executors cost nothing.

    files is the most files to write, where many small partitions are likely; codec zstd makes texts smaller.
    """
    spark = df.sparkSession
    if files is not None:
        df = df.coalesce(files)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    files, jvm_path = _place(spark, path)
    files.deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that is deleted when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, jvm_path = _place(spark, path)
    files.mkdirs(jvm_path)
    files.deleteOnExit(jvm_path)
    return path


def _place(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it knows it."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing is read from any more; other DataFrames are left alone."""
    for t in tables:
        if path := t.__dict__.get("settled_at"):
            files, jvm_path = _place(t.sparkSession, path)
            files.delete(jvm_path, True)
