"""What the operators share: shared-folder tables, null-safe inputs, word splitting."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import discard, settle, shared_dir

__all__ = ["WORD", "ascii_lower", "crc_is", "discard", "drawn_rows", "first_drawn", "n_words", "received", "send", "settle", "shared_dir", "table"]

#: Words are runs of characters other than these (space and \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_is(id_col: str, n: int, rest: int) -> Column:
    """Whether crc32 of the id written as text leaves this rest by n; not so for a null id, which has none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % F.lit(n) == rest, F.lit(False))


def send(spark: SparkSession, model):
    """Broadcasts a model pickled by value, so that executors need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(sent):
    """The model of a broadcast, unpacked once for each worker."""
    if not hasattr(sent, "unpacked"):
        sent.unpacked = cloudpickle.loads(sent.value)
        sent.__dict__.pop("_value", None)  # the bytes would stay beside the model
    return sent.unpacked


def drawn_rows(rows: DataFrame, kind: str, counts: dict, draw: Column, most: int) -> DataFrame:
    """About a fifth more than so many rows of each kind, those whose draw (in the column drawn) is small; counts: rows of each kind.

    Rows of the same draw are copies and become one, before the shuffle and by draw, so no kind and no
    repeated row is one task's work. first_drawn cuts what the driver gets.
    """
    share = F.lit(1.0)
    for value, n in counts.items():
        share = F.when(F.col(kind) == value, F.lit(min(1.0, (1.2 * most + 50) / n))).otherwise(share)
    others = [c for c in rows.columns if c != kind]
    near = rows.withColumn("drawn", draw).where(F.pmod("drawn", F.lit(1_000_003)) < F.ceil(share * 1_000_003))
    return near.groupBy(kind, "drawn").agg(F.min(F.struct(*others)).alias("own")).select(kind, "drawn", "own.*")


def first_drawn(rows: list, kind: str, most: int) -> dict:
    """The rows of each kind with the smallest draws, in their order."""
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["drawn"] % 1_000_003, r["drawn"])):
        own = out.setdefault(r[kind], [])
        if len(own) < most:
            own.append(r)
    return out


def n_words(c: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
