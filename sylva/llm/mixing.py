"""Mixing sources to target weights (operator 9): weighted fair queueing.

Each source is a queue: its documents in a shuffled order, the whole queue once for each allowed
pass. A source is served at the rate of its target, so a copy has the virtual start and finish times
(words queued before it) / target and (words up to its end) / target. All copies of all sources are sorted by range of
finish; running sums over that order say how many words were given before each copy, and the mix ends where the
total budget is spent. At virtual time 1 each source has been given its target, so the one copy of a source that time 1
falls into gives only the words before it.

Running sums never put a source into one task: rows that are equal in id, source and size are counted first and stay one row of the
queue, a source is divided into buckets of the shuffle key, bucket sums are added up first, and rows are summed inside their
bucket. Counted rows are opened in parts of OPEN again. The sorted copies are summed inside their
range, ranges first. The windows over all sources, buckets of a source and ranges hold one row for each.

Defined results: null text has size 0 and is never taken; a null source is a source, ordered last;
with no words at all every target is 0; rows with equal ids are ordered by size and share their
digest key, rows without an id have a key of their size, and each row is returned; a very long text is one document like any other; an empty table gives no rows; columns other than doc_id, source and
text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, n_words, settle

#: Rows of one source that one task sums at most, about.
BUCKET_ROWS = 50_000
#: Equal rows that are opened at once.
OPEN = 10_000
#: Rows of a file of the tables written on the way, at least: an executor's buffers outside the heap grow with the files it reads.
FILE_ROWS = 100_000


def source_targets(sources: DataFrame, weights: Sequence[int], share: float, limit: int) -> DataFrame:
    """source, source_size, target: share of all words by weight, no source above limit times its size.

    Capped sources come first by size / weight; the level is the first at which the next one fits.
    The windows run over one row per source.
    """
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("k", F.row_number().over(order)).withColumn("w", w.cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), "k")
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_from", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("level", (F.lit(share) * F.col("all_size") - F.lit(limit) * F.col("size_before")) / F.col("w_from"))
        .withColumn("fits", F.col("level") * F.col("w") <= F.lit(float(limit)) * F.col("source_size"))
    )
    rows = rows.withColumn("first_fit", F.min(F.when(F.col("fits"), F.struct((F.col("source_size") / F.col("w")).alias("ratio"), "k", "level"))).over(everything))
    target = F.when(F.col("first_fit").isNull(), F.lit(float(limit)) * F.col("source_size")).otherwise(
        F.least(F.lit(float(limit)) * F.col("source_size"), F.col("first_fit.level") * F.col("w"))
    )
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _files(rows: int) -> int:
    return max(12, rows // FILE_ROWS)


def _queues(docs: DataFrame, weights: Sequence[int], share: float, limit: int) -> DataFrame:
    """doc_id, source, size, key, rows, source_size, target, all_size, before: counted rows with the words queued before them in their source."""
    counted = docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("size "), F.col("size").cast("string"))))
    counted = settle(counted.withColumn("key", key), "mix-sizes", _files(docs.count()))
    total, digits = counted.count(), 1
    while 16**digits * BUCKET_ROWS < total:
        digits += 1
    counted = counted.withColumn("bucket", F.substring("key", 1, digits)).withColumn("words", F.col("size") * F.col("rows"))
    sums = counted.groupBy("source", "bucket").agg(F.sum("words").alias("bucket_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, limit)
    targets = targets.withColumn("all_size", F.sum("source_size").over(Window.partitionBy()))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    offsets = offsets.alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source")).select("o.source", "o.bucket", "o.offset", "t.source_size", "t.target", "t.all_size")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    queued = counted.withColumn("within", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    queued = queued.alias("q").join(offsets.alias("o"), F.expr("q.source <=> o.source and q.bucket = o.bucket"))
    return queued.select("q.doc_id", "q.source", "q.size", "q.key", "q.rows", "o.source_size", "o.target", "o.all_size", (F.col("o.offset") + F.col("q.within")).alias("before"))


def fair_schedule(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, limit: int = 2) -> DataFrame:
    """doc_id, source, size, number, source_size, target, pass, start, finish, words: one row per copy in the queues, in the order of finish.

    number tells rows with the same id, source and size apart; words is what the mix takes of the copy.
    """
    files = _files(limit * docs.count())
    queued = settle(_queues(docs, weights, share, limit), "mix-queues", files)
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / OPEN))).alias("part")
    few, many = queued.where(F.col("rows") <= OPEN).select("*", F.lit(0).cast("long").alias("part")), queued.where(F.col("rows") > OPEN).select("*", part)
    parts = few.unionByName(many.repartition("key", "part")).withColumn("first", F.col("part") * OPEN)
    opened = parts.withColumn("number", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + OPEN, "rows") - 1)))
    copies = opened.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))))
    end = F.col("pass") * F.col("source_size") + F.col("before") + F.col("size") * (F.col("number") + 1)
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target") + 0.5) - (end - F.col("size"))))
    timed = copies.select(
        "doc_id", "source", "size", "number", "source_size", "target", "all_size", "key", "pass",
        F.when(F.col("target") > 0, (end - F.col("size")) / F.col("target")).alias("start"),
        F.when(F.col("target") > 0, end / F.col("target")).alias("finish"),
        words.cast("long").alias("due"),
    )
    order = ["finish", F.col("source").asc_nulls_last(), "pass", "key", "doc_id", "size", "number"]
    ranged = settle(timed.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-order", files)
    discard(queued)
    sums = ranged.groupBy("range").agg(F.sum("due").alias("due"))
    given = sums.select("range", F.coalesce(F.sum("due").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("given"))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    served = ranged.withColumn("within", F.coalesce(F.sum("due").over(inside), F.lit(0))).join(given, "range")
    left = F.ceil(F.lit(share) * F.col("all_size")) - F.col("given") - F.col("within")
    taken = F.greatest(F.lit(0), F.least(F.col("due"), left)).cast("long")
    return served.select("doc_id", "source", "size", "number", "source_size", "target", "pass", "start", "finish", taken.alias("words"))


def taken_words(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, limit: int = 2) -> DataFrame:
    """doc_id, source, size, number, source_size, target, taken: one row for each row of docs."""
    copies = fair_schedule(docs, weights, share, limit)
    return copies.groupBy("doc_id", "source", "size", "number", "source_size", "target").agg(F.sum("words").alias("taken"))
