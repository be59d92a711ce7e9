"""Connected components: parts contract their own edges, what stays large goes through alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


#: Edges in one file, at least; rows of one key that are no longer joined by a shuffle, at least, and the part of all rows that they must be.
FILE_EDGES, HOT, HOT_SHARE = 200_000, 100_000, 10_000
#: Edges that one task contracts, at most; more are taken in steps of as many.
PART_EDGES = 50_000


def divided_join(rows: DataFrame, one: DataFrame, key: str, count: str, how: str = "inner", total: int = 0, largest: int | None = None, least: int | None = None) -> DataFrame:
    """rows with the columns of one, which has a row for each key and says in count how many rows the key has.

    Keys of more than HOT rows and more than 1 / HOT_SHARE of all of them (total, where it is known) are broadcast, so no task gets all rows of such a key; there are
    at most HOT_SHARE such keys. A null key of rows has none of the columns. largest, where it is known, is the most rows that a key can have: if that
    is not too many, nothing needs to be looked for. least stands for HOT where it is given.
    """
    many = max(HOT if least is None else least, total // HOT_SHARE)
    if largest is not None and largest <= many:
        return rows.join(one.drop(count), key, how)
    values = [c for c in one.columns if c not in (key, count)]
    hot = F.broadcast(one.where(F.col(count) > many).select(key, F.struct(*values).alias("_hot")))
    known = rows.join(hot, key, "left")
    large = known.where("_hot is not null").select(*rows.columns, *[F.col("_hot")[v].alias(v) for v in values])
    return large.unionByName(known.where("_hot is null").drop("_hot").join(one.drop(count), key, how))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each PART_EDGES edges of a part stars that connect the same vertices, each vertex with the smallest one that it reaches."""
    parent: dict = {}

    def top(v):
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[up]
        return v

    def stars() -> pa.RecordBatch:
        found = [(v, r) for v in parent if (r := top(v)) != v]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    held = 0
    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
            held += 1
            if held == PART_EDGES:
                yield stars()
                parent.clear()
                held = 0
    yield stars()


def components(edges: DataFrame, name: str = "components", files: int | None = None) -> DataFrame:
    """id, root: every vertex of edges (a, b) but the roots, with the smallest vertex it reaches.

    At most PART_EDGES edges are contracted by one task after every part has contracted its own, two
    short jobs in place of rounds of joins. Of more edges each step only groups by a vertex to find its smallest neighbour, then joins that one row back;
    a vertex with very many neighbours is pre-aggregated, and its row is broadcast to them. Edges
    shrink to stars; the loop ends when a round leaves them as they were. Null ends are ignored. files
    is the most files that the first edges are written to.
    """
    own = edges.where("a != b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    now = settle((own if files is None else own.coalesce(files)).mapInArrow(_contract, "a long, b long"), name)
    mark = _mark(now)
    if mark[0] <= PART_EDGES:
        earlier, now = now, settle(now.coalesce(1).mapInArrow(_contract, "a long, b long"), name)
        discard(earlier)
        return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = divided_join(both, least, "a", "n", total=2 * mark[0], largest=mark[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = divided_join(large, least, "a", "n", total=2 * mark[0], largest=mark[0]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        earlier, now = now, settle(small, name, 1 + 2 * mark[0] // FILE_EDGES)
        discard(earlier)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
