"""Approximate nearest neighbours (operator 5): a permutation index.

A vector is represented by the order of a fixed set of pivots by nearness to it, and posted with its position in the inverted files of
its nearest pivots, `posted` of them; in all others its position counts as `posted`. Files are divided into shards of CHUNK vectors
drawn by a hash, so each shard is a sample of all. A query reads only the files of its own nearest pivots, `posted` of them, adds up the differences of
positions there - the footrule distance between the two orders - and the `share` of the shard with the least is ranked again by cosine on
the original vectors in double precision; never fewer than k are, so no query lacks answers.

How many pivots are posted and what share is ranked again follows from the vectors: of the pairs in which some of a drawn sample find WANTED of their true
neighbours among the rest of it, the one that costs least. Neighbours in a sample are farther than those among all rows, so the recall on all rows is
above that. Vectors that have neighbourhoods need few files and a small share; random ones in many dimensions
need most of both, which no index escapes.

Nearness to pivots is measured from the mean of a bounded sample, else a dense mass of vectors sees all pivots in
one order. Half of the pivots are drawn, half are those farthest from the ones before, so that outliers have pivots near them.

Queries and shards meet in blocks of at most QUERY_BLOCK and CHUNK rows; nothing depends on the number of vectors but the
number of blocks. Vectors of different lengths have no cosine; each length has pivots, files and queries
of its own. A length of at most SAMPLE rows has no pivots: its queries meet all of them. The broadcast holds PIVOTS vectors for each other length.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor
do rows with a null id; a query's candidates are all other rows of its length, rows with its id too if it is repeated, and each of
the rows with that id asks for itself; ties in cosine, and in footrule, go to the smaller id; fewer candidates than k give fewer rows; an
empty table gives none; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drawn_rows, first_drawn, received, send, settle

#: Pivots, and how many of them may be posted.
PIVOTS, POSTED = 128, (16, 32, 64, 128)
#: Share of true neighbours that the sample finds, rows of it that ask, and the least share of a shard that is ranked again.
WANTED, ASKED, LEAST_SHARE = 0.97, 300, 0.05
#: Vectors of each length drawn for pivots and their mean.
SAMPLE = 1_500
CHUNK, QUERY_BLOCK = 8_192, 2_048


def usable(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class PermutationCoder:
    """Pivots, and the positions that a vector has in their files."""

    def __init__(self, sample: np.ndarray, pivots: int = PIVOTS):
        unit = np.unique(_unit(sample), axis=0)
        unit = unit[np.random.default_rng(7).permutation(len(unit))]
        self.mean = unit.mean(axis=0)
        chosen, far = [], np.full(len(unit), np.inf)
        while len(chosen) < min(pivots // 2, len(unit)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((unit - unit[chosen[-1]]) ** 2).sum(axis=1))
        taken = set(chosen)
        chosen += [i for i in range(len(unit)) if i not in taken][: pivots - len(chosen)]
        out = unit[chosen] - self.mean
        self.pivots = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        self.posted, self.share = len(chosen), 1.0
        self._settle(unit)

    def _settle(self, unit: np.ndarray, k: int = 5) -> None:
        """Chooses posted and share: the least cost at which the sample's vectors find WANTED of their neighbours."""
        if len(unit) < 20 * k:
            return
        n = min(ASKED, len(unit) // 2)
        cosine = unit[:n] @ unit.T
        cosine[np.arange(n), np.arange(n)] = -2
        true = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        best = np.inf
        for posted in POSTED:
            self.posted = min(posted, len(self.pivots))
            ranks = self.positions(unit)
            files, places = np.ascontiguousarray(ranks.T), np.empty((n, k))
            for q in range(n):
                distance = footrule(files, ranks[q], self.posted).astype(np.int64)
                distance[q] = -1
                places[q] = np.argsort(np.argsort(distance, kind="stable"), kind="stable")[true[q]]
            share = min(1.0, max(LEAST_SHARE, float(np.quantile(places + 1, WANTED)) / len(unit)))
            cost = self.posted + 4 * share * unit.shape[1]
            if cost < best:
                best, chosen = cost, (self.posted, share)
        self.posted, self.share = chosen

    def positions(self, x: np.ndarray) -> np.ndarray:
        """One row of positions for each vector."""
        near = (_unit(x) - self.mean) @ self.pivots.T
        order = np.argsort(-near, axis=1, kind="stable")
        ranks = np.empty(order.shape, np.uint8)
        np.put_along_axis(ranks, order, np.broadcast_to(np.minimum(np.arange(order.shape[1]), self.posted).astype(np.uint8), order.shape), axis=1)
        return ranks


def footrule(files: np.ndarray, own: np.ndarray, posted: int) -> np.ndarray:
    """Sum of differences of positions in the files of the pivots that own is posted under; a row of files for each pivot, a column for each vector."""
    read = np.flatnonzero(own < posted)
    files, own = files[read], own[read][:, None]
    return (np.maximum(files, own) - np.minimum(files, own)).sum(axis=0, dtype=np.uint16)


def least(distance: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least, of equal ones the first."""
    if n >= len(distance):
        return np.arange(len(distance))
    edge = np.partition(distance, n - 1)[n - 1]
    below = np.flatnonzero(distance < edge)
    return np.concatenate([below, np.flatnonzero(distance == edge)[: n - len(below)]])


def _post(sent) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coders = received(sent)
        for pdf in batches:
            if len(pdf):
                positions = np.empty(len(pdf), object)
                vectors = [np.asarray(v, np.float64) for v in pdf["v"]]
                sizes = pdf["n"].to_numpy()
                for n in np.unique(sizes):
                    at = np.flatnonzero(sizes == n)
                    if int(n) not in coders:
                        for k in at:
                            positions[k] = b""
                        continue
                    for k, p in zip(at, coders[int(n)].positions(np.stack([vectors[i] for i in at])), strict=True):
                        positions[k] = p.tobytes()
                yield pd.DataFrame({"row": pdf["row"], "vec_id": pdf["vec_id"], "n": pdf["n"], "v": [v.tobytes() for v in vectors], "positions": positions})

    return run


def _stacked(column: pd.Series, kind: type) -> np.ndarray:
    return np.stack([np.frombuffer(v, kind) for v in column])


def _meet(sent, k: int) -> object:
    def run(posted: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        if len(posted) and len(asked):
            posted = posted.sort_values("vec_id", kind="stable")
            rows, ids, x = posted["row"].to_numpy(), posted["vec_id"].to_numpy(), _unit(_stacked(posted["v"], np.float64))
            coder = received(sent).get(int(posted["n"].iloc[0]))
            files = np.ascontiguousarray(_stacked(posted["positions"], np.uint8).T) if coder else None
            n = max(k + 1, int(np.ceil(coder.share * len(ids)))) if coder else len(ids)
            for row, qid, v, own in zip(asked["row"], asked["vec_id"], asked["v"], asked["positions"], strict=True):
                near = np.arange(len(ids)) if n >= len(ids) else least(footrule(files, np.frombuffer(own, np.uint8), coder.posted), n)
                near = near[rows[near] != row]
                score = x[near] @ _unit(np.frombuffer(v, np.float64)[None])[0]
                best = np.lexsort((ids[near], -score))[:k]
                out.append((np.full(len(best), row), np.full(len(best), qid), ids[near][best], score[best]))
        return pd.DataFrame({name: np.concatenate(c) for name, c in zip(("row", "query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, seed: int = 17) -> DataFrame:
    """query_id, rank, vec_id, score: rows of vectors (vec_id, embedding) for which is_query (of vec_id) holds, against all rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull()).where(usable(F.col("v"))).withColumn("n", F.size("v"))
    counts = {r["n"]: r["count"] for r in rows.groupBy("n").count().collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    many = {n: c for n, c in counts.items() if c > SAMPLE}
    drawn = drawn_rows(rows.where(F.col("n").isin(*many)).select("n", "v"), "n", many, F.xxhash64("v", F.lit(seed)), SAMPLE).collect() if many else []
    samples = {n: [r["v"] for r in own] for n, own in first_drawn(drawn, "n", SAMPLE).items()}
    coders = send(spark, {n: PermutationCoder(np.array(sorted(own), np.float64)) for n, own in samples.items()})

    posted = settle(rows.mapInPandas(_post(coders), "row long, vec_id long, n int, v binary, positions binary"), "ann-posted")
    asked = posted.where(is_query)
    # one row for each length
    sizes = posted.groupBy("n").agg(F.count("*").alias("rows")).join(asked.groupBy("n").agg(F.count("*").alias("queries")), "n")
    sizes = F.broadcast(sizes.select("n", F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("queries") / QUERY_BLOCK).cast("int").alias("blocks")))
    chunk, block = (F.pmod(F.xxhash64("row", F.lit(seed)), F.col(c)).cast("int") for c in ("chunks", "blocks"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = [F.col(c).alias(c) for c in ("n", "row", "vec_id", "v", "positions")]  # names of their own for either side
    left = posted.join(sizes, "n").select(*own, chunk.alias("chunk"), each("blocks").alias("block"))
    right = asked.join(sizes, "n").select(*own, each("chunks").alias("chunk"), block.alias("block"))
    keys = ["n", "chunk", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_meet(coders, k), "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
