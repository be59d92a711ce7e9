import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import ann
from sylva.llm.ann import PermutationCoder, footrule, least, nearest
from sylva.llm.queries_pages import op5_nearest


def brute(ids, x, queries, k=5):
    out = {}
    norms = np.sqrt((x * x).sum(1))
    for q in queries:
        s = x @ x[q] / (norms * norms[q])
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def found(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    t = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"]).astype(float)
    want, got = brute(ids, x, np.flatnonzero(ids % 50 == 0)), found(op5_nearest(spark, folder))
    assert got.keys() == want.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    score = {(q, v): s for q in want for v, s in want[q]}
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5]
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(rows, rows[1:], strict=False))
        assert all(math.isclose(s, score.get((q, v), s), abs_tol=1e-12) for _, v, s in rows)


def test_ties_go_to_smaller_ids_and_all_copies_are_seen(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(size=8)
    rows = [(k, [float(c) for c in (base if k % 3 == 0 else rng.normal(size=8))]) for k in range(900)]
    monkeypatch.setattr(ann, "CHUNK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    got = found(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0))
    for q in range(0, 900, 150):
        assert [v for _, v, _ in got[q]] == [k for k in range(0, 21, 3) if k != q][:5]


def test_cases(spark, clash, same):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [0.0, 2.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0]), (8, [1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nearest(df, F.col("vec_id") == 0))
    # the query comes twice: either row is a candidate of the other
    assert {v for _, v, _ in got[0]} == {0, 6, 7} and len(got[0]) == 6
    one = df.where("vec_id is null or vec_id != 0").unionByName(df.where("vec_id = 0").limit(1))
    assert [(v, round(s, 12)) for _, v, s in found(nearest(one, F.col("vec_id") == 0))[0]] == [(6, round(0.5**0.5, 12)), (7, 0.0)]
    assert nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert nearest(df.where("vec_id in (1, 2)"), F.col("vec_id") == 1).count() == 0
    same(nearest(clash(one), F.col("vec_id") == 0), nearest(one, F.col("vec_id") == 0))


def test_positions_and_footrule():
    rng = np.random.default_rng(1)
    coder = PermutationCoder(rng.normal(size=(40, 6)), pivots=16)
    assert coder.posted == 16 and coder.share == 1.0
    ranks = coder.positions(rng.normal(size=(30, 6)))
    assert (np.sort(ranks, axis=1) == np.arange(16)).all()
    for k in range(30):
        want = np.abs(ranks.astype(int) - ranks[k]).sum(1)
        assert (footrule(np.ascontiguousarray(ranks.T), ranks[k], 16) == want).all()
        some = np.flatnonzero(ranks[k] < 5)
        assert (footrule(np.ascontiguousarray(ranks.T), ranks[k], 5) == np.abs(ranks[:, some].astype(int) - ranks[k, some]).sum(1)).all()
        assert least(want, 7).tolist() == sorted(np.lexsort((np.arange(30), want))[:7], key=lambda i: (want[i] == np.sort(want)[6], i))
    assert PermutationCoder(np.ones((5, 3))).positions(np.ones((2, 3))).tolist() == [[0], [0]]


def shapes(name):
    rng = np.random.default_rng(3)
    kind, d, n = name.split()
    d, n = int(d), int(n)
    if kind == "mass":  # a dense mass and queries far from it
        x = np.concatenate([rng.normal(size=d) + 0.02 * rng.normal(size=(n - 30, d)), rng.normal(size=(30, d))])
        return x, np.arange(n - 30, n)
    if kind == "clusters":
        return rng.normal(size=(30, d))[rng.integers(0, 30, n)] + 0.2 * rng.normal(size=(n, d)), np.arange(0, n, 100)
    return rng.normal(size=(n, d)), np.arange(0, n, 100)


@pytest.mark.parametrize("name", ["mass 32 1500", "mass 32 4000", "clusters 32 1500", "clusters 256 4000", "random 32 700", "random 32 4000", "random 64 5000", "random 256 5000", "random 768 4000"])
def test_recall_on_shapes(spark, name):
    x, queries = shapes(name)
    ids = np.arange(len(x))
    wanted = F.col("vec_id").isin(*queries.tolist())
    got = found(nearest(spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>"), wanted))
    want = brute(ids, x, queries)
    shares = [len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / 5 for q in want]
    assert np.mean(shares) >= 0.9 and min(shares) >= 0.4 and all(len(got[q]) == 5 for q in want)


def test_files_and_share_follow_the_vectors():
    """Vectors with neighbourhoods need few files and a small share; random ones in many dimensions most of both."""
    rng = np.random.default_rng(9)
    near = PermutationCoder(rng.normal(size=(100, 256))[rng.integers(0, 100, 1_500)] + 0.2 * rng.normal(size=(1_500, 256)))
    far = PermutationCoder(rng.normal(size=(1_500, 256)))
    assert near.posted <= 32 and near.share <= 0.1 < far.share
    ranks = near.positions(rng.normal(size=(5, 256)))
    assert (np.sort(ranks, axis=1)[:, : near.posted] == np.arange(near.posted)).all() and (np.sort(ranks, axis=1)[:, near.posted :] == near.posted).all()


def test_lengths_stay_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=3 + k % 2).tolist()) for k in range(60)]
    got = found(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 4))
    assert all(len(got[q]) == 5 and all(v % 2 == q % 2 for _, v, _ in got[q]) for q in range(4))
