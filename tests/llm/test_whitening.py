import numpy as np
import pytest

from sylva.llm.common import table
from sylva.llm.queries_pages import op12_whitening
from sylva.llm.whitening import SHIFT, covariance_times, fit_list, lobpcg, principal_components, whitened_rows

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows):
    """Covariance and its eigenpairs, falling, and exact deviations of the rows that take part."""
    x = np.array([[int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in v] for v in rows])
    c = x - x.mean(axis=0)
    v = c.T @ c / len(x)
    values, vectors = np.linalg.eigh(v)
    n, s = len(x), [int(t) for t in x.sum(axis=0)]
    deviations = [sum((n * int(a) - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return c, values[::-1], vectors[:, ::-1], np.trace(v), deviations


def assert_whitened(got, rows, ids):
    c, values, vectors, trace, deviations = plain(rows)
    k = min(8, len(values))
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == k * len(rows) and sorted(by) == sorted(set(ids))
    for j in range(k):
        want = c @ vectors[:, j] / np.sqrt(values[j])
        have = np.array([by[i][j + 1]["whitened"] for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        assert all(by[i][j + 1]["explained"] == pytest.approx(values[j] / trace) for i in ids)
    assert [int(by[i][1]["deviation"]) for i in ids] == deviations
    assert {r["n"] for r in got} == {len(rows)} and {r["identity_error"] < 1e-9 for r in got} == {True}


def random_rows(n, d, seed, fall=0.9):
    rng = np.random.default_rng(seed)
    mix = np.linalg.qr(rng.standard_normal((d, d)))[0]
    return (rng.standard_normal((n, d)) * fall ** np.arange(d) @ mix + rng.standard_normal(d)).astype(np.float32)


@pytest.mark.parametrize("n,d,fall", [(300, 64, 0.97), (200, 5, 0.8), (40, 1, 1.0), (400, 130, 1.0)])
def test_equals_a_dense_solver(spark, n, d, fall):
    rows = random_rows(n, d, d, fall)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], SCHEMA).repartition(5)
    assert_whitened(whitened_rows(df).collect(), rows, list(range(n)))


def test_query_on_its_table(spark, tiny):
    rows = table(spark, tiny, "embeddings").collect()
    got = op12_whitening(spark, tiny)
    assert dict(got.dtypes)["deviation"] == "bigint"
    assert_whitened(got.collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


@pytest.mark.parametrize("d,gap", [(300, 0.995), (300, 0.9), (768, 0.98), (20, 1.0)])
def test_pairs_are_certified(d, gap):
    values = 50 * gap ** np.arange(d)
    q = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    a = (q * values) @ q.T
    passes = []
    found = lobpcg(lambda b: passes.append(b.shape[1]) or a @ b, d)
    assert (found.residuals <= 1e-11 * values[0]).all() and found.rounds == len(passes) and max(passes) <= min(d, 48)
    assert np.allclose(found.values, values[:8], rtol=1e-12)
    assert np.allclose(np.linalg.norm(a @ found.vectors - found.vectors * found.values, axis=0), 0, atol=1e-10 * values[0])
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(8), atol=1e-12)


def test_blocks_are_summed_over_the_tasks(spark):
    rows = random_rows(500, 7, 1)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], SCHEMA).repartition(9)
    fit = fit_list(df)
    c, _, _, trace, _ = plain(rows)
    block = np.random.default_rng(2).standard_normal((7, 3))
    assert np.allclose(covariance_times(df, fit, block), c.T @ (c @ block) / 500, rtol=1e-12) and fit.trace == pytest.approx(trace, rel=1e-13)
    assert principal_components(df, fit, 2).vectors.shape == (7, 2)


def test_rows_of_every_kind(spark, same, clash):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(60, 4, 3).tolist()
    odd = [(1000, None), (1001, []), (1002, [1.0, None, 2.0, 3.0]), (1003, [nan, 1.0, 2.0, 3.0]), (1004, [1.0, inf, 1.0, 1.0]), (1005, [1.0, 2.0, 3.0]), (1006, [1.0] * 5), (None, [0.5] * 4)]
    df = spark.createDataFrame([*enumerate(rows), *odd, (0, rows[0])], SCHEMA)
    got = whitened_rows(df)
    assert got.where("vec_id >= 1000").count() == 0 and got.where("vec_id is null").count() == 4 and got.where("vec_id = 0").count() == 8
    assert got.select("n").distinct().collect() == [(62,)]
    ids = [r["vec_id"] for r in df.where("vec_id < 1000").collect()]
    assert sorted(set(ids)) == list(range(60))
    assert got.columns == whitened_rows(clash(df)).columns and whitened_rows(clash(df)).count() == got.count()
    assert whitened_rows(df.limit(0)).collect() == [] and whitened_rows(spark.createDataFrame([(1, []), (2, None)], SCHEMA)).collect() == []


def test_no_variance(spark):
    for rows in ([[1.0, 2.0]], [[1.0, 2.0]] * 3):
        got = whitened_rows(spark.createDataFrame(list(enumerate(rows)), SCHEMA)).collect()
        assert len(got) == 2 * len(rows) and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    got = whitened_rows(spark.createDataFrame([(k, [float(k), 1.0, 2.0 * k]) for k in range(9)], SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got) and max(r["identity_error"] for r in got) < 1e-9


def test_huge_entries_are_exact(spark):
    rows = [(0, [1e30, 0.0]), (1, [-3e38, 1.0]), (2, [2.0, 5e9]), (3, [0.0, 0.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitened_rows(spark.createDataFrame(rows, SCHEMA)).where("component = 1").collect()}
    held = [[max(-(1 << 44), min(1 << 44, int(np.floor(1024 * np.float64(np.float32(c)))))) + SHIFT for c in v] for _, v in rows]
    s = [sum(t) for t in zip(*held, strict=True)]
    assert {k: int(v) for k, v in got.items()} == {k: sum((4 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for k, v in enumerate(held)}
