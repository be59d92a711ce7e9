"""The quality model learns from every labelled document, and its threshold is the exact quantile of all of them."""

import random

import numpy as np
import pytest

from sylva.llm import quality
from sylva.llm.quality import PairwiseRanker, fit_quality_model, pair_sums, ranked, text_features


@pytest.fixture(scope="module")
def labelled(spark):
    """10,000 labelled documents, more than 3,000 of each label."""
    rng = random.Random(5)
    words = "river stone window garden letter morning AND *** 12 | the of".split()
    rows = [(k, " ".join(rng.choices(words, [1] * 6 + [1 + 2 * (k % 3 == 0)] * 4 + [1, 1], k=rng.randrange(3, 30))), int(k % 3 > 0)) for k in range(10_000)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4).cache(), rows


def test_every_labelled_document_counts(spark, labelled):
    docs, rows = labelled
    model = fit_quality_model(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    x = np.array([text_features(t) for _, t, _ in rows], float)
    assert np.allclose(model.mean, x.mean(0), atol=1e-9) and np.allclose(model.scale, x.std(0) + 1e-3, atol=1e-9)
    s, n_bad = np.sort(model.strength(x)), sum(1 - y for *_, y in rows)
    assert model.cut == pytest.approx((s[n_bad - 1] + s[n_bad]) / 2, abs=1e-9) and model.width == pytest.approx(s.std() / 2 + 1e-6, abs=1e-9)


def test_one_block_is_all_pairs(spark, labelled, monkeypatch):
    docs, rows = labelled
    few = docs.where("doc_id < 600")
    monkeypatch.setattr(quality, "BLOCK_ROWS", 600)
    got = fit_quality_model(few.select("doc_id", "text"), few.select("doc_id", "quality"))
    x, y = np.array([text_features(t) for _, t, _ in rows[:600]], float), np.array([y for *_, y in rows[:600]])
    want = PairwiseRanker().fit(x[y == 1], x[y == 0], float((y == 0).mean()))
    assert np.allclose(got.w, want.w, atol=1e-6) and got.width == pytest.approx(want.width, abs=1e-6)


def test_pair_sums_equal_a_loop():
    rng = np.random.default_rng(0)
    good, bad, w = rng.normal(size=(5, 3)), rng.normal(size=(4, 3)), rng.normal(size=3)
    n, grad, hess = pair_sums(good, bad, w)
    d = np.array([g - b for g in good for b in bad])
    p = 1 / (1 + np.exp(d @ w))
    assert n == 20 and np.allclose(grad, d.T @ p) and np.allclose(hess, (d * (p * (1 - p) + 1e-4)[:, None]).T @ d)


def test_ranked(spark, monkeypatch):
    monkeypatch.setattr(quality, "EXACT_ROWS", 10)
    monkeypatch.setattr(quality, "BINS", 7)
    values = [random.Random(k).gauss(0, 1) for k in range(500)] + [0.25] * 200 + [1e6]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    places = [0, 1, 350, 420, 699, 700]
    assert ranked(df, places) == [sorted(values)[k] for k in places]
