import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm.langid import Chain, Labeller, fit_language_model, label_documents, letters

from .conftest import LANGS, prose


@pytest.fixture(scope="module")
def chain():
    rng = random.Random(1)
    return Chain(sorted(LANGS)).fit([[letters(prose(rng, lang, 60)) for _ in range(30)] for lang in sorted(LANGS)])


def test_blocks_equal_plain_forward_backward():
    rng, c = np.random.default_rng(0), Chain(["a", "b", "c"])
    c.step, c.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    sizes = np.array([1, 63, 64, 65, 200, 7])
    e = (rng.normal(size=(sizes.sum(), 3)) * 3).astype(np.float32)
    got, at = c.posteriors(e, sizes), 0
    for n in sizes:
        want, _ = c._smooth(e[None, at : at + n])
        assert np.allclose(want[0], got[at : at + n], atol=1e-5)
        at += n


def test_plain_forward_backward_sums_over_paths():
    import itertools

    rng, c = np.random.default_rng(1), Chain(["a", "b"])
    c.step, c.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    e = rng.normal(size=(5, 2))
    total = np.zeros((5, 2))
    for path in itertools.product(range(2), repeat=5):
        weight = np.exp(c.start[path[0]] + sum(e[t, y] for t, y in enumerate(path)) + sum(c.step[a, b] for a, b in itertools.pairwise(path)))
        for t, y in enumerate(path):
            total[t, y] += weight
    assert np.allclose(c._smooth(e[None])[0][0], total / total.sum(1, keepdims=True))


def test_held_out_accuracy(chain):
    rng = random.Random(2)
    cases = [(lang, prose(rng, lang, rng.randrange(3, 40))) for lang in LANGS for _ in range(60)]
    got = Labeller(chain).label([t for _, t in cases])
    assert sum(g[0] == lang for g, (lang, _) in zip(got, cases, strict=True)) >= 0.97 * len(cases)
    assert all(0 <= g[1] <= 1 for g in got)


def test_switches_are_labelled(chain):
    rng = random.Random(4)
    text = prose(rng, "en", 30) + " " + prose(rng, "de", 12)
    lang, score, n, other = Labeller(chain).label([text])[0]
    assert (lang, n) == ("en", 42) and 10 <= other <= 14 and score < 0.8


def test_cases(spark, docs, texts, chain):
    rows = {r["doc_id"]: r for r in label_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), chain, "doc_id").collect()}
    for k, t in enumerate(texts):
        if not t or not any(map(str.isalpha, t)):
            assert (rows[k]["lang_pred"], rows[k]["score"]) == ("und", 0.0)
        else:
            assert rows[k]["lang_pred"] in LANGS and 0 < rows[k]["score"] <= 1
    assert label_documents(docs, chain, "doc_id").count() == docs.count()


def test_batches_do_not_matter(chain, texts):
    whole = Labeller(chain).label(texts)
    alone = [Labeller(chain).label([t])[0] for t in texts]
    assert [(a[0], a[2]) for a in whole] == [(b[0], b[2]) for b in alone]
    assert np.allclose([a[1] for a in whole], [b[1] for b in alone], atol=1e-4)


def test_fit_reads_labelled_rows_only(spark, docs, clash, same):
    model = fit_language_model(docs)
    assert model.langs == ["de", "en", "fr"]
    again = fit_language_model(clash(docs))
    assert np.array_equal(model.w, again.w)
    none = fit_language_model(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.langs == []
    assert {r["lang_pred"] for r in label_documents(docs, none, "doc_id").collect()} == {"und"}
    assert label_documents(docs.limit(0), model, "doc_id").count() == 0
    same(label_documents(clash(docs), model, "doc_id"), label_documents(docs, model, "doc_id"))


def test_query_on_held_out_rows(spark, tiny):
    from sylva.llm.queries_text import op2_language_id

    got = op2_language_id(spark, tiny).join(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang_pred != 'und'")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
