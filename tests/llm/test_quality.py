import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm.common import table
from sylva.llm.quality import PairwiseRanker, fit_quality_model, score_documents, text_features
from sylva.llm.queries_text import op6_quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = op6_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    right = got.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("share")).collect()
    assert len(right) == 2 and all(r["share"] > 0.95 for r in right)


def test_ranking_and_threshold():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (400, 4)), rng.normal(-1, 1, (100, 4))
    m = PairwiseRanker().fit(good, bad, 0.2)
    s = np.concatenate([m.score(good), m.score(bad)])
    assert (m.score(good)[:, None] > m.score(bad)).mean() > 0.97
    assert abs((s < 0.5).mean() - 0.2) < 0.03 and (0 <= s).all() and (s <= 1).all()


def test_cases(spark, docs, texts, clash, same):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(len(texts))] + [(None, 1, 0), (2, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit_quality_model(docs, labels)
    scored = score_documents(docs, model, "doc_id")
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert score_documents(docs.limit(0), model, "doc_id").count() == 0
    same(score_documents(clash(docs.drop("score")).drop("score"), model, "doc_id"), scored)
    none = fit_quality_model(docs, labels.where("quality = 1"))
    assert {r["score"] for r in score_documents(docs, none, "doc_id").collect()} == {0.5}
    assert fit_quality_model(docs, labels.limit(0)).w is None


def test_features_are_bounded(texts):
    for t in [*texts, "!" * 10_000, "A" * 10, "| | |", "\n" * 500]:
        x = text_features(t)
        assert len(x) == len(text_features("")) and all(0 <= v < 20 for v in x)


def plain_features(text):
    """The features again, one byte at a time."""
    raw = (text or "").encode("utf-8", "replace")
    kinds = [0] * 9
    for b in raw:
        c = chr(b)
        kinds[8 if b > 127 else 1 if "A" <= c <= "Z" else 2 if "a" <= c <= "z" else 3 if "0" <= c <= "9" else 4 if c in " \t\r\v\f" else 5 if c == "\n" else 6 if c in "!#$%&*+/<=>@\\^_`{|}~" else 7 if c in ".,;:?'\"()-[]" else 0] += 1
    words, word = [], b""
    for b in raw + b" ":
        if bytes([b]) in (b" ", b"\t", b"\n", b"\r", b"\v", b"\f"):
            if word:
                words.append(word)
            word = b""
        else:
            word += bytes([b])
    n, w, full = max(1.0, len(raw)), max(1.0, len(words)), [x for x in raw.split(b"\n") if x]
    letters, lines = max(1.0, kinds[1] + kinds[2]), max(1, len(full))
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    count = lambda c: raw.count(c) / n
    return [
        *[k / n for k in kinds], kinds[1] / letters, min(1.0, kinds[5] / w), len(set(words)) / w, len(set(zip(words, words[1:], strict=False))) / max(1.0, w - 1), repeated / w, math.log1p(w) / 10, math.log1p(len(full)) / 10, min(1.0, n / w / 20), len(set(full)) / lines, min(1.0, w / lines / 100),
        float(w < 5), float(w < 20), min(1.0, 10 * count(b"|")), min(1.0, 10 * count(b"!")), min(1.0, 10 * (count(b"<") + count(b"{") + count(b"}"))), min(1.0, 10 * count(b".")), (repeated / w) ** 0.5, (kinds[6] / n) ** 0.5, (kinds[3] / n) ** 0.5, math.log1p(w) ** 2 / 100, float(kinds[1] / letters > 0.5), float(not raw),
    ]


def test_query_equals_a_plain_run(spark, tiny):
    """Every score of the query from features taken byte by byte, by a model whose weights lie where the pairwise loss is least."""
    docs, labels = table(spark, tiny, "documents").collect(), table(spark, tiny, "labels").collect()
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    got = {r["doc_id"]: r for r in op6_quality(spark, tiny).collect()}
    model = fit_quality_model(table(spark, tiny, "documents"), table(spark, tiny, "labels").where(F.col("doc_id").isin([r["doc_id"] for r in labels if not held(r["doc_id"])])))
    assert len(got) == len(docs)
    for r in docs:
        x = np.array(plain_features(r["text"]))
        strength = sum((a - m) / s * w for a, m, s, w in zip(x, model.mean, model.scale, model.w, strict=True))
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, (strength - model.cut) / model.width))))
        row = got[r["doc_id"]]
        assert row["score"] == pytest.approx(score, abs=1e-9) and row["held_out"] == held(r["doc_id"]) and row["predicted"] == (row["score"] >= 0.5)
    # the mean logistic loss over all pairs of good and bad rows, with the ridge, rises in every direction from the weights
    label, text = {}, {r["doc_id"]: r["text"] for r in docs}
    for r in labels:
        if r["quality"] in (0, 1) and not held(r["doc_id"]):
            label[r["doc_id"]] = max(label.get(r["doc_id"], 0), r["quality"])
    x = {y: np.array([plain_features(text[k]) for k, v in label.items() if v == y and k in text]) / model.scale for y in (0, 1)}

    def loss(w):
        margin = (x[1] @ w)[:, None] - (x[0] @ w)[None, :]
        return np.log1p(np.exp(-margin)).mean() + 1e-3 * w @ w

    least, rng = loss(model.w), np.random.default_rng(1)
    for _ in range(40):
        step = rng.standard_normal(len(model.w))
        assert loss(model.w + 0.3 * step / np.linalg.norm(step)) > least
