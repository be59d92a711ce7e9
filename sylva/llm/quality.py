"""Quality classifier (operator 6): Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. Fitting takes pairs of one document
labelled good and one labelled bad and lowers the logistic loss of the difference of their
strengths, which depends on feature differences alone. The strength at the quantile of the labelled
bad share becomes the threshold; the score is the logistic function of the distance to it, scaled on
the same documents, so 0.5 is the threshold.

Fitting takes every labelled document. Features are measured once for all documents and written; the
labelled ones are dealt by hashes of the id into blocks of about BLOCK_ROWS rows, and each block gives the sums over
all pairs of its good and bad documents, so every labelled document is in pairs, work grows with the rows, and up to BLOCK_ROWS
rows all pairs there are count. Means, deviations, sums of each Newton step and the histograms that lead to the quantile
are Spark aggregates; the driver gets those alone, and at most EXACT_ROWS strengths of the last bin.

Defined results: null and empty texts have the features of no words and get a score like any other;
without labels of both kinds every score is 0.5, which counts as good; repeated rows are each scored;
of an id labelled both ways the good label counts, of one with several texts the least features; null
labels and null ids teach nothing, rows with a null id are scored and never held out; a very long text is measured whole, in one pass and memory
proportional to its words; equal strengths have equal scores; an empty table gives no rows. Only doc_id and text are read of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, received, send, settle

#: Labelled rows of a block, in which all pairs count.
BLOCK_ROWS = 512
#: Bins of a histogram, and strengths in the last one that the driver may get.
BINS, EXACT_ROWS = 2_048, 2_000
STEPS = 30
#: Labelled rows of a file that is read many times.
FILE_ROWS = 20_000
_LETTERS, _SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!#$%&*+/<=>@\\^_`{|}~"

_KIND = np.zeros(256, np.int64)  # other
for _k, _chars in enumerate((_LETTERS, _LETTERS.lower(), "0123456789", " \t\r\v\f", "\n", _SYMBOLS, ".,;:?'\"()-[]"), start=1):
    for _c in _chars:
        _KIND[ord(_c)] = _k
_KIND[128:] = 8


def text_features(text: str | None) -> list[float]:
    """Shares of kinds of characters, repetition and shape of a whole text, all between 0 and about 1."""
    raw = (text or "").encode("utf-8", "replace")
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, by_byte, 9)
    words, n = raw.split(), max(1.0, float(len(raw)))
    w = max(1.0, float(len(words)))
    lines = raw.split(b"\n")
    full = [x for x in lines if x]
    letters = max(1.0, kinds[1] + kinds[2])
    pairs = len(set(zip(words, words[1:], strict=False)))
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    common = by_byte / n
    return [
        *(kinds / n)[:9].tolist(), kinds[1] / letters, min(1.0, kinds[5] / w), len(set(words)) / w, pairs / max(1.0, w - 1), repeated / w,
        np.log1p(w) / 10, np.log1p(len(full)) / 10, min(1.0, n / w / 20), len(set(full)) / max(1, len(full)), min(1.0, w / max(1, len(full)) / 100),
        float(w < 5), float(w < 20), min(1.0, 10 * common[ord("|")]), min(1.0, 10 * common[ord("!")]), min(1.0, 10 * (common[ord("<")] + common[ord("{")] + common[ord("}")])), min(1.0, 10 * common[ord(".")]),
        (repeated / w) ** 0.5, (kinds[6] / n) ** 0.5, (kinds[3] / n) ** 0.5, float(np.log1p(w) ** 2 / 100), kinds[1] / letters > 0.5, float(len(raw) == 0),
    ]


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of pairs of a good and a bad row, and the sums of gradient and curvature of their loss."""
    p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - (bad @ w)[None, :], -30, 30)))
    c = p * (1 - p) + 1e-4
    cross = good.T @ c @ bad
    grad = good.T @ p.sum(1) - bad.T @ p.sum(0)
    hess = (good * c.sum(1)[:, None]).T @ good + (bad * c.sum(0)[:, None]).T @ bad - cross - cross.T
    return float(p.size), grad, hess


class PairwiseRanker:
    """Weights, threshold and scale; without weights every score is 0.5."""

    def __init__(self):
        self.w = None

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def learn(self, sums) -> None:
        """Newton steps of the Bradley-Terry likelihood with a ridge; sums(w) are those of pair_sums over all pairs, of rows divided by scale."""
        w = np.zeros(len(self.scale))
        for _ in range(STEPS):
            n, grad, hess = sums(w)
            step = np.linalg.solve(hess / n + 2e-3 * np.eye(len(w)), grad / n - 2e-3 * w)
            w += step * min(1.0, 2.0 / (1e-9 + np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def fit(self, good: np.ndarray, bad: np.ndarray, bad_share: float) -> PairwiseRanker:
        """A ranker of rows in memory; all their pairs count."""
        if not len(good) or not len(bad):
            return self
        every = np.concatenate([good, bad])
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        self.learn(lambda w: pair_sums(good / self.scale, bad / self.scale, w))
        s = np.concatenate([self.strength(good), self.strength(bad)])
        weight = np.concatenate([np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))])
        order = np.argsort(s, kind="stable")
        at = np.searchsorted(np.cumsum(weight[order]), bad_share)
        self.cut = float((s[order[min(at, len(s) - 1)]] + s[order[min(at + 1, len(s) - 1)]]) / 2)
        self.width = float(np.std(s) / 2 + 1e-6)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.cut) / self.width, -30, 30)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features in place of text."""
    for batch in batches:
        out = pa.array([list(map(float, text_features(t.as_py()))) for t in batch.column("text")], pa.list_(pa.float64()))
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), out], [*rest, "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of feature lists."""
    return np.array(column.flatten()).reshape(len(column), -1)


def _scored(model) -> object:
    """Scores in place of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array(received(model).score(_matrix(batch.column("x"))) if len(batch) else [], pa.float64())
            rest = [n for n in batch.schema.names if n != "x"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), out], [*rest, "score"])

    return run


def _block_sums(sent) -> object:
    """The numbers of the pair_sums of all blocks of a part, numbered: pairs, gradient, curvature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, w = received(sent)
        total = np.zeros(1 + len(w) + len(w) ** 2)
        for batch in batches:
            for good, bad in zip(batch.column("good"), batch.column("bad"), strict=True):
                if len(good) and len(bad):
                    n, grad, hess = pair_sums(_matrix(good.values) / scale, _matrix(bad.values) / scale, w)
                    total += np.concatenate([[n], grad, hess.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "v"])

    return run


def _kinds(docs: DataFrame) -> str:
    return ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)


def measured_documents(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns and the features x of each row's text, written once."""
    docs = docs.select(*carried, "text")
    return settle(docs.mapInArrow(_measure, f"{_kinds(docs.drop('text'))}, x array<double>"), "features")


def fit_ranker(measured: DataFrame, labels: DataFrame, seed: int = 3) -> PairwiseRanker:
    """A ranker learned from the rows of labels (doc_id, quality) and the features of measured (doc_id, x)."""
    spark, model = measured.sparkSession, PairwiseRanker()
    labels = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return model
    rows = settle(measured.select("doc_id", "x").join(labels, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("quality").alias("quality")), "labelled")
    n = rows.count()
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(max(1, n // BLOCK_ROWS)))
    own = lambda y: F.collect_list(F.when(F.col("quality") == y, F.col("x")))
    blocks = settle(rows.groupBy(block.alias("block")).agg(own(1).alias("good"), own(0).alias("bad")).select("good", "bad"), "blocks", files=max(1, n // FILE_ROWS))
    if blocks.where("size(good) > 0 and size(bad) > 0").isEmpty():
        return model
    width = len(text_features(""))
    moments = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v"), F.stddev_pop("v")).collect()
    model.mean, model.scale = np.array([r[1:] for r in sorted(moments)]).T + [[0], [1e-3]]

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        found = blocks.mapInArrow(_block_sums(send(spark, (model.scale, w))), "k int, v double").groupBy("k").agg(F.sum("v")).collect()
        total = np.array([r[1] for r in sorted(found)])
        return total[0], total[1 : 1 + width], total[1 + width :].reshape(width, width)

    model.learn(sums)
    terms = [(F.col("x")[k] - float(m)) / float(s) * float(w) for k, (m, s, w) in enumerate(zip(model.mean, model.scale, model.w, strict=True))]
    strengths = settle(rows.select(sum(terms[1:], terms[0]).alias("s")), "strengths", files=max(1, n // FILE_ROWS))
    at = min(n - 1, max(0, -(-n * counts[0] // (counts[0] + counts[1])) - 1))
    model.cut = sum(ranked(strengths, [at, min(at + 1, n - 1)])) / 2
    model.width = float(strengths.agg(F.stddev_pop("s")).first()[0] / 2 + 1e-6)
    discard(rows, blocks, strengths)
    return model


def ranked(values: DataFrame, places: list[int]) -> list[float]:
    """The values (column s) at these places of their order, from 0: histograms of ever narrower ranges, then the few values of the last."""
    out = []
    for place in places:
        low, high = values.agg(F.min("s"), F.max("s")).first()
        own, before = values, 0
        while low < high and own.count() > EXACT_ROWS:
            bin_of = F.least(F.floor((F.col("s") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
            bins = own.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("bin").collect()
            for b in bins:
                if before + b["n"] > place:
                    break
                before += b["n"]
            low, high = b["low"], b["high"]
            own = values.where((F.col("s") >= low) & (F.col("s") <= high))
        out.append(low if low == high else sorted(r["s"] for r in own.collect())[place - before])
    return out


def fit_quality_model(docs: DataFrame, labels: DataFrame, seed: int = 3) -> PairwiseRanker:
    """A ranker learned from the rows of labels (doc_id, quality) and the texts of docs (doc_id, text)."""
    measured = measured_documents(docs, "doc_id")
    model = fit_ranker(measured, labels, seed)
    discard(measured)
    return model


def score_measured(measured: DataFrame, model: PairwiseRanker) -> DataFrame:
    """The columns of measured and score in place of x."""
    return measured.mapInArrow(_scored(send(measured.sparkSession, model)), f"{_kinds(measured.drop('x'))}, score double")


def score_documents(docs: DataFrame, model: PairwiseRanker, *carried: str) -> DataFrame:
    """The carried columns and score of each row."""
    docs = docs.select(*carried, "text")
    return score_measured(docs.mapInArrow(_measure, f"{_kinds(docs.drop('text'))}, x array<double>"), model)
