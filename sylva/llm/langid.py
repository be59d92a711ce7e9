"""Language ID (operator 2): a linear-chain conditional random field over words.

A word's potentials come from hashed features: its byte n-grams (with word ends), its affixes and
the word itself (the lexicon). Transitions between neighbouring words are learned too. The chain
runs over the whole text; forward-backward gives each word a distribution over languages, so
code-switched text gets its switches labelled. A document's language is the one with the largest
mean over its words.

Fitting takes a bounded sample of labelled rows: of each language the SAMPLE_DOCS with the smallest
hashes of id and text, each with its whole text. The model holds 2^BITS floats for each language. Rows carry one language each, so code-switched chains for learning are put together
from runs of words of different rows.

Inference is exact and vectorised: chains are cut into blocks of BLOCK words, each block's transfer
matrix is multiplied out, vectors are carried from block to block, then all blocks run at once.

Defined results: null text and text without a letter give und with score 0; so does everything if
there is no labelled row. Ties go to the first language by code point. Repeated rows are each
judged; a row with a null id is judged, teaches nothing in the query and is never held out there; an
empty table gives no rows; columns other than those named are not read. A very long text is one chain:
its word potentials and posteriors take about 80 bytes a word for four languages while it is labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn_rows, first_drawn, received, send

#: Labelled rows of each language that the chain learns from.
SAMPLE_DOCS = 400
BITS = 17
BLOCK = 64
#: Words whose potentials one worker remembers.
CACHE_WORDS = 150_000
#: Words that are labelled at once, about.
STEP_WORDS = 200_000
#: Words whose features are found at once while a chain is fitted.
FIT_WORDS = 4_000
UNKNOWN = "und"

_SPACES = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalpha()), b" " * (128 - 52))
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def letters(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters; runs of other non-ASCII characters alone are left out."""
    if not text:
        return []
    found = text.lower().encode("utf-8", "replace").translate(_SPACES).split()
    return [w for w in found if w[0] < 128 or w[-1] < 128 or any(map(str.isalpha, w.decode("utf-8", "replace")))]


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one after the other, and where each word's begin."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(len(text)) - np.repeat(begin[:-1], size)
    left = np.repeat(size, size) - place
    owner = np.repeat(np.arange(len(words)), size)
    values, owners = [], []
    h = text * _M[0]
    for n in (2, 3, 4):
        nxt = np.zeros_like(text)
        nxt[: len(text) - n + 1] = text[n - 1 :]
        h = (h ^ (h >> np.uint64(27))) * _M[1] + nxt * _M[n - 1]
        ok = left >= n
        values.append(h[ok] + np.uint64(n))
        owners.append(owner[ok])
        if n == 4:  # affixes: the first and the last three letters, told apart from n-grams
            ends = (place == 0) | (left == 4)
            values.append(h[ok & ends] * _M[2] + np.uint64(9))
            owners.append(owner[ok & ends])
    values.append(np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)))
    owners.append(np.arange(len(words)))
    v, o = np.concatenate(values), np.concatenate(owners)
    v ^= v >> np.uint64(32)
    v = (v * _M[3]) >> np.uint64(64 - BITS)
    order = np.argsort(o, kind="stable")
    return v[order].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(words)))])


def fitted_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """word_features in steps of FIT_WORDS words: its temporary arrays take many times what is kept."""
    found = (word_features(words[i : i + FIT_WORDS]) for i in range(0, len(words), FIT_WORDS))
    parts = [(f.astype(np.int32), at) for f, at in found]
    before = np.cumsum([0, *[len(f) for f, _ in parts]])
    return np.concatenate([f for f, _ in parts]), np.concatenate([[0], *[at[1:] + b for (_, at), b in zip(parts, before, strict=False)]])


class Chain:
    """Learned weights: features, transitions and starts."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        n = len(langs)
        self.w = np.zeros((1 << BITS, n), np.float32)
        self.step, self.start = np.zeros((n, n)), np.zeros(n)

    def potentials(self, words: list[bytes]) -> np.ndarray:
        f, at = word_features(words)
        return np.add.reduceat(self.w[f], at[:-1], axis=0)

    # -- fitting -------------------------------------------------------------------------------

    def summed(self, f: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The potentials of words by their features, in steps of FIT_WORDS words."""
        return np.concatenate([np.add.reduceat(self.w[f[own[0] : own[-1]]], own[:-1] - own[0], axis=0) for own in (at[i : i + FIT_WORDS + 1] for i in range(0, len(at) - 1, FIT_WORDS))])

    def fit(self, texts: list[list[list[bytes]]], seed: int = 5) -> Chain:
        """texts: for each language the words of each row."""
        n = len(self.langs)
        vocabulary: dict[bytes, int] = {}
        counts: list[np.ndarray] = []
        for own in texts:
            at = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for row in own for w in row), np.int64)
            counts.append(at)
        y = np.stack([np.bincount(a, minlength=len(vocabulary)) for a in counts], 1).astype(float)
        y = np.log1p(y / np.maximum(1, y.sum(0)) * y.sum(0).max())
        words = list(vocabulary)
        f, at = fitted_features(words)
        squares = np.full(self.w.shape, 1e-2)

        def push(residual: np.ndarray, rate: float, f=f, at=at) -> None:
            for k in range(n):
                g = np.zeros(len(self.w))
                for i in range(0, len(at) - 1, FIT_WORDS):
                    own = at[i : i + FIT_WORDS + 1]
                    np.add.at(g, f[own[0] : own[-1]], np.repeat(residual[i : i + FIT_WORDS, k], np.diff(own)))
                g -= 1e-3 * self.w[:, k]
                squares[:, k] += g**2
                self.w[:, k] += rate * g / np.sqrt(squares[:, k])

        for _ in range(25):
            s = self.summed(f, at)
            p = np.exp(s - s.max(1, keepdims=True))
            push(y - y.sum(1, keepdims=True) * p / p.sum(1, keepdims=True), 0.3)
        rng = np.random.default_rng(seed)
        flat = [a for a in counts if len(a)]
        kinds = [k for k, a in enumerate(counts) if len(a)]
        length, rows = 48, 400
        seq, lab = np.zeros((rows, length), np.int64), np.zeros((rows, length), np.int64)
        for r in range(rows):
            at_word = 0
            while at_word < length:
                k = int(rng.integers(0, len(kinds)))
                run = min(int(rng.geometric(1 / 12)) + 2, length - at_word)
                begin = int(rng.integers(0, max(1, len(flat[k]) - run)))
                got = flat[k][begin : begin + run]
                seq[r, at_word : at_word + len(got)], lab[r, at_word : at_word + len(got)] = got, kinds[k]
                at_word += len(got)
        used, back = np.unique(seq, return_inverse=True)
        fu, au = fitted_features([words[i] for i in used])
        back = back.reshape(seq.shape)
        hot = np.eye(n)[lab]
        pairs = np.zeros((n, n))
        np.add.at(pairs, (lab[:, :-1].ravel(), lab[:, 1:].ravel()), 1)
        for _ in range(20):
            e = self.summed(fu, au)[back]
            post, expected = self._smooth(e)
            self.step += 2.0 * ((pairs - expected) / pairs.sum() - 1e-3 * self.step)
            self.start += 0.5 * (hot[:, 0] - post[:, 0]).mean(0)
            residual = np.zeros((len(used), n))
            np.add.at(residual, back.ravel(), (hot - post).reshape(-1, n))
            push(residual, 0.05, fu, au)
        return self

    def _smooth(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of chains of equal length and the expected counts of transitions."""
        p, a = np.exp(e - e.max(2, keepdims=True)), np.exp(self.step)
        fwd, bwd = np.zeros_like(p), np.ones_like(p)
        fwd[:, 0] = np.exp(self.start) * p[:, 0]
        for t in range(p.shape[1]):
            if t:
                fwd[:, t] = (fwd[:, t - 1] @ a) * p[:, t]
            fwd[:, t] /= fwd[:, t].sum(1, keepdims=True)
        expected = np.zeros_like(a)
        for t in range(p.shape[1] - 1, 0, -1):
            right = p[:, t] * bwd[:, t]
            joint = fwd[:, t - 1, :, None] * a * right[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            bwd[:, t - 1] = right @ a.T
            bwd[:, t - 1] /= bwd[:, t - 1].sum(1, keepdims=True)
        post = fwd * bwd
        return post / post.sum(2, keepdims=True), expected

    # -- inference -----------------------------------------------------------------------------

    def posteriors(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Word posteriors of chains of the given sizes, whose potentials e stand one after the other."""
        n, a = len(self.langs), np.exp(self.step).astype(np.float32)
        blocks = -(-sizes // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        chain = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(e)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row, col = first[chain] + place // BLOCK, place % BLOCK
        total = int(first[-1])
        p = np.ones((total, BLOCK, n), np.float32)
        p[row, col] = np.exp(e - e.max(1, keepdims=True))
        used = np.zeros((total, BLOCK), bool)
        used[row, col] = True
        heads = np.zeros(total, bool)
        heads[first[:-1]] = True
        begin = np.exp(self.start).astype(np.float32)
        through = np.broadcast_to(np.eye(n, dtype=np.float32), (total, n, n)).copy()
        for t in range(BLOCK):
            live = used[:, t]
            new = (through[live].reshape(-1, n) @ a).reshape(-1, n, n)
            if t == 0:  # whatever stands before a chain leads to its start
                new[heads[live]] = begin
            new *= p[live, t][:, None, :]
            through[live] = new / new.sum((1, 2), keepdims=True)
        left, right = np.full((total, n), 1 / n, np.float32), np.ones((total, n), np.float32)
        for k in range(1, int(blocks.max())):
            b = first[:-1][blocks > k] + k
            v = np.einsum("bi,bij->bj", left[b - 1], through[b - 1])
            left[b] = v / v.sum(1, keepdims=True)
        for k in range(int(blocks.max()) - 1, 0, -1):
            b = first[:-1][blocks > k] + k
            v = np.einsum("bij,bj->bi", through[b], right[b])
            right[b - 1] = v / v.sum(1, keepdims=True)
        fwd = np.empty_like(p)
        for t in range(BLOCK):
            v = (left if t == 0 else fwd[:, t - 1]) @ a
            if t == 0:
                v[heads] = begin
            v = v * p[:, t]
            fwd[:, t] = np.where(used[:, t, None], v / v.sum(1, keepdims=True), left if t == 0 else fwd[:, t - 1])
        for t in range(BLOCK - 1, -1, -1):
            fwd[:, t] *= right
            new = (p[:, t] * right) @ a.T
            right = np.where(used[:, t, None], new / new.sum(1, keepdims=True), right)
        post = fwd[row, col]
        return post / post.sum(1, keepdims=True)


class Labeller:
    """Labels texts with a chain; remembers the potentials of words it has met."""

    def __init__(self, chain: Chain):
        self.chain, self.known = chain, {}
        self.table = np.zeros((CACHE_WORDS, len(chain.langs)), np.float32)

    def _potentials(self, words: list[bytes]) -> np.ndarray:
        new = list({w for w in words if w not in self.known})
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(set(words))
        if len(new) > CACHE_WORDS:
            return np.concatenate([self.chain.potentials(words[i : i + CACHE_WORDS]) for i in range(0, len(words), CACHE_WORDS)])
        if new:
            at = len(self.known)
            self.table[at : at + len(new)] = self.chain.potentials(new)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
        """Language, score, words, and words in another language, of each text."""
        out: list = [(UNKNOWN, 0.0, 0, 0)] * len(texts)
        if not self.chain.langs:
            return out
        held: list[tuple[int, list[bytes]]] = []
        waiting = 0
        for i, text in enumerate(texts):
            if w := letters(text):
                held.append((i, w))
                waiting += len(w)
            if waiting >= STEP_WORDS or (i == len(texts) - 1 and held):
                sizes = np.array([len(w) for _, w in held])
                post = self.chain.posteriors(self._potentials([x for _, w in held for x in w]), sizes)
                begin = np.cumsum(sizes) - sizes
                mean = np.add.reduceat(post.astype(np.float64), begin, axis=0) / sizes[:, None]
                best = mean.argmax(1)
                other = np.add.reduceat((post.argmax(1) != np.repeat(best, sizes)).astype(np.int64), begin)
                for (k, w), m, b, o in zip(held, mean, best, other, strict=True):
                    out[k] = (self.chain.langs[b], float(min(1.0, m[b])), len(w), int(o))
                held, waiting = [], 0
        return out


def fit_language_model(docs: DataFrame, seed: int = 5) -> Chain:
    """A chain learned from the labelled rows of docs (doc_id, text, lang), a bounded sample of each language."""
    draw = F.xxhash64("doc_id", "text", F.lit(seed))
    usable = docs.where("lang is not null and text is not null").where(F.col("text").rlike(r"[^\x00-@\[-`{-\x7f]"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    rows = usable.select("lang", "text", draw.alias("draw"))
    sample = first_drawn(drawn_rows(rows, "lang", counts, F.col("draw"), SAMPLE_DOCS).collect(), "lang", SAMPLE_DOCS)
    texts = {lang: [w for r in rows if (w := letters(r["text"]))] for lang, rows in sample.items()}
    langs = sorted(lang for lang, own in texts.items() if own)
    return Chain(langs).fit([texts[lang] for lang in langs], seed) if langs else Chain([])


def _label(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(received(model))
        for batch in batches:
            found = labeller.label([t.as_py() for t in batch.column("text")])
            cols = list(zip(*found, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in rest] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*rest, "lang_pred", "score", "n_words", "n_other"])

    return run


def label_documents(docs: DataFrame, model: Chain, *carried: str) -> DataFrame:
    """The carried columns and lang_pred, score, n_words and n_other (words in another language) of each row."""
    docs = docs.select(*carried, "text")
    kinds = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes if n != "text")
    return docs.mapInArrow(_label(send(docs.sparkSession, model)), f"{kinds}, lang_pred string, score double, n_words long, n_other long")
