"""Benchmark decontamination (operator 7): BM25 over test items with block-max WAND.

The test items are the indexed side; every passage of every document is a query. Items are indexed
by length class (powers of two and those between); a class of items of up to L words is searched with
passages of 2 L words every L words, so a run of up to L words lies wholly inside one of them.

A retrieved item is verified on the passage's five-word shingles: the first half of an item's
shingles stands for the question, the rest for the answer. A pair is contaminated if one passage
holds at least FOUND percent of all the item's shingles and PART_FOUND percent of those of each part.

An item's threshold follows from that: of n shingles at most n - ceil(0.75 n) may be missing, so at most that many
words of the item, and the threshold is its own BM25 score less the most these can weigh. No pair that
would be verified is missed, whatever the words weigh. Impacts are divided by the threshold, so 1 retrieves.

Block-max WAND runs for several passages of a text at once. A passage's terms are sorted by their largest
impact; those that cannot reach 1 together never propose anything, and their postings, the longest, are
not walked. Blocks of BLOCK neighbouring items that the others propose are bounded by block maxima, the
passed-over terms by their list maxima; where the bound reaches 1, the passed-over terms are sought in that block alone,
the bound is drawn again, and only then items are scored. At most STEP postings are laid out at a
time: passages, then ranges of blocks, are taken in parts where there are more.

The index is sent to all tasks, about 7 bytes a character of its items (110 MB for MAX_INDEX_CHARS); items beyond MAX_INDEX_CHARS are taken in slices,
each with its own index and pass. Document frequencies and mean length are those of all items, and
verified pairs do not depend on the slices.

Defined results: null or empty texts and items hold nothing and give no pairs; an item of fewer than
five words is one shingle; rows and items with null ids and repeated ones give a pair each; of several passages that hold an
item the one with most of its shingles counts, then of its question; a very long text is searched passage by
passage, its words are held as numbers; an empty table gives no rows. Words are lower-cased runs without ASCII punctuation
and white space. Other columns are not read. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, received, send, settle

K1, B = 1.2, 0.75
#: Neighbouring items in a block.
BLOCK = 4
#: Postings, passage words and passages times blocks that are laid out at once.
STEP = 1_000_000
SHINGLE = 5
#: Percent of an item's shingles found, and of those of each part.
FOUND, PART_FOUND = 75, 50
#: Characters of items in one index.
MAX_INDEX_CHARS = 16_000_000
#: Impacts are sums of 32-bit floats.
EDGE = 1 - 1e-4

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SPACES = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACES).split() if text else []


def _class_of(n: int) -> int:
    """The least size of 8, 12, 16, 24, 32, ... that n words fit in."""
    top = max(8, 1 << (n - 1).bit_length())
    return top * 3 // 4 if n <= top * 3 // 4 and top > 8 else top


def shingles(words: list) -> list[tuple]:
    if len(words) < SHINGLE:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width term numbers."""
    n = max(0, len(ids) - width + 1)
    h = np.full(n, np.uint64(width))
    for k in range(width):
        h = (h ^ (ids[k : k + n].astype(np.uint64) + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
    return h


def is_contaminated(n: int, question: int, answer: int) -> bool:
    half = (n + 1) // 2
    return 100 * (question + answer) >= FOUND * n and 100 * question >= PART_FOUND * half and 100 * answer >= PART_FOUND * (n - half)


def least_share(weights: np.ndarray, counts: np.ndarray, n: int) -> float:
    """Share of an item's own score that is left when the heaviest words that may be missing of its n shingles are."""
    missing = n - -(-FOUND * n // 100)
    order = np.argsort(-weights / counts, kind="stable")
    before = np.cumsum(counts[order]) - counts[order]
    gone = np.clip((missing - before) / counts[order], 0, 1)
    return 1 - float((gone * weights[order]).sum() / weights.sum())


class LengthClass:
    """Items of up to size words: an inverted index whose postings come in blocks of BLOCK neighbouring items.

    Terms are named by rank, the order of their largest impacts; 0 is every word that no item of the
    class has. A posting block has the key rank * blocks + block, the impact of each of its items and their maximum.
    """

    def __init__(self, size: int, items: np.ndarray, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        """items: positions of the class's items; owner, term, impact: their postings, owner counted within the class."""
        self.size, self.items = size, items
        self.blocks = -(-len(items) // BLOCK)
        most = np.zeros(terms + 1, np.float32)
        np.maximum.at(most, term, impact)
        order = np.argsort(most, kind="stable")
        absent = int((most == 0).sum())
        self.rank = np.zeros(terms + 1, np.int32)
        self.rank[order[absent:]] = np.arange(1, terms + 2 - absent)
        self.most = np.concatenate([np.zeros(1, np.float32), most[order[absent:]]])
        key = self.rank[term].astype(np.int64) * self.blocks + owner // BLOCK
        self.keys, at = np.unique(key, return_inverse=True)
        self.impacts = np.zeros((len(self.keys), BLOCK), np.float32)
        self.impacts[at, owner % BLOCK] = impact
        self.block_max = self.impacts.max(axis=1)
        self.block = (self.keys % self.blocks).astype(np.int32)

    def search(self, ids: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Passage start, item position and score over threshold of all items that a passage retrieves."""
        size, n = self.size, len(ids)
        ranks = self.rank[ids]
        starts = np.arange(0, max(1, n - size), size)
        # the upper bounds of all terms together, repeats included, first
        summed = np.concatenate([[0.0], np.cumsum(self.most[ranks], dtype=np.float64)])
        starts = starts[summed[np.minimum(starts + 2 * size, n)] - summed[starts] >= EDGE]
        step = max(1, STEP // max(self.blocks, 2 * size))
        for i in range(0, len(starts), step):
            own = starts[i : i + step]
            at = own[:, None] + np.arange(2 * size)
            r = np.where(at < n, ranks[np.minimum(at, n - 1)], 0)
            r.sort(axis=1)
            again = r[:, 1:] == r[:, :-1]
            r[:, 1:][again] = 0
            upto = np.cumsum(self.most[r], axis=1, dtype=np.float64)
            live = upto[:, -1] >= EDGE
            if live.any():
                r, upto, own = r[live], upto[live], own[live]
                proposes = (upto >= EDGE) & (r > 0)
                rest = np.where(upto < EDGE, upto, 0).max(axis=1)
                p, b = self._proposed(r, rest, proposes, 0, self.blocks)
                for k, item, score in self._scored(r, p, b):
                    yield int(own[k]), item, score

    def _proposed(self, r: np.ndarray, rest: np.ndarray, proposes: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Passages and blocks from first to last whose bound reaches 1."""
        p, column = np.nonzero(proposes)
        base = r[p, column].astype(np.int64) * self.blocks
        low, high = np.searchsorted(self.keys, base + first), np.searchsorted(self.keys, base + last)
        n = high - low
        total = int(n.sum())
        if total > STEP and len(r) > 1:
            half = len(r) // 2
            a, b = (self._proposed(r[s], rest[s], proposes[s], first, last) for s in (slice(half), slice(half, None)))
            return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]])
        if total > STEP and last - first > 1:
            middle = (first + last) // 2
            a, b = self._proposed(r, rest, proposes, first, middle), self._proposed(r, rest, proposes, middle, last)
            return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        posting = np.repeat(low - np.cumsum(n) + n, n) + np.arange(total)
        span = last - first
        bound = np.bincount(np.repeat(p, n) * span + self.block[posting] - first, self.block_max[posting], len(r) * span).reshape(len(r), span)
        p, b = np.nonzero((bound > 0) & (bound + rest[:, None] >= EDGE))
        return p, b + first

    def _scored(self, r: np.ndarray, p: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, float]]:
        step = max(1, STEP // r.shape[1])
        for i in range(0, len(p), step):
            own, block = p[i : i + step], b[i : i + step]
            ranks = r[own]
            row, column = np.nonzero(ranks)
            key = ranks[row, column].astype(np.int64) * self.blocks + block[row]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            row, at = row[hit], at[hit]
            high = np.bincount(row, self.block_max[at], len(own)) >= EDGE
            row, at = row[high[row]], at[high[row]]
            for c in range(BLOCK):
                score = np.bincount(row, self.impacts[at, c], len(own))
                for k in np.flatnonzero(score >= EDGE).tolist():
                    yield int(own[k]), int(self.items[block[k] * BLOCK + c]), float(score[k])


class ItemIndex:
    """A slice of the items: their shingles, and an index for each length class."""

    def __init__(self, items: list[tuple[int, list[bytes]]], df: dict[bytes, int], count: int, mean: float):
        """items: id and words; df, count and mean: of all items, of other slices too."""
        self.ids = [i for i, _ in items]
        self.terms = {t: k for k, t in enumerate(df)}
        idf = np.array([math.log(1 + (count - n + 0.5) / (n + 0.5)) for n in df.values()])
        self.shingles, self.widths, self.shares = [], [], []
        by_size: dict[int, list] = {}
        for k, (_, words) in enumerate(items):
            at = np.fromiter((self.terms[w] for w in words), np.int64, len(words))
            self.widths.append(min(SHINGLE, len(words)))
            self.shingles.append(shingle_hashes(at, self.widths[-1]))
            term, n = np.unique(at, return_counts=True)
            weights = idf[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean))
            self.shares.append(least_share(weights, n, len(self.shingles[-1])))
            by_size.setdefault(_class_of(len(words)), []).append((k, term, weights / weights.sum() / self.shares[-1]))
        self.classes = [
            LengthClass(
                size, np.array([k for k, _, _ in rows]), np.repeat(np.arange(len(rows)), [len(t) for _, t, _ in rows]),
                np.concatenate([t for _, t, _ in rows]), np.concatenate([w for _, _, w in rows]).astype(np.float32), len(self.terms),
            )
            for size, rows in sorted(by_size.items())
        ]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.terms.get, words, repeat(len(self.terms))), np.int64, len(words))

    def pairs(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """Item position, share of its own score, shingles, and how many of the question's and the answer's a passage holds: the verified items of a text."""
        words = tokens(text)
        if not words:
            return []
        ids, hashes, best = self.numbers(words), {}, {}
        for c in self.classes:
            for start, item, score in c.search(ids):
                width, own = self.widths[item], self.shingles[item]
                if width not in hashes:
                    hashes[width] = shingle_hashes(ids, width)
                found = np.isin(own, hashes[width][start : start + 2 * c.size - width + 1])
                half = (len(own) + 1) // 2
                q, a = int(found[:half].sum()), int(found[half:].sum())
                if is_contaminated(len(own), q, a):
                    best[item] = max(best.get(item, (0, 0, 0.0)), (q + a, q, score * self.shares[item]))
        return [(item, score, len(self.shingles[item]), q, both - q) for item, (both, q, score) in sorted(best.items())]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pa.array([tokens(t.as_py()) for t in batch.column("text")], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), batch.column("chars"), words], ["item", "item_id", "chars", "words"])


def _pairs(sent) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = received(sent)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                out += [(doc, index.ids[item], *rest) for item, *rest in index.pairs(text.as_py())]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "item_shingles", "question_found", "answer_found"])

    return run


def _clean(sent) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = received(sent)
        for batch in batches:
            yield batch.filter(pa.array([not index.pairs(t.as_py()) for t in batch.column("text")], pa.bool_()))

    return run


def _indexes(items: DataFrame) -> Iterator:
    """A broadcast index for each slice of the items."""
    spark = items.sparkSession
    items = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.length("text").cast("long").alias("chars"), "text")
    items = settle(items.mapInArrow(_words, "item long, item_id long, chars long, words array<binary>").where(F.size("words") > 0), "bench-items")
    total = items.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.sum("chars").alias("chars")).first()
    df = settle(items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "bench-terms")
    slices = 1 + (total["chars"] or 0) // MAX_INDEX_CHARS
    for k in range(slices if total["n"] else 0):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == k)
        own = df.join(part.select(F.explode("words").alias("word")).distinct(), "word").orderBy("word")
        yield send(spark, ItemIndex([(r["item_id"], [bytes(w) for w in r["words"]]) for r in part.orderBy("item").collect()], {bytes(r["word"]): r["n"] for r in own.collect()}, total["n"], total["mean"]))
    discard(items, df)


def contaminated_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, item_shingles, question_found, answer_found: one row per contaminated pair."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, score double, item_shingles long, question_found long, answer_found long"
    found = [docs.mapInArrow(_pairs(index), schema) for index in _indexes(items)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose own text holds no item, each judged by itself whatever its id."""
    for index in _indexes(items):
        docs = docs.mapInArrow(_clean(index), docs.schema)
    return docs
