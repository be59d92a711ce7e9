"""MinHash near-dedup (operator 1) with min-max hashing.

Every permutation gives two values of a document's shingle set, its minimum and its maximum, so 64
hash evaluations per shingle make a signature of 128. Bands of four values propose candidates; links
are confirmed on the full sets (100 * intersection >= 75 * union).

No group is expanded into pairs. Equal sets are one vertex. In a bucket every vertex is compared
with one hub, another one in each band: first with the best of its hubs, then with the others that
are still in another component. Buckets that hold several components after that are gone through
completely in blocks of bounded size: pairs across components whose signatures agree often enough
(SCREEN, far below the limit) are confirmed on full sets inside the block, the likeliest first, and
only links that join two components leave it.

Defined results: null text, empty text and text without words have an empty set and are linked with
nothing (their own component, kept); repeated rows are returned as often as they come, and rows that
share a doc_id are each judged by their own text; a row with a null doc_id gets the component of its
set, or null and kept if no row with an id has that set; a similarity of exactly the limit links; a very long text is one
set in one task, 8 bytes a shingle, whose signature is made 4,096 shingles at a time; an empty table gives no rows. Columns other
than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle
from .graph import components, divided_join
from .shingles import WordHashes, jaccard_counts, shingle_set

PERMUTATIONS = 64
BAND_ROWS = 4
#: Percent of the union that linked documents share.
SIMILARITY = 75
#: Share of equal signature values below which no pair of the limit's similarity falls: four standard deviations.
SCREEN = 0.6
#: Documents for each file of the tables written on the way, at least.
FILE_ROWS = 20_000
#: Rows of a bucket that one task compares with as many others, and rows whose pairs are all made at once.
BLOCK, SMALL_BLOCK = 2_000, 64

_RNG = np.random.default_rng(20_240_501)
_A = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
#: Shingles hashed at once.
_STEP = 4_096


def signature(shingles: np.ndarray) -> bytes:
    """Minimum and maximum of the set under each permutation, 16 bits of a mix of each, permutation by permutation."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), _STEP):
        h = shingles[i : i + _STEP, None] * _A
        h += _B
        np.minimum(low, h.min(axis=0), out=low)
        np.maximum(high, h.max(axis=0), out=high)
    v = np.stack([low, high], axis=1).ravel()
    v ^= v >> np.uint64(31)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    return (v >> np.uint64(48)).astype("<u2").tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        n, key, sig = [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py(), hashes)
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
            ["doc_id", "text_hash", "n_shingles", "set_key", "sig"],
        )


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps pairs whose signatures agree often enough."""
    for pdf in batches:
        if len(pdf):
            a, b = (np.frombuffer(b"".join(pdf[c]), "<u2").reshape(len(pdf), -1) for c in ("sig_a", "sig_b"))
            alike = (a == b).mean(axis=1)
            yield pdf.loc[alike >= SCREEN, ["a", "b"]].assign(alike=alike[alike >= SCREEN])


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for pdf in batches:
        sets: dict = {}

        def known(vertex, text, sets=sets):
            if vertex not in sets:
                sets[vertex] = shingle_set(text, hashes)
            return sets[vertex]

        linked = []
        for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"], strict=True):
            both, union = jaccard_counts(known(a, ta), known(b, tb))
            linked.append(100 * both >= SIMILARITY * union)
        yield pdf.loc[linked, ["a", "b"]]


class _Block:
    """The rows of one or more blocks as arrays."""

    def __init__(self, pdf: pd.DataFrame):
        self.sig = np.frombuffer(b"".join(pdf["sig"]), "<u2").reshape(len(pdf), -1)
        self.bands = self.sig.view("<u8")
        self.band, self.side, self.comp, self.n, self.v = (pdf[c].to_numpy() for c in ("band", "side", "comp", "n_shingles", "v"))

    def _alike(self, i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are open, and in how many values their signatures agree."""
        found = np.flatnonzero((self.comp[i] != self.comp[k]) & (100 * np.minimum(self.n[i], self.n[k]) >= SIMILARITY * np.maximum(self.n[i], self.n[k])) & (self.v[i] != self.v[k]))
        i, k = i[found], k[found]
        # a row of equal marks is added up eight at a time
        marks = (self.sig[k] == self.sig[i]).view(np.uint64).sum(axis=1)
        equal = (marks * np.uint64(0x0101010101010101)) >> np.uint64(56)
        alike = np.flatnonzero(equal >= int(np.ceil(SCREEN * self.sig.shape[1])))
        i, k = i[alike], k[alike]
        band = int(self.band[i[0]]) if len(i) else 0
        own = ~(self.bands[k, :band] == self.bands[i, :band]).any(axis=1)
        return found[alike[own]], equal[alike[own]].astype(np.int32)

    def open_pairs(self, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, other rows and their signature agreement: pairs of the block from start to end in two components that look alike.

        Side 0 is compared with side 1, or with itself if there is no other side; it stands first. A pair belongs to the
        first band that both share, so it comes up in one bucket only.
        """
        first = start + int((self.side[start:end] == 0).sum())
        if first == end and end - start <= SMALL_BLOCK:
            i, k = (x + start for x in _TRIANGLES[end - start])
            at, equal = self._alike(i, k)
            if len(at):
                yield i[at], k[at], equal
            return
        for row in range(start, first):
            k = np.arange(row + 1, end) if first == end else np.arange(first, end)
            if len(k):
                i = np.full(len(k), row)
                at, equal = self._alike(i, k)
                if len(at):
                    yield i[at], k[at], equal


class _Triangles(dict):
    """Both rows of all pairs of so many rows, remembered."""

    def __missing__(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        found = self[m] = np.triu_indices(m, 1)
        return found

    def __reduce__(self):
        return _Triangles, ()


_TRIANGLES = _Triangles()


def _flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows that are in an open pair of their block; blocks follow each other, side 0 first, and may go on in the next batch."""
    held: pd.DataFrame | None = None

    def flagged(pdf: pd.DataFrame, bounds: list[int]) -> pd.DataFrame:
        block, marks = _Block(pdf), np.zeros(len(pdf), bool)
        for start, end in zip(bounds, bounds[1:], strict=False):
            for i, k, _ in block.open_pairs(start, end):
                marks[i] = True
                marks[k] = True
        return pdf.loc[marks]

    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        key = np.stack([pdf[c].to_numpy() for c in ("bucket", "lo", "hi")])
        bounds = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        held = pdf.iloc[bounds[-1] :].reset_index(drop=True)
        if len(bounds) > 1:
            yield flagged(pdf.iloc[: bounds[-1]], bounds)
    if held is not None and len(held):
        yield flagged(held, [0, len(held)])


def _settle_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links among the open pairs of a block, confirmed on full sets; pairs already joined by a link found here are passed over."""
    pdf = pdf.sort_values("side", kind="stable", ignore_index=True)
    open_ = list(_Block(pdf).open_pairs(0, len(pdf)))
    if not open_:
        return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
    left, right, alike = (np.concatenate(x) for x in zip(*open_, strict=True))
    order = np.argsort(-alike, kind="stable")
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    v, comp = pdf["v"].to_numpy(), pdf["comp"].to_numpy()
    parent: dict = {}

    def top(c):
        while (up := parent.get(c, c)) != c:
            parent[c] = c = parent.get(up, up)
        return c

    links = []
    for i, k in zip(left[order].tolist(), right[order].tolist(), strict=True):
        a, b = top(comp[i]), top(comp[k])
        if a != b:
            both, union = jaccard_counts(sets[i], sets[k])
            if 100 * both >= SIMILARITY * union:
                parent[max(a, b)] = min(a, b)
                links.append((v[i], v[k]))
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(t.as_py(), hashes).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(sets, pa.binary())], ["v", "shingles"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    return near_groups(docs).select("doc_id", "n_shingles", "component_id", "kept")


def near_groups(docs: DataFrame) -> DataFrame:
    """Beside these columns text_hash and comp, which names the group even where an id has texts of several; null without shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    files = max(12, docs.count() // FILE_ROWS)
    signed = settle(docs.mapInArrow(_sign, "doc_id long, text_hash long, n_shingles long, set_key binary, sig binary"), "dedup-signed", files)
    # nulls sort first in a struct, so rows without an id stand for no set
    firsts = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "sig")).alias("f"), F.count("*").alias("copies"))
    firsts = firsts.select("set_key", F.col("f.doc_id").alias("least"), "f.text_hash", "f.n_shingles", "f.sig", "copies")
    # a vertex is named by the least id of its set; where an id stands for several sets, by a hash of id and text
    twice = firsts.groupBy("least").agg(F.count("*").alias("sets")).where("sets > 1")
    name = F.when(F.col("sets").isNull(), F.col("least")).otherwise(F.xxhash64("least", "text_hash"))
    vertices = settle(firsts.join(twice, "least", "left").select(name.alias("v"), "set_key", "least", "text_hash", "n_shingles", "sig", "copies"), "dedup-vertices", files)

    width = 2 * BAND_ROWS
    bands = F.posexplode(F.expr(f"transform(sequence(0, {2 * PERMUTATIONS // BAND_ROWS - 1}), i -> xxhash64(i, substring(sig, i * {width} + 1, {width})))"))
    posted = vertices.select(bands.alias("band", "bucket"), "v", "n_shingles")
    shared = posted.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1")
    largest = vertices.count()  # a set is in a bucket once
    total = largest * (2 * PERMUTATIONS // BAND_ROWS)
    members = settle(divided_join(posted, shared, "bucket", "rows", total=total, largest=largest), "dedup-members", files)
    hubs = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "v").alias("h"), "v", "n_shingles")).alias("hub"), F.count("*").alias("rows"))
    near_size = f"100 * least(n_shingles, hub.n_shingles) >= {SIMILARITY} * greatest(n_shingles, hub.n_shingles)"
    stars = _ordered(divided_join(members, hubs, "bucket", "rows", total=total, largest=largest).where("v != hub.v").where(near_size).select(F.col("v").alias("a"), F.col("hub.v").alias("b"))).distinct()

    sig = vertices.select("v", "sig")
    texts = docs.select("doc_id", "text_hash", "text")

    def with_side(pairs: DataFrame, side: str, what: DataFrame, value: str) -> DataFrame:
        return pairs.join(what.select(F.col("v").alias(side), F.col(value).alias(f"{value}_{side}")), side)

    def texts_of(ends: DataFrame) -> DataFrame:
        """v, text: the texts of the vertices."""
        held = ends.distinct().join(vertices.select("v", "least", "text_hash"), "v")
        found = texts.join(held, (texts["doc_id"] == held["least"]) & (texts["text_hash"] == held["text_hash"])).select("v", "text")
        return found.dropDuplicates(["v"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that are links; the texts of both ends come from the documents."""
        pairs = settle(pairs.distinct(), "dedup-pairs", files)
        found = settle(texts_of(pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v")))), "dedup-texts", files)
        full = with_side(with_side(pairs, "a", found, "text"), "b", found, "text")
        links = settle(full.mapInPandas(_confirm, "a long, b long"), "dedup-links", files)
        discard(pairs, found)
        return links

    alike = settle(with_side(with_side(stars, "a", sig, "sig"), "b", sig, "sig").mapInPandas(_alike, "a long, b long, alike double"), "dedup-alike", files)
    ends = alike.select(F.col("a").alias("v"), "a", "b", "alike").unionByName(alike.select(F.col("b").alias("v"), "a", "b", "alike"))
    best = ends.groupBy("v").agg(F.max(F.struct("alike", "a", "b")).alias("p")).select("p.a", "p.b")
    links = confirmed(best)
    comps = components(links, "dedup-comps", files)

    def across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        roots = comps.select("id", "root")
        for side in ("a", "b"):
            pairs = pairs.join(roots.withColumnsRenamed({"id": side, "root": f"root_{side}"}), side, "left")
        return pairs.where("coalesce(root_a, a) != coalesce(root_b, b)").select("a", "b")

    def as_edges(comps: DataFrame) -> DataFrame:
        return comps.select(F.col("id").alias("a"), F.col("root").alias("b"))

    rest = across(alike.select("a", "b"), comps).join(best, ["a", "b"], "left_anti")
    links = confirmed(rest)
    comps = components(links.unionByName(as_edges(comps)), "dedup-comps", files)

    placed = members.join(comps.withColumnRenamed("id", "v"), "v", "left").select("bucket", "band", "v", "n_shingles", F.coalesce("root", "v").alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket", "rows", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    open_rows = divided_join(placed, mixed, "bucket", "rows", total=total, largest=largest).join(sig, "v")
    sided = open_rows.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1)
    sided = sided.select("bucket", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"), "v", "n_shingles", "comp", "sig")
    block = ["bucket", "lo", "hi"]
    # blocks are many and most are small, so a task takes all of its own in one pass instead of group by group
    flagged = settle(sided.repartition(*block).sortWithinPartitions(*block, "side", "v").mapInPandas(_flag, sided.schema), "dedup-open", files)
    sets_of = settle(texts_of(flagged.select("v")).mapInArrow(_to_sets, "v long, shingles binary"), "dedup-sets", files)
    with_sets = flagged.join(sets_of, "v")
    discard(members, alike)
    links = settle(with_sets.groupBy(*block).applyInPandas(_settle_pairs, "a long, b long"), "dedup-links", files)
    discard(flagged, sets_of)
    comps = components(links.unionByName(as_edges(comps)), "dedup-comps", files)

    placed = vertices.select("v", "set_key", "least", "copies").join(comps.withColumnRenamed("id", "v"), "v", "left").select("v", "set_key", "least", "copies", F.coalesce("root", "v").alias("comp"))
    joined = comps.select(F.col("root").alias("comp")).distinct()
    lows = placed.join(joined, "comp", "left_semi").groupBy("comp").agg(F.min("least").alias("low"))
    roots = settle(placed.join(lows, "comp", "left").select("set_key", "comp", F.coalesce("low", "least").alias("component_id"), "copies"), "dedup-roots", files)
    discard(vertices)
    # rows without a set meet nothing, those of a set with very many documents stay where they are
    rows = signed.select("doc_id", "text_hash", "n_shingles", "set_key")
    found = divided_join(rows.where("set_key is not null"), roots, "set_key", "copies", "left", signed.count())
    out = found.unionByName(rows.where("set_key is null"), allowMissingColumns=True)
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "comp", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
