"""Periodic run detection (operator 11): Kolpakov-Kucherov on the words of whole texts.

A run is a stretch of words with smallest period q and at least max(SHORTEST, 2 q) words that no neighbour extends with period q.
A stretch of a text is divided into the factors of its s-factorisation: each is the longest prefix of the rest that
occurs before, read from a suffix automaton whose states know where they end first. Main's algorithm finds, at the start of
each factor, the runs that cross or touch it, by the longest common extensions of every period to both sides. A run that lies
strictly inside a factor is that factor's earlier occurrence again and is copied from there.

Runs need repeats, so words that can be in none are left out before: a run of period q repeats max(q, SHORTEST - q) words
at distance q, so each of its words is in a gram of 2**k words (6 at least) whose equal is less than 2**(k+1) words away,
for the k that q lies in. Stretches of such words are searched, all others are not; equal hashes of unequal grams only make a
stretch longer. Texts are judged each on its own: no shuffle, a task holds a chunk of texts, a lost executor costs its tasks.

Defined results: a null text has no words and no runs; so have empty and blank texts; a null id is never rewritten; repeated
rows are judged each on its own; of a stretch with several periods the smallest counts; of equally long runs the first, then the one
with the smaller period is the longest; a very long text is searched whole by one task in memory proportional to its words
and time proportional to words plus runs; an empty table gives no rows; columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words of a run, at least.
SHORTEST = 12
#: Words that one pass over texts holds, about; a longer text is a pass of its own.
CHUNK_WORDS = 200_000
#: Words remembered by one worker; the memory starts anew beyond that.
REMEMBERED = 150_000


def s_factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start) of each factor; the earlier start of a word that is new is -1.

    A state of the automaton keeps its first transition in two arrays and only further ones in a dictionary: most states
    have one.
    """
    link, length, first = array("i", [-1]), array("i", [0]), array("i", [-1])
    letter, target, more = array("i", [-1]), array("i", [-1]), {}
    last = 0
    for i, c in enumerate(w):
        new = len(link)
        link.append(0)
        length.append(i + 1)
        first.append(i)
        letter.append(-1)
        target.append(-1)
        p = last
        while p >= 0:
            if letter[p] < 0:
                letter[p], target[p] = c, new
            elif letter[p] == c:
                break
            elif p in more:
                if c in more[p]:
                    break
                more[p][c] = new
            else:
                more[p] = {c: new}
            p = link[p]
        last = new
        if p < 0:
            continue
        q = target[p] if letter[p] == c else more[p][c]
        if length[q] == length[p] + 1:
            link[new] = q
            continue
        twin = len(link)
        link.append(link[q])
        length.append(length[p] + 1)
        first.append(first[q])
        letter.append(letter[q])
        target.append(target[q])
        if q in more:
            more[twin] = dict(more[q])
        link[q] = link[new] = twin
        while p >= 0:
            if letter[p] == c:
                if target[p] != q:
                    break
                target[p] = twin
            elif p in more and more[p].get(c) == q:
                more[p][c] = twin
            else:
                break
            p = link[p]
    out, n, b = [], len(w), 0
    while b < n:
        state, j = 0, b
        while j < n:
            c = w[j]
            to = target[state] if letter[state] == c else more[state][c]
            if first[to] >= j:
                break
            state = to
            j += 1
        if j == b:
            out.append((b, 1, -1))
            b += 1
        else:
            out.append((b, j - b, first[state] - (j - b) + 1))
            b = j
    return out


def _common_prefixes(pattern: list[int], text: list[int]) -> np.ndarray:
    """For each place of text the words that it has in common with the start of pattern; by the Z algorithm over both."""
    s = [*pattern, -1, *text]
    n, left, right = len(s), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k > right - i:
                k = right - i
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            if k:
                left, right = i, i + k
        z[i] = k
    return np.array(z[len(pattern) + 1 :], np.int64)


def _meeting(w: list[int], at: int, before: int, end: int, most: int, shortest: int) -> list[tuple[int, int, int]]:
    """Main's algorithm: (start, end, period) of the maximal repetitions around place at that end by end, of periods up to most."""
    t, u = w[before:at], w[at:end]
    ahead = _common_prefixes(u, [*t, *u])
    behind = _common_prefixes(t[::-1], [*u[::-1], *t[::-1]])
    nt, nu = len(t), len(u)
    found = []
    p = np.arange(1, min(nu, most) + 1)
    forth = np.append(ahead[nt + 1 :], 0)[: len(p)]
    back = behind[nu - p]
    found.append((at - back, at + p + forth, p, back + forth))
    p = np.arange(1, min(nt, most) + 1)
    forth = ahead[nt - p]
    back = np.append(behind[nu + 1 :], 0)[: len(p)]
    found.append((at - p - back, at + forth, p, back + forth))
    out, n = [], len(w)
    for starts, ends, periods, both in found:
        for k in np.flatnonzero((both >= periods) & (ends - starts >= shortest)).tolist():
            s, e, p = int(starts[k]), int(ends[k]), int(periods[k])
            if (s == 0 or w[s - 1] != w[s - 1 + p]) and (e == n or w[e] != w[e - p]):
                out.append((s, e, p))
    return out


def runs_of(w: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least so many words, by start, then period.

    A run that crosses the start of a factor begins less than a period before the factor before: what repeats at its period would
    have made that factor longer. So its period is below the length of both factors, and Main's algorithm needs no
    words further back than twice the factor before and this one.
    """
    factors = s_factors(w)
    n, known = len(w), {}

    def note(s: int, e: int, p: int) -> None:
        at = known.setdefault(s, {})
        if p < at.get(e, p + 1):
            at[e] = p

    last = 0
    for b, size, source in [*factors, (n, 0, -1)]:
        if 2 * (last + size) - 2 >= shortest:
            for s, e, p in _meeting(w, b, max(0, b - 2 * last - size), b + size, last + size - 1, shortest):
                note(s, e, p)
        if known and source >= 0 and size >= shortest + 2:
            shift = b - source
            for s in range(source + 1, source + size - shortest):
                if s in known:
                    for e, p in list(known[s].items()):
                        if e < source + size:
                            note(s + shift, e + shift, p)
        last = size
    return sorted((s, e - s, p) for s, at in known.items() for e, p in at.items())


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _near_equals(grams: np.ndarray, places: np.ndarray, width: int, within: int, n: int) -> np.ndarray:
    """Which of n places are in a gram of so many words whose equal starts less than within places away."""
    order = np.argsort(grams, kind="stable")
    sorted_grams, at = grams[order], places[order]
    same = np.flatnonzero((sorted_grams[1:] == sorted_grams[:-1]) & (at[1:] - at[:-1] < within))
    edges = np.zeros(n + 1, np.int32)
    hit = np.zeros(len(grams), bool)
    hit[order[same]] = hit[order[same + 1]] = True
    hits = places[hit]
    np.add.at(edges, hits, 1)
    np.add.at(edges, hits + width, -1)
    return np.cumsum(edges[:n]) > 0


def _stretches(mask: np.ndarray, owner: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of marked places of one owner."""
    if not mask.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.empty(len(mask), bool)
    new[0], new[1:] = mask[0], mask[1:] & (~mask[:-1] | (owner[1:] != owner[:-1]))
    starts = np.flatnonzero(new)
    stop = np.empty(len(mask), bool)
    stop[-1], stop[:-1] = mask[-1], mask[:-1] & (~mask[1:] | (owner[1:] != owner[:-1]))
    ends = np.flatnonzero(stop) + 1
    long = ends - starts >= shortest
    return starts[long], ends[long]


def candidate_stretches(ids: np.ndarray, owner: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that may be in a run; owner has the text of each word, texts in order."""
    n, least = len(ids), (shortest + 1) // 2
    if n < shortest:
        return []
    h = _spread(ids.astype(np.uint64) + np.uint64(1))
    gram = h[: n - least + 1].copy()
    for k in range(1, least):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[k : n - least + 1 + k]
    places = np.flatnonzero(owner[: n - least + 1] == owner[least - 1 :])
    own = _spread(gram[places] ^ _spread(owner[places].astype(np.uint64)))
    # any repeat in the same text
    starts, ends = _stretches(_near_equals(own, places, least, n, n), owner, shortest)
    if not len(starts):
        return []
    # words that are left, each stretch an owner of its own
    sizes = ends - starts
    part = np.repeat(np.arange(len(starts)), sizes)
    back = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    h, m, longest = h[back], len(back), int(sizes.max())
    mask = np.zeros(m, bool)
    width, gram = 1, h
    while width * 2 <= longest or width <= least:
        # grams of width words; those below the least width are taken at the least width
        if width >= least:
            places = np.flatnonzero(part[: m - width + 1] == part[width - 1 :])
            own = _spread(gram[places] ^ _spread(part[places].astype(np.uint64)))
            mask |= _near_equals(own, places, width, 2 * width, m)
        elif 2 * width > least:
            low = h[: m - least + 1].copy()
            for k in range(1, least):
                low = low * np.uint64(0x9E3779B97F4A7C15) + h[k : m - least + 1 + k]
            places = np.flatnonzero(part[: m - least + 1] == part[least - 1 :])
            own = _spread(low[places] ^ _spread(part[places].astype(np.uint64)))
            mask |= _near_equals(own, places, least, 2 * width, m)
        if m < 2 * width:
            break
        reach = m - 2 * width + 1
        gram = _spread(gram[:reach]) * np.uint64(0x9E3779B97F4A7C15) + gram[width : width + reach]
        width *= 2
    starts, ends = _stretches(mask, part, shortest)
    return [(int(back[s]), int(back[e - 1]) + 1) for s, e in zip(starts, ends, strict=True)]


class Words(dict):
    """word -> number."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class RunFinder:
    """Finds the runs of many texts, a chunk of them at a time."""

    def __init__(self, shortest: int = SHORTEST):
        self.shortest = shortest

    def find(self, texts: list[list[bytes]], numbers: Words) -> list[list[tuple[int, int, int]]]:
        """(start, length, period) of the runs of each text, given as its words."""
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.append(0, np.cumsum(sizes))
        ids = np.fromiter((k for t in texts for k in map(numbers.__getitem__, t)), np.int64, int(offsets[-1]))
        owner = np.repeat(np.arange(len(texts)), sizes)
        out: list[list] = [[] for _ in texts]
        for s, e in candidate_stretches(ids, owner, self.shortest):
            k = owner[s]
            shift = s - int(offsets[k])
            out[k] += [(start + shift, length, p) for start, length, p in runs_of(ids[s:e].tolist(), self.shortest)]
        return out

    def chunks(self, rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        """(doc_id, words, runs) of (doc_id, words), a chunk at a time."""
        numbers, chunk, held = Words(), [], 0
        for doc_id, words in rows:
            if chunk and held + len(words) > CHUNK_WORDS:
                yield [(k, w, r) for (k, w), r in zip(chunk, self.find([w for _, w in chunk], numbers), strict=True)]
                chunk, held = [], 0
                if len(numbers) > REMEMBERED:
                    numbers.clear()
            chunk.append((doc_id, words))
            held += len(words)
        if chunk:
            yield [(k, w, r) for (k, w), r in zip(chunk, self.find([w for _, w in chunk], numbers), strict=True)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that are in no run after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])


def rewritten(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the trial: in a tenth of the texts, told by the id, the words from some place on repeat the first of them."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // len(period) + 1))[: n - a]


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, rewrite: Callable | None = None, keep_text: bool = True) -> DataFrame:
    """One row for each row of docs: its runs as lines start,length,period, the longest of them, and the text without repeats.

    rewrite(doc_id, words) may change the words before; without keep_text only the digest of the text is returned.
    """
    kinds = {"doc_id": "long", "n_words": "long", "n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs": "string", "collapsed": "binary", "collapsed_sha256": "string"}
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own, split = doc_id.as_py(), text.as_py()
                split = split.split() if split else []
                yield own, rewrite(own, split) if rewrite else split

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in RunFinder(shortest).chunks(words(batches)):
            rows = []
            for doc_id, w, runs in chunk:
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                text = collapsed(w, runs)
                lines = "".join([f"{s},{n},{p}\n" for s, n, p in runs])
                rows.append((doc_id, len(w), len(runs), start, length, period, 1000 * length // period if runs else None, lines, text if keep_text else None, hashlib.sha256(text).hexdigest()))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").mapInArrow(found, ", ".join(f"{n} {k}" for n, k in kinds.items()))
