import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sylva.llm import periodic
from sylva.llm.periodic import RunFinder, Words, candidate_stretches, periodic_runs, rewritten, runs_of, s_factors
from sylva.llm.queries_text import OP11_SQL, op11_periodic_runs

from .oracles import connection


def plain_runs(w, shortest=12):
    """Every period over every place."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(shortest, 2 * q) and i > s:
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def periodic_words(rng, k, n):
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4) if n else 0):
        a = rng.randrange(n)
        p = 1 + rng.randrange(1 + (n - a) // 3)
        for i in range(a, rng.randrange(a, n + 1)):
            w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("letters", [1, 2, 3, 8, 50])
def test_runs_equal_every_period_over_every_place(letters):
    rng = random.Random(letters)
    for _ in range(400):
        w = periodic_words(rng, letters, rng.randrange(150))
        for shortest in (2, 5, 12):
            assert runs_of(w, shortest) == plain_runs(w, shortest)
        assert RunFinder().find([[b"w%d" % c for c in w]], Words()) == [plain_runs(w)]


def test_fibonacci_words_and_powers():
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    for w in (b, [0] * 500, [0, 1] * 300, [*range(40)] * 7, [*range(500)], [1, 0, 0] * 50 + [0, 0] * 40):
        assert runs_of(w) == plain_runs(w)


def test_factors_are_the_longest_that_occur_before():
    rng = random.Random(3)
    for _ in range(200):
        w = periodic_words(rng, rng.choice([1, 2, 4]), rng.randrange(80))
        at = 0
        for b, size, source in s_factors(w):
            longest = max((k for s in range(b) for k in range(1, len(w) - b + 1) if w[s : s + k] == w[b : b + k]), default=0)
            assert b == at and size == max(1, longest) and (w[source : source + size] == w[b : b + size] and 0 <= source < b if longest else source == -1)
            at += size
        assert at == len(w)


def test_stretches_hold_all_runs_and_leave_plain_text_out():
    import numpy as np

    rng = random.Random(5)
    texts = [periodic_words(rng, 20, rng.randrange(300)) for _ in range(60)]
    ids, owner = np.array([x for t in texts for x in t]), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = np.zeros(len(ids), bool)
    for s, e in candidate_stretches(ids, owner):
        assert owner[s] == owner[e - 1]
        inside[s:e] = True
    at = 0
    for t in texts:
        assert all(inside[at + s : at + s + n].all() for s, n, _ in plain_runs(t))
        at += len(t)
    assert candidate_stretches(np.arange(5000), np.zeros(5000, int)) == []
    far = np.tile(np.append(np.arange(1000, 1030), 0), 2)
    far = np.concatenate([far[:31], np.arange(200), far[31:]])  # a passage that comes again 200 words later repeats, but is in no run
    assert candidate_stretches(far, np.zeros(len(far), int)) == []


def test_chunks_change_nothing(monkeypatch):
    rng = random.Random(8)
    rows = [(k, [b"%d" % c for c in periodic_words(rng, 3, rng.randrange(200))]) for k in range(50)]
    want = [r for c in RunFinder().chunks(iter(rows)) for r in c]
    monkeypatch.setattr(periodic, "CHUNK_WORDS", 100)
    monkeypatch.setattr(periodic, "REMEMBERED", 2)
    assert [r for c in RunFinder().chunks(iter(rows)) for r in c] == want


def test_query_equals_its_sql(spark, tiny):
    got, want = op11_periodic_runs(spark, tiny), connection(tiny).execute(OP11_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_rows_of_every_kind(spark, docs, texts, clash, same):
    found = periodic_runs(docs, rewrite=rewritten)
    rows = found.collect()
    assert len(rows) == docs.count()
    for r, text in zip(sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: r["doc_id"])[: len(texts) - 2], texts, strict=False):
        words = rewritten(r["doc_id"], (text or "").encode().split())
        runs = plain_runs(words) if len(words) < 1000 or len(set(words)) == 1 and len(words) < 100 else [tuple(map(int, x.split(","))) for x in r["runs"].splitlines()]
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert (r["n_words"], r["n_runs"], r["runs"]) == (len(words), len(runs), "".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert bytes(r["collapsed"]) == left and r["collapsed_sha256"] == hashlib.sha256(left).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert best == (None if r["start"] is None else (r["start"], r["length"], r["period"]))
        assert r["exponent_milli"] == (None if best is None else 1000 * best[1] // best[2])
    same(periodic_runs(clash(docs), rewrite=rewritten), found)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_long_texts(spark):
    text = " ".join(["a b c"] * 40_000 + [f"w{k}" for k in range(50_000)] + ["x y"] * 30_000)
    got = periodic_runs(spark.createDataFrame([(None, text)], "doc_id long, text string")).select("n_words", "runs", F.length("collapsed").alias("n")).first()
    assert got["n_words"] == 230_000 and got["runs"].splitlines() == ["0,120000,3", "170000,60000,2"]
