import random
from collections import defaultdict

import pytest

from sylva.llm.graph import components
from sylva.llm.near_dedup import near_duplicates


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\v\f\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out + [word] if word else out


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of each row by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group[top(a)] = top(b)
    least = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(k)].append(doc)
    out = []
    for k, (doc, _) in enumerate(rows):
        c = min(least[top(k)], default=None)
        out.append((doc, len(sets[k]), c, c is None or doc == c))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def varied(rng, base, share):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) if rng.random() < share else w for w in base.split())


def test_against_all_pairs(spark):
    rng = random.Random(3)
    rows, vocabulary = [], [f"w{k}" for k in range(400)]
    for g in range(12):
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120, 300])))
        for _ in range(rng.choice([1, 2, 8, 20])):
            rows.append((len(rows) * 7 % 1009 + 2000 * g, varied(rng, base, rng.choice([0, 0.005, 0.02, 0.05]))))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(50_000 + k, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 15, 40])))) for k in range(40)]
    assert run(spark, rows) == brute(rows)


def test_a_chain_of_copies_is_one_component(spark):
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(15):
        rows.append((100 - k, " ".join(base)))
        base[k * 8] = f"new{k}"
    assert {r[2] for r in run(spark, rows)} == {86}
    assert run(spark, rows) == brute(rows)


def test_cases(spark, docs, texts):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert run(spark, rows) == brute(rows)


def test_repeated_ids_with_other_texts(spark):
    long = " ".join(f"q{k}" for k in range(50))
    rows = [(5, long), (5, "something else entirely in these seven words"), (3, long), (5, long), (None, long), (None, "null id alone here now yes")]
    assert run(spark, rows) == brute(rows)


def test_case_and_space(spark):
    rows = [(1, "A b  C\td e f g"), (2, "a B c d\ne F g"), (3, "É b c d e f g"), (4, "é b c d e f g"), (5, "a b c"), (6, "A  B\nC")]
    assert {r[0]: r[2] for r in run(spark, rows)} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}


def test_empty_and_clashing(spark, docs, clash, same):
    assert near_duplicates(docs.limit(0)).count() == 0
    same(near_duplicates(clash(docs)), near_duplicates(docs))


@pytest.mark.parametrize("edges,expected", [([], {}), ([(1, 1)], {}), ([(5, 4), (4, 3), (9, 8), (3, 2), (7, 8)], {5: 2, 4: 2, 3: 2, 9: 7, 8: 7}), ([(k, k + 1) for k in range(40)], {k + 1: 0 for k in range(40)})])
def test_components(spark, edges, expected):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["id"]: r["root"] for r in components(df).collect()} == expected


def test_hot_sets_and_stars(spark, docs, monkeypatch, same):
    """Keys of many rows take the other way of the joins, with the same result."""
    from sylva.llm import graph

    want = near_duplicates(docs).collect()
    edges = spark.createDataFrame([(1, k) for k in range(2, 60)] + [(k, k + 100) for k in range(2, 30)] + [(500, 501)], "a long, b long")
    roots = {(r["id"], r["root"]) for r in graph.components(edges).collect()}
    monkeypatch.setattr(graph, "HOT", 1)
    assert sorted(map(repr, map(tuple, near_duplicates(docs).collect()))) == sorted(map(repr, map(tuple, want)))
    assert {(r["id"], r["root"]) for r in graph.components(edges).collect()} == roots
    assert roots == {(k, 1) for k in (*range(2, 60), *range(102, 130))} | {(501, 500)}


def test_blocks_of_any_size_flag_the_same(spark):
    """Small blocks whose pairs are made at once, larger ones and blocks over several batches."""
    import numpy as np
    import pandas as pd

    from sylva.llm import near_dedup as nd

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, (40, 128)).astype("<u2")
    rows = []
    for block in range(30):
        for _ in range(int(rng.choice([2, 3, 10, 80]))):
            sig = base[rng.integers(0, 40)].copy()
            sig[rng.integers(0, 128, int(rng.choice([0, 5, 40])))] = 7
            rows.append((block, 31, 0, 0, 0, len(rows), 50, int(rng.integers(0, 4)), sig.tobytes()))
    pdf = pd.DataFrame(rows, columns=["bucket", "band", "lo", "hi", "side", "v", "n_shingles", "comp", "sig"])
    want = set()
    for _, own in pdf.groupby("bucket"):
        sigs = [np.frombuffer(s, "<u2") for s in own["sig"]]
        for i in range(len(own)):
            for k in range(i + 1, len(own)):
                same_band = any((sigs[i].view("<u8")[j] == sigs[k].view("<u8")[j]) for j in range(31))
                if own["comp"].iloc[i] != own["comp"].iloc[k] and (sigs[i] == sigs[k]).mean() >= nd.SCREEN and not same_band:
                    want |= {int(own["v"].iloc[i]), int(own["v"].iloc[k])}
    for size in (7, 50, 10_000):
        got = pd.concat(list(nd._flag(pdf.iloc[i : i + size] for i in range(0, len(pdf), size))))
        assert set(got["v"]) == want
