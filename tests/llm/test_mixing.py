import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sylva.llm import mixing
from sylva.llm.mixing import fair_schedule, source_targets
from sylva.llm.queries_native import OP9_SQL, op9_mix_sources

from .oracles import assert_same, connection


def refilled(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > limit * sizes[s]]
        if not over:
            return capped | {s: level * w[s] for s in free}
        for s in over:
            capped[s] = limit * sizes[s]
            left -= capped[s]


@pytest.mark.parametrize("seed", range(8))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 1_000, 50_000]) for s in [f"s{k}" for k in range(rng.randrange(1, 12))] + [None]}
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (3, 1, 2), 1.5, 2).collect()}
    want = refilled(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * (1 + want[s]) for s in want)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.choice([1, 20, 300])), rng.choice(["big"] * 8 + ["b", "c", "é", None])) for k in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_each_source_gets_its_target(mixed):
    rows = fair_schedule(mixed).collect()
    taken, target, size, by_doc = defaultdict(int), {}, {}, defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["words"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
        by_doc[r["doc_id"], r["size"]] += r["words"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(0 <= w <= 2 * n for (_, n), w in by_doc.items())


def test_virtual_times(mixed):
    rows = fair_schedule(mixed).collect()
    rows.sort(key=lambda r: r["finish"])
    queues = defaultdict(list)
    for r in rows:
        queues[r["source"]].append(r)
    for own in queues.values():
        own.sort(key=lambda r: (r["start"], r["finish"]))
        assert all(abs(a["finish"] - b["start"]) < 1e-9 for a, b in zip(own, own[1:], strict=False))
        # what ends by time 1 is taken whole, what begins after it not at all
        for r in own:
            assert r["words"] == (r["size"] if r["finish"] <= 1 - 1e-9 else 0 if r["start"] >= 1 + 1e-9 else r["words"])


def test_buckets_and_runs_do_not_matter(mixed, monkeypatch, same):
    first = fair_schedule(mixed)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    same(first, fair_schedule(mixed.repartition(7)))


def test_cases(spark, docs, clash, same):
    assert fair_schedule(docs.limit(0)).count() == 0
    rows = fair_schedule(docs).collect()
    assert len(rows) == 2 * docs.count() and sum(r["words"] for r in rows if r["size"] == 0) == 0
    empty = fair_schedule(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert {r["target"] for r in empty} == {0.0} and {r["words"] for r in empty} == {0}
    same(fair_schedule(clash(docs)), fair_schedule(docs))


def test_query(spark, tiny):
    assert_same(spark, tiny, op9_mix_sources, OP9_SQL)


def as_documents(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(folder / "raw"))
    next((folder / "raw").glob("part-*")).rename(folder / "documents.parquet")
    return str(folder)


REPEATED = [(1, "", "a"), (1, "", "a"), (1, None, "a"), (None, None, None), (None, None, None), (2, "x y", "a"), (2, "x y", "a"), (3, "", "b"), (3, "", "b"), (None, "p q r", "b"), (None, "s t u", "b"), (None, "v", "b")]


@pytest.mark.parametrize("rows", [REPEATED, [(k % 3, None, "ab"[k % 2]) for k in range(7)], [], [(5, "one two three", "a")] * 40 + REPEATED, [(1, "a", "z")]])
def test_query_on_repeated_and_empty_rows(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(mixing, "OPEN", 8)
    folder = as_documents(spark, rows, tmp_path)
    got, want = op9_mix_sources(spark, folder), connection(folder).execute(OP9_SQL)
    assert got.columns == [c[0] for c in want.description] and got.count() == len(rows)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_the_mix_ends_at_the_budget(mixed):
    rows = fair_schedule(mixed).collect()
    sizes = {r["source"]: r["source_size"] for r in rows}
    assert sum(r["words"] for r in rows) <= -(-3 * sum(sizes.values()) // 2)
