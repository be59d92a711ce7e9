import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from sylva.llm import decontaminate as d
from sylva.llm.decontaminate import ItemIndex, clean_documents, contaminated_pairs, is_contaminated, shingles, tokens
from sylva.llm.queries_text import OP7_SQL, op7_decontaminate

from .oracles import assert_same

VOCABULARY = [f"w{k}" for k in range(60)] + [f"rare{k}" for k in range(600)]


def draw(rng, n):
    return " ".join(VOCABULARY[min(int(rng.expovariate(1 / 80)), len(VOCABULARY) - 1)] for _ in range(n))


def brute(docs, items):
    """Every item against every passage of 2 L words, every L words."""
    out = []
    for doc, text in docs:
        w = tokens(text)
        for item, body in items:
            own = shingles(tokens(body))
            if not own:
                continue
            size, width, half, best = d._class_of(len(tokens(body))), len(own[0]), (len(own) + 1) // 2, (0, 0)
            for start in range(0, max(1, len(w)), size):
                passage = w[start : start + 2 * size]
                have = {tuple(passage[i : i + width]) for i in range(len(passage) - width + 1)}
                q, a = sum(s in have for s in own[:half]), sum(s in have for s in own[half:])
                if is_contaminated(len(own), q, a):
                    best = max(best, (q + a, q))
            if best[0]:
                out.append((doc, item, len(own), best[1], best[0] - best[1]))
    return sorted(out)


def run(spark, docs, items):
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, contaminated_pairs(a, b).select("doc_id", "item_id", "item_shingles", "question_found", "answer_found").collect()))


@pytest.fixture(scope="module")
def case():
    rng = random.Random(9)
    items = [(k, draw(rng, rng.choice([3, 8, 20, 45, 130, 400]))) for k in range(60)]
    docs = []
    for k in range(150):
        w = draw(rng, rng.choice([0, 5, 60, 500, 2_000])).split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            own = tokens(rng.choice(items)[1])
            cut = rng.choice([1.0, 1.0, 0.9, 0.7, 0.4])
            part = [x.decode() for x in own[: max(1, int(len(own) * cut))]]
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((k, " ".join(w)))
    return docs, items


def test_against_all_pairs(spark, case):
    assert run(spark, *case) == brute(*case)


def test_slices_of_items_give_the_same(spark, case, monkeypatch):
    monkeypatch.setattr(d, "MAX_INDEX_CHARS", 4_000)
    assert run(spark, *case) == brute(*case)


def index_of(items):
    held = [(k, tokens(t)) for k, t in items if tokens(t)]
    df = Counter(w for _, own in held for w in set(own))
    return ItemIndex(held, dict(df), len(held), sum(len(w) for _, w in held) / len(held))


@pytest.mark.parametrize("step", [7, 500, d.STEP])
def test_retrieval_is_exhaustive(case, monkeypatch, step):
    monkeypatch.setattr(d, "STEP", step)
    docs, items = case
    index = index_of(items)
    for _, text in docs[:40]:
        ids = index.numbers(tokens(text))
        for c in index.classes if len(ids) else ():
            full = np.zeros((len(c.most), c.blocks * d.BLOCK))
            for at, key in enumerate(c.keys):
                rank, block = divmod(int(key), c.blocks)
                full[rank, block * d.BLOCK : (block + 1) * d.BLOCK] = c.impacts[at]
            want = {}
            for s in range(0, max(1, len(ids) - c.size), c.size):
                score = full[np.unique(c.rank[ids[s : s + 2 * c.size]])].sum(0)
                want |= {(s, int(c.items[k])): score[k] for k in np.flatnonzero(score >= d.EDGE)}
            got = {(s, item): score for s, item, score in c.search(ids)}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_pieces_far_apart_and_near(spark):
    rng = random.Random(4)
    item = [f"piece{k}" for k in range(26)]
    pieces = [item[k : k + 11] for k in (0, 5, 10, 15)]
    far = [w for x in pieces for w in (*x, *draw(rng, 300).split())]
    near = [w for x in pieces for w in (*x, "so")]
    docs, items = [(1, " ".join(far)), (2, " ".join(near)), (3, " ".join(item))], [(7, " ".join(item))] + [(k, draw(rng, 30)) for k in range(20, 40)]
    assert run(spark, docs, items) == brute(docs, items)
    assert [r[0] for r in brute(docs, items)] == [2, 3]


def test_rare_words_may_be_the_missing_ones(spark):
    items = [(k, " ".join(["plain"] * 3 + [f"w{(k + j) % 9}" for j in range(20)] + [f"only{k}{j}" for j in range(5)])) for k in range(30)]
    docs = [(k, " ".join(t.split()[:-5])) for k, t in items]
    found = run(spark, docs, items)
    assert found == brute(docs, items) and {(k, k) for k, _ in items} <= {r[:2] for r in found}


def test_large_index_stays_small(spark):
    rng = random.Random(3)
    items = [(k, " ".join(f"v{min(int(rng.expovariate(1 / 2_000)), 50_000)}" for _ in range(200))) for k in range(2_000)]
    index = index_of(items)
    chars = sum(len(t) for _, t in items)
    assert len(cloudpickle.dumps(index)) < 10 * chars
    tracemalloc.start()
    assert {index.ids[p[0]] for k in (3, 77) for p in index.pairs(items[k][1])} == {3, 77}
    assert tracemalloc.get_traced_memory()[1] < 300_000_000
    tracemalloc.stop()


def test_rows_are_kept_by_their_own_text(spark):
    item = "the quick brown fox jumps over the lazy dog near a river bank today"
    docs = spark.createDataFrame([(1, item, 5), (1, "clean words only in this one", 6), (None, f"so {item}", 7), (None, None, 8)], "doc_id long, text string, n int")
    kept = clean_documents(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(r["n"] for r in kept.collect()) == [6, 8] and kept.columns == docs.columns


def test_marks_and_case_do_not_hide(spark):
    item = "the quick brown fox jumps over the lazy dog near a river bank today"
    loud = "xx " + " ".join(w.upper() + "!!" for w in item.split()) + "*** yy"
    assert [r[:2] for r in run(spark, [(1, loud), (2, "the quick brown fox"), (3, item[: len(item) // 2])], [(7, item)])] == [(1, 7)]


def test_cases(spark, docs, clash, same):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, "one"), (5, "a row without an id, but with words enough for shingles"), (5, "one"), (None, "one")], "item_id long, text string")
    found = sorted(((r["doc_id"], r["item_id"]) for r in contaminated_pairs(docs, items).collect()), key=repr)
    assert found == sorted([(3, 4), (3, 5), (3, None), (None, 5)], key=repr)
    assert contaminated_pairs(docs.limit(0), items).count() == 0
    assert contaminated_pairs(docs, items.limit(0)).count() == 0
    same(contaminated_pairs(clash(docs), clash(items)), contaminated_pairs(docs, items))


def test_query(spark, tiny):
    assert_same(spark, tiny, op7_decontaminate, OP7_SQL)
