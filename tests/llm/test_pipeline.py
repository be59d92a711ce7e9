import re

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from sylva.llm.common import settle, table

from .test_near_dedup import brute as components_of
from .test_pii import by_pattern


@pytest.fixture(scope="module")
def stages(spark, tiny):
    docs, out = table(spark, tiny, "documents"), {}
    out["documents"] = docs
    for name, stage in cp.STAGES:
        docs = settle(stage(spark, docs, tiny), f"test-{name}")
        out[name] = docs
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_are_the_dealt_ones(stages):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "decontaminate", "personal_data", "mix"]
    for name, _ in cp.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_language_stage_drops_texts_without_a_language_only(stages):
    before, after = rows(stages["documents"]), rows(stages["language_id"])
    for k, r in before.items():
        assert (k in after) == bool(r["text"] and any(map(str.isalpha, r["text"])))


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after = rows(stages["language_id"]), rows(stages["near_dedup"])
    want = {c for _, _, c, _ in components_of([(k, r["text"]) for k, r in before.items()])}
    assert after.keys() == want


def test_decontamination_drops_leaks_only(spark, stages, tiny):
    items = [r["text"] for r in table(spark, tiny, "benchmark").collect()]
    words = lambda t: re.sub(r"[^\w]+|_", " ", t.lower()).split()
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words, items)]
    after = rows(stages["decontaminate"])
    for k, r in rows(stages["near_dedup"]).items():
        w = words(r["text"])
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        share = max(len(own & g) / len(g) for g in grams)
        assert (k in after) == (share < 0.75)


def test_personal_data_is_gone(stages):
    before, after = rows(stages["decontaminate"]), rows(stages["personal_data"])
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert not by_pattern(r["text"]) and r["n_chars"] == len(r["text"])
        if not re.search(r"[0-9@]", before[k]["text"]):
            assert r["text"] == before[k]["text"]


def test_mix_takes_the_budget(stages):
    before, after = rows(stages["personal_data"]), rows(stages["mix"])
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in before.values())
    assert abs(sum(r["taken"] for r in after.values()) - 1.5 * total) <= 20
    assert all(0 < r["taken"] <= 2 * r["size"] and r["text"] == before[k]["text"] for k, r in after.items())


def test_run_equals_its_stages(spark, stages, tiny, same):
    same(cp.run(spark, tiny), stages["mix"])


def test_cases(spark, docs, clash, tiny):
    wide = clash(docs)
    for name, stage in cp.STAGES:
        out = stage(spark, wide, tiny)
        if name != "mix":
            assert out.columns == wide.columns
        assert stage(spark, wide.limit(0), tiny).count() == 0
    assert cp.near_dedup(spark, docs, tiny).where(F.col("doc_id").isNull()).count() == 1
    named = [r["doc_id"] for r in cp.near_dedup(spark, docs, tiny).where("doc_id is not null").collect()]
    assert len(named) == len(set(named))
    assert cp.mix(spark, docs, tiny).where("taken > 2 * size").count() == 0


def test_near_dedup_of_one_id_for_different_texts(spark, tiny):
    a, b, c = ([f"{x}{k}" for k in range(60)] for x in "abc")
    near = " ".join([*c[:-1], "other"])
    a, b, c = (" ".join(x) for x in (a, b, c))
    rows = [(3, a), (5, a), (5, b), (5, b), (7, b), (9, c), (9, near), (9, a), (11, "!"), (11, "?"), (11, "?"), (None, a), (None, "only without an id " * 9), (None, "only without an id " * 9)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], table(spark, tiny, "documents").select("doc_id", "text", "lang", "source", "n_chars").schema)
    out = sorted(((r["doc_id"], r["text"]) for r in cp.near_dedup(spark, df, tiny).collect()), key=repr)
    left = [x for x in out if x[0] != 9]
    assert left == sorted([(3, a), (5, b), (11, "!"), (11, "?"), (None, "only without an id " * 9)], key=repr)
    assert [x for x in out if x[0] == 9] in ([(9, c)], [(9, near)])


def test_contaminated_rows_go_whatever_their_id(spark, tiny):
    item = max((r["text"] for r in table(spark, tiny, "benchmark").collect()), key=len)
    rows = [(1, item), (1, "other words that are no item of any kind at all"), (None, f"before {item} after"), (None, None)]
    df = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], table(spark, tiny, "documents").select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert [(r["doc_id"], r["text"]) for r in cp.decontaminate(spark, df, tiny).collect()] == [rows[1], rows[3]]


def test_models_reach_workers_without_the_package(tmp_path):
    """The operators with a model, run from elsewhere by workers that cannot import the package."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.abspath(cp.__file__))
    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
def blind(rows):
    try:
        import sylva
        return ["seen"]
    except ImportError:
        return ["blind"]
assert spark.sparkContext.parallelize([1], 1).mapPartitions(blind).collect() == ["blind"]
for name in ("op2_language_id", "op3_personal_data", "op5_nearest", "op6_quality", "op7_decontaminate", "op8_html_text"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0, name
print("all ran")
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_mix_of_tied_rows_loses_no_word(spark, tiny, monkeypatch):
    from sylva.llm import graph
    from sylva.llm.mixing import taken_words

    tied = [(1, f"one two {k % 3}", "en", "a", 9) for k in range(13)] + [(None, "null id", "en", None, 7)] * 5 + [(k, "w " * k, "en", "b", 2 * k) for k in range(2, 9)]
    docs = spark.createDataFrame(tied, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = {(r["doc_id"], r["source"], r["size"]): r["n"] for r in taken_words(docs).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("n")).collect()}
    for hot in (100_000, 6):
        monkeypatch.setattr(graph, "HOT", hot)
        got = cp.mix(spark, docs, tiny)
        have = {(r["doc_id"], r["source"], r["size"]): r["n"] for r in got.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("n")).collect()}
        assert have == {k: n for k, n in want.items() if n}
        shares = [r["taken"] for r in got.where("doc_id = 1").collect()]
        assert max(shares) - min([*shares, *[0] * (13 - len(shares))]) <= 1
