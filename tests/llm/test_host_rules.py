import random

import pytest
from pyspark.sql import functions as F

from sylva.llm import host_rules
from sylva.llm.host_rules import RULES, document_measures, host_rates, judged_documents, source_host
from sylva.llm.queries_native import OP13_SQL, op13_quality_rules

from .oracles import assert_same

SPACE = " \t\n\x0b\f\r"


def plain_measures(text):
    text = text or ""
    for c in SPACE[1:]:
        spaced = text.replace(c, " ") if c == SPACE[1] else spaced.replace(c, " ")
    w = [x for x in spaced.split(" ") if x]
    seen, covered = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


def test_measures(spark, docs, texts):
    rng = random.Random(2)
    more = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(200)] + ["a b c d e " * 2, "x\n\nx\n \nx\r\n", "#\u2028* ＃ <b>", "a b c d e f a b c d e", "\u00a0one\u00a0two\x1cthree"]
    rows = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(1000 + k, t, None) for k, t in enumerate(more)], "doc_id long, text string, source string"))
    want = sorted(((r["doc_id"] or -1), *plain_measures(r["text"])) for r in rows.collect())
    got = sorted((r["doc_id"] or -1, *tuple(r)[2:]) for r in document_measures(rows).select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words").collect())
    assert got == want


def plain_rates(counts):
    """Shrunk rates of {host: (docs, failed)}."""
    n, f = sum(d for d, _ in counts.values()), sum(x for _, x in counts.values())
    m, k = f / n, len(counts)
    below = n - sum(d * d for d, _ in counts.values()) / n
    spread = (sum(x * x / d for d, x in counts.values()) - n * m * m - (k - 1) * m * (1 - m)) / below if below else None
    if spread is None or spread <= 0:
        return {h: m for h in counts}
    worth = max(0.0, m * (1 - m) / spread - 1)
    return {h: (x + worth * m) / (d + worth) for h, (d, x) in counts.items()}


def of_hosts(spark, counts, bad="too few words"):
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(good if k >= x else bad, h) for h, (d, x) in counts.items() for k in range(d)]
    return spark.createDataFrame([(k, t, h) for k, (t, h) in enumerate(rows)], "doc_id long, text string, source string")


@pytest.mark.parametrize("counts", [{"a": (40, 2), "b": (40, 38), "c": (1, 1), "d": (60, 3)}, {"a": (5, 5)}, {"a": (9, 0), "b": (3, 0)}, {"a": (10, 5), "b": (10, 5)}, {"a": (1, 1), "b": (1, 0)}])
def test_rates_are_shrunk(spark, counts):
    got = {r["host"]: r["rate"] for r in host_rates(document_measures(of_hosts(spark, counts))).where("rule = 'few_words'").collect()}
    want = plain_rates(counts)
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(want[h]) for h in want)


def test_bad_hosts_lose_their_good_documents_and_small_ones_do_not(spark):
    counts = {"good": (200, 4), "fair": (200, 10), "bad": (200, 180), "tiny": (1, 1), "also": (150, 3)} | {f"h{k}": (60, 1) for k in range(8)}
    got = {(r["host"], r["base_failed"]): r["kept"] for r in judged_documents(of_hosts(spark, counts)).collect()}
    assert not got["bad", False] and not got["bad", True]
    assert all(got[h, False] for h in counts if h not in ("bad", "tiny")) and not got["good", True]
    alike = {f"h{k}": (60, 2 + k % 5) for k in range(12)} | {"tiny": (3, 2)}
    assert plain_rates(alike)["tiny"] < 0.5
    assert judged_documents(of_hosts(spark, alike)).where("host = 'tiny' and not base_failed and kept").count() == 1


def test_hosts_are_joined_alike_whatever_their_size(spark, docs, same, monkeypatch):
    counts = {f"h{k}": (10 + k, (10 + k) * (k % 5 == 0)) for k in range(20)}
    rows = of_hosts(spark, counts).unionByName(docs.select("doc_id", "text", "source"))
    want = judged_documents(rows)
    monkeypatch.setattr(host_rules, "HOT_SHARE", 3)
    same(judged_documents(rows), want)


def test_hosts_of_sources(spark):
    rows = [("src0", "src0"), ("HTTP://A.Org:80/x?y", "a.org:80"), ("A.org", "A.org"), ("", ""), (None, None), ("x://", "")]
    assert [r[0] for r in spark.createDataFrame(rows, "s string, h string").select(source_host(F.col("s"))).collect()] == [h for _, h in rows]


def test_rows_of_every_kind(spark, docs, clash, same):
    got = judged_documents(docs)
    assert got.count() == docs.count() and got.where("base_failed is null or kept is null").count() == 0
    assert got.where("host is null and not base_failed and not kept").count() == 0
    same(judged_documents(clash(docs)), got)
    assert judged_documents(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(docs):
    for df in (document_measures(docs), judged_documents(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_its_sql(spark, tiny):
    assert_same(spark, tiny, op13_quality_rules, OP13_SQL)
    assert [name for name, _ in RULES][0] == "few_words"
