import pytest
from oracle import assert_same

from sylva import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, tiny, name):
    assert_same(spark, tiny, queries.QUERIES[name], queries.ORACLES[name])


def test_entry(spark, tiny):
    row = queries.entry(spark, tiny).first()
    assert row["results"] == row["errors"] + row["warnings"] > 0
    assert row["success"] == (row["errors"] == 0)


def test_registry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_snippets_of_all_documents(spark, tiny):
    from sylva.functions.text import line_range, lines_of, snippet

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").where("text is not null").collect()}
    found = {r["doc_id"]: r for r in queries.snippet_all_documents(spark, tiny).collect()}
    assert found.keys() == texts.keys() and any(not t.split("\n")[0].isascii() for t in texts.values())
    for k, r in found.items():
        lines = lines_of(texts[k])
        assert (r["head"], r["within"]) == (snippet(lines, 1, 1, 1, 5, None), snippet(lines, 1, 3, 1, 12, None))
        assert r["two"] == "|".join(line_range(lines, 1, 2))


def test_snippets_cut_characters(spark):
    from pyspark.sql import functions as F

    from sylva.functions.text import lines_of, snippet, snippet_column

    texts = ["é", "aé日本😀z\r\nx", "😀😀", "", "日本語 テキスト", "abc"]
    cuts = [(a, b) for a in range(1, 12) for b in range(a, 13)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for k, *got in df.select("k", *[snippet_column(F.col("text"), F.lit(1), F.lit(a), F.lit(b)) for a, b in cuts]).collect():
        assert got == [snippet(lines_of(texts[k]), 1, a, 1, b, None) for a, b in cuts]
