import json
import random

import pytest
from pyspark.sql import functions as F

from sylva.plans import lifted
from sylva.sources.discovered import json_nodes, shape_of, typed_rows
from sylva.sources.documents import from_table
from sylva.sources.nodes import node_table

PLAIN = ['{"k": 5, "l": [{"a": 1.50, "b": true}, {"a": 2}], "s": "x\\ny é \\"q\\": z"}', '{"k": 7}', '{"k": -0.0, "s": ""}', '{"m": {"p": "", "q": [[1, 2], [3]]}}', ' {"k" : 12345678901234567890123 , "l":[{"b":false}]} ', '{"k": 1e3, "m": {"q": [[4]]}}']
ODD = ['{"n": null}', "[1]", "3", '{"e": {}}', '{"a b": 1}', '{"k": 1, "k": 2}', "{bad", '{"l": []}', '{"s": "\\u00e9"}', '{"s": "x", "k": 3}', '{"v": 1}', '{"v": {"z": 1}}', '{"v": [1]}', "", '{"w": {"x y": 1}}']


def sources_of(spark, texts, language="json"):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    return from_table(df, "t", F.concat(F.lit("p/"), F.col("k").cast("string")), language, "k")


def trees(nodes):
    """Kind, name, text, depth and number of descendants of the nodes of each document, in order."""
    out = {}
    for r in nodes.orderBy("doc_id", "pre").collect():
        out.setdefault(r["doc_id"], []).append(r)
    return {k: [(r["kind"], r["name"], r["text"], r["depth"], r["path"], sum(r["pre"] < o["pre"] <= r["post"] for o in own)) for r in own] for k, own in out.items()}


@pytest.mark.parametrize("texts", [PLAIN, [*PLAIN, *ODD], ODD, ["[1]", "2"], []])
def test_trees_are_those_of_the_parser(spark, texts):
    src = sources_of(spark, texts)
    assert trees(json_nodes(src)) == trees(node_table(src))


def test_plain_texts_need_no_parser_and_odd_ones_do(spark):
    rows, others = typed_rows(sources_of(spark, [*PLAIN, *ODD]))
    assert sorted(r["doc_id"] for r in rows.collect()) == list(range(len(PLAIN)))
    assert sorted(r["doc_id"] for r in others.collect()) == list(range(len(PLAIN), len(PLAIN) + len(ODD)))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_other_languages_are_parsed(spark):
    src = sources_of(spark, PLAIN[:2]).unionByName(sources_of(spark, ["a: 1\nb: [1, 2]\n"], "yaml").withColumn("doc_id", F.lit(99).cast("long")))
    assert trees(json_nodes(src)) == trees(node_table(src))


def test_random_texts(spark):
    rng = random.Random(6)

    def value(depth):
        kind = rng.randrange(7 if depth < 3 else 4)
        if kind < 2:
            return rng.choice([0, 17, 2.5, -3])
        if kind == 2:
            return rng.choice(["", "a", "é\n", 'q"'])
        if kind == 3:
            return rng.choice([True, False])
        if kind == 4:
            return [rng.randrange(9) for _ in range(rng.randrange(4))]
        return {k: value(depth + 1) for k in ("x", "y", "z") if rng.random() < 0.6}

    texts = [json.dumps({k: value(0) for k in ("a", "b", "c", "d") if rng.random() < 0.7}, ensure_ascii=False) for _ in range(300)]
    src = sources_of(spark, texts)
    assert trees(json_nodes(src)) == trees(node_table(src))


def test_shapes_are_merged(spark):
    shape, conflicts = shape_of(sources_of(spark, ['{"b": 1, "a": [{"x": 1}]}', '{"b": 2.5, "a": [{"y": "t"}], "c": {"d": true}}', '{"c": {"e": 1}}']))
    assert shape.simpleString() == "struct<b:string,a:array<struct<y:string,x:string>>,c:struct<d:string,e:string>>" and conflicts == []


def test_expressions_over_discovered_nodes(spark):
    src = sources_of(spark, [*PLAIN, *ODD])
    for x in ("//k", "//l/a ! number(.)", "if (//k > 5) then 'high' else 'low'", "//k ! map { 'k': number(.), 'text': 'k=' || . }"):
        a, b = (sorted(map(str, lifted.rows(n, x, normalize=False).select("doc_id", "value", "tree").collect())) for n in (json_nodes(src), node_table(src)))
        assert a == b
