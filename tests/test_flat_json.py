"""Plain names in flat JSON objects are set by expressions; the parser says the same of every text."""

import pytest
from pyspark.sql import functions as F

from sylva.operators import mutation
from sylva.operators.mutation import Mapping, mutate

TEXTS = [
    '{"k": 5}', '{"k":5}', '{ "k" : -0.5e3 , "a": "k" }', '{"a": "\\"k\\": 1", "k": 1}', '{"a": "x", "k": "y$1"}', '{"k": true}', '{"k": null, "b": false}', "{}", "{  }", '{"a": 1 }', '{"a": 1, "k": 777}', '{"k": "777"}',
    '{"k": 1, "k": 2}', '{"k": {"k": 1}}', '{"a": {"k": 1}}', '{"a": [1, {"k": 2}]}', '[{"k": 1}]', '{"k": "é"}', '{"é": 1, "k": 2}', '{"1k": 1}', '{"k ": 1}', '{"K": 1}', '{\n  "k": 1\n}', ' {"k": 1}', '{"k": 1} ', '{"k": 01}', '{"k": 1',
    "", "null", '"k"', '{"a": 1, "a": 2, "k": 3}', '{"k": ""}', '{"a": "{\\"k\\": 1}"}', '{"a": "}", "b": "{"}', '{"a": ", k: 1", "k": [1]}', '{"a": 1' + ', "b": 2' * 900 + ', "k": 1}', '{"a": "k:", "k": 1e5}', '{"a":"","k":0}',
]


@pytest.mark.parametrize("mapping", [Mapping("//k", "777"), Mapping("//k", "a\\b$1\"", "string"), Mapping("//k", "true", "boolean"), Mapping("//k", "1.5", "number"), Mapping("//k", "x", "number")])
@pytest.mark.parametrize("command", ["set", "update"])
def test_flat_objects_as_the_parser_has_them(spark, monkeypatch, mapping, command):
    rows = [(i, f"{i}.json", "json", t) for i, t in enumerate(TEXTS)] + [(100, "n", "JSON", '{"k": 1}'), (101, "n", "yaml", '{"k": 1}'), (None, None, "json", '{"k": 1}'), (102, "n", "json", None)]
    sources = spark.createDataFrame(rows, "doc_id long, path string, language string, content string")
    got = sorted(map(repr, mutate(sources, [mapping], command).collect()))
    monkeypatch.setattr(mutation, "_flat", lambda *a: None)
    assert got == sorted(map(repr, mutate(sources, [mapping], command).collect()))
    assert len(got) == len(TEXTS) + 3


def test_flat_objects_are_not_parsed(spark, tiny, monkeypatch):
    from sylva.queries import QUERIES

    seen = spark.sparkContext.accumulator(0)
    apply = mutation.apply_mapping

    def counted(*a):
        seen.add(1)
        return apply(*a)

    monkeypatch.setattr(mutation, "apply_mapping", counted)
    for name in ("set_json_value", "set_inserts_value"):
        assert QUERIES[name](spark, tiny).agg(F.count("output")).first()[0]
    assert seen.value == 0
