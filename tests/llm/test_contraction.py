"""Graphs of few edges are contracted by their parts, not by rounds of joins."""

import random

import pytest

from sylva.llm import graph

EDGES = [(random.Random(k).randrange(300), random.Random(k + 9_999).randrange(300)) for k in range(170)] + [(k, k + 1) for k in range(1_000, 1_060)]


def _rows(spark, parts: int) -> set:
    return {tuple(r) for r in graph.components(spark.createDataFrame(EDGES, "a long, b long").repartition(parts), files=parts).collect()}


def _expected() -> set:
    root = {v: v for e in EDGES for v in e}
    for _ in root:
        for a, b in EDGES:
            root[a] = root[b] = min(root[a], root[b])
    return {(v, r) for v, r in root.items() if v != r}


def test_few_edges_take_two_tables(spark, monkeypatch):
    written, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda *a, **k: written.append(1) or settle(*a, **k))
    assert _rows(spark, 4) == _expected()
    assert len(written) == 2


@pytest.mark.parametrize("most", [1, 7, 100])
def test_more_edges_than_a_task_contracts(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "PART_EDGES", most)
    assert _rows(spark, 3) == _expected()
