"""Node tables are handed to Spark in batches bounded by rows and by characters."""

import pyarrow as pa

from sylva.sources import nodes


class _Sources:
    """Stands for a DataFrame; gives the function that parses."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def _batches(monkeypatch, texts):
    monkeypatch.setattr(nodes, "spread", lambda df: df)
    run = nodes.node_table(_Sources(), stage=False)
    n = len(texts)
    given = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "path": ["p.html"] * n, "language": ["html"] * n, "content": texts})
    return list(run(iter([given])))


def test_batches_are_bounded(monkeypatch):
    long = _batches(monkeypatch, ["<p>" + "x" * 500_000 + "</p>"] * 12)
    assert max(b.nbytes for b in long) < 5_000_000 and sum(b.num_rows for b in long) == 36
    many = _batches(monkeypatch, ["<b>x</b>" * 30_000])
    assert max(b.num_rows for b in many) <= 10_000 and sum(b.num_rows for b in many) == 60_001
