"""The node table: one row per node of each document's tree.

path names the elements from the root to an element or to what holds another node. pre numbers the nodes in document order and post is the last descendant's number, so containment is an
interval test. Parsing runs batch by batch in Python; everything after it is relational.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..staging import settle
from .parsers import BAD_TEXT, parse
from .partitions import spread
from .tree import Node

COLUMNS = (
    ("doc_id", pa.int64(), "long"), ("file", pa.string(), "string"), ("pre", pa.int32(), "int"), ("post", pa.int32(), "int"), ("parent", pa.int32(), "int"), ("depth", pa.int32(), "int"), ("ord", pa.int32(), "int"),
    ("kind", pa.string(), "string"), ("name", pa.string(), "string"), ("text", pa.string(), "string"), ("string_value", pa.string(), "string"),
    ("line", pa.int32(), "int"), ("column", pa.int32(), "int"), ("end_line", pa.int32(), "int"), ("end_column", pa.int32(), "int"), ("path", pa.string(), "string"), ("attrs", pa.map_(pa.string(), pa.string()), "map<string,string>"),
)
SCHEMA = ", ".join(f"`{n}` {t}" for n, _, t in COLUMNS)
#: Rows, and characters of their texts and values about, that are handed to Spark at once, so that a worker's memory does not follow the size of its task.
BATCH_ROWS, BATCH_CHARS = 10_000, 2_000_000


def _rows(doc_id: int, file: str, doc: Node, inner_values: bool) -> Iterator[tuple]:
    paths: dict[int, str] = {}
    for n in (doc, *doc.descendants()):
        above = paths.get(id(n.parent))
        path = above
        if n.kind == "element":
            path = paths[id(n)] = f"{above}/{n.name}" if above else n.name
        leaf = inner_values or all(c.kind != "element" for c in n.children)
        yield (
            doc_id, file, n.pre, n.post, n.parent.pre if n.parent is not None else None, n.depth, n.ord, n.kind, n.name, n.text, n.string_value() if leaf else None,
            n.line, n.column, n.end_line, n.end_column, path, list(n.attrs.items()),
        )


def node_table(sources: DataFrame, mode: str | None = None, inner_values: bool = True, ignore_whitespace: bool = False, parse_depth: int | None = None, stage: bool = True) -> DataFrame:
    """Nodes of all sources; documents that cannot be parsed have none.

    inner_values = False leaves the string value of elements with element children null. stage writes
    the table once, so that several steps over it do not parse again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * len(COLUMNS)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(cols, COLUMNS, strict=True)], [n for n, _, _ in COLUMNS])
            rows.clear()
            return out

        for b in batches:
            for doc_id, path, language, content in zip(*(b.column(c).to_pylist() for c in ("doc_id", "path", "language")), b.column("content"), strict=True):
                text = content.as_py()
                if text is None:
                    continue
                try:
                    doc = parse(text, language, mode, ignore_whitespace, parse_depth)
                except BAD_TEXT:  # a document that does not parse is left out, as a file is
                    continue
                for row in _rows(doc_id, path, doc, inner_values):
                    rows.append(row)
                    held += len(row[9] or "") + len(row[10] or "")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                        yield batch()
                        held = 0
        yield batch()

    nodes = spread(sources.select("doc_id", "path", "language", "content")).mapInArrow(run, SCHEMA)
    return settle(nodes, "nodes") if stage else nodes
