"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from . import queries_native, queries_pages, queries_text

MODULES = (queries_native, queries_pages, queries_text)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
