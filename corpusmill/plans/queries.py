"""Registered queries of the core library, and their SQL."""

from __future__ import annotations

from corpusmill.plans import browse, graph, ingest, records, search

_PARTS = (search, browse, ingest, graph, records)
QUERIES = {k: q for p in _PARTS for k, q in p.QUERIES.items()}
SQL = {k: q for p in _PARTS for k, q in p.SQL.items()}
