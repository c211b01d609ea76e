"""Queries of the training-data problems, and their SQL where SQL can say the same."""

from __future__ import annotations

from importlib import import_module

MODULES = "similar_vectors frequencies cooccurrence golden_records splitting canonical_values formatting_duplicates bpe packing subjects".split()


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"corpusmill.llm.{name}"), what)
    return out


QUERIES = _all("QUERIES")
SQL = _all("SQL")
