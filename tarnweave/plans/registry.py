"""Registered queries and their SQL."""

from __future__ import annotations

from . import answers, assembly, catalog, corpus, evaluation, gates, memories, pages, records, relational, releases, retrieval, search, state, text

MODULES = [text, relational, search, retrieval, evaluation, state, corpus, catalog, records, memories, answers, assembly, pages, gates, releases]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
