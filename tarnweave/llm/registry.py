"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    chat_format, decontaminate, fill_in_middle, license_scan, line_dedup, mixing, ngram_join, pii, quality, suffix_dedup, token_align, token_counts, url_filter,
)

MODULES = [pii, ngram_join, suffix_dedup, url_filter, chat_format, license_scan, decontaminate, mixing, quality, line_dedup, token_counts, token_align, fill_in_middle]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
