"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Each of these modules holds QUERIES and, where SQL can express a query, ORACLES.
MODULES = [
    "host_rules", "secret_scan", "simhash_gray", "suffix_dedup", "pitman_yor", "packing", "prefix_hash", "unigram_pieces", "url_templates", "html_main",
    "decontaminate", "lexical_search", "periodic_runs",
]


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), what, {})
    return out


def queries() -> dict:
    import corpus_pipeline

    return _gather("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return _gather("ORACLES")
