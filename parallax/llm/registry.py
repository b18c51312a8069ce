"""Queries of the training-data operators, for the driver's entry module."""

from __future__ import annotations

import importlib

MODULES = ["decontamination", "embedding_dedup", "hmm_lm", "language_id", "merkle_manifest", "minhash_dedup", "packing", "pii", "quality_rules", "spelling_variants", "token_count", "toxicity", "warc_fixity"]


def _collect(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE")
