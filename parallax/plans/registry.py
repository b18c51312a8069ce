"""Queries of the library's own operators with their SQL."""

from __future__ import annotations

import importlib

MODULES = ["analytics", "classification", "clusters", "evaluation", "landing", "quality", "streaming"]


def _collect(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE")
