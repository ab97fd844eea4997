"""Registered queries, grouped by the kind of work they do."""

from __future__ import annotations

import importlib

MODULES = ("q_fills", "q_bars", "q_joins", "q_stats", "q_portfolio", "q_book", "q_sources", "q_signals", "q_misc", "q_streams")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tickloom.plans.{m}")


def all_queries():
    from tickloom.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql():
    from tickloom.plans.registry import ORACLE

    _load()
    return dict(ORACLE)
