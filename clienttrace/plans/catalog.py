"""Imports every query module once."""

from __future__ import annotations

import importlib

from clienttrace.plans import registry

MODULES = ("profile_queries", "event_queries", "vector_queries", "answer_queries", "model_queries",
           "flow_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"clienttrace.plans.{name}")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
