"""Named queries over the harness tables, with their SQL counterparts."""

from __future__ import annotations

import importlib

from .registry import QUERIES, SQL

MODULES = ["lists", "timeline", "records", "texts", "sets", "upkeep", "reads", "setlists", "settling", "hints"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
