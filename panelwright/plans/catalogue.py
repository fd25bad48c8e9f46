"""All registered queries."""
from __future__ import annotations

import importlib

from panelwright.plans.registry import ORACLES, QUERIES, Query

MODULES = (
    "prep_queries", "backtest_queries", "factor_queries", "break_queries", "text_queries", "stream_queries", "tree_queries",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"panelwright.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
