"""The named queries, gathered from the modules of this package."""

from __future__ import annotations

import importlib

from millrace.plans.registry import ORACLES, QUERIES, Query

MODULES = ["messages", "keyed", "objects", "text", "config", "status", "streams", "trees"]


def load() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"millrace.plans.{name}")
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    load()
    return dict(ORACLES)
