"""Each query is registered once as name -> (DataFrame plan, DuckDB SQL or None), so the two can't drift apart."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_found: dict[str, tuple[Query, str | None]] = {}
#: Modules of driftwood.plans that register queries when imported.
MODULES = ("relational", "metrics", "text", "graph", "similarity", "detection", "contrast", "composites", "training", "grammar")


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return put


def registered() -> dict[str, tuple[Query, str | None]]:
    for name in MODULES:
        importlib.import_module(f"driftwood.plans.{name}")
    return _found
