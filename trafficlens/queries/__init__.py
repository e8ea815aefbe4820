"""

Every entry has a Spark callable ``(spark, sf_dir) -> DataFrame`` and, where
the operator is SQL-expressible, a DuckDB twin over the driver's views.
"""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Callable, str | None]]:
    """Import every query module once; each registers its queries."""
    from . import (q_aggregates, q_encode, q_evaluate, q_joins, q_learners, q_neighbours, q_ordering,  # noqa: F401
                   q_quantile_vote, q_rows, q_sketches, q_sources, q_streaming, q_useragent, q_wide, q_windows)
    return REGISTRY
