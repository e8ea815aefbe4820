"""Equality joins.  Catalyst/AQE pick broadcast vs sort-merge at runtime
from measured sizes; explicit broadcast only where the side is bounded by a
parameter (J6: one row per time group)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_derived(df: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Attach columns computed once per distinct key; null keys drop out (inner)."""
    return df.join(derived, key, "inner")


def only_in_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` in ``first`` that ``second`` never has (null-safe like pandas isin)."""
    seen = second.select(key).distinct()
    return first.join(seen, first[key].eqNullSafe(seen[key]), "left_anti")


def semi_on_marker(ids: DataFrame, key: str, marker_col: str, marker) -> DataFrame:
    """Rows whose ``key`` also occurs on a row with ``marker_col == marker``."""
    marked = ids.where(F.col(marker_col) == F.lit(marker)).select(key).distinct()
    return ids.join(marked, key, "left_semi")


def membership_flag(df: DataFrame, listing: DataFrame, key: str, flag: str = "inList") -> DataFrame:
    """1 when ``key`` is in ``listing``, else 0 (left join on the distinct list)."""
    lst = listing.select(key).distinct().withColumn("_hit", F.lit(1))
    return df.join(lst, key, "left").withColumn(flag, F.coalesce(F.col("_hit"), F.lit(0))).drop("_hit")


def outer_fill(left: DataFrame, right: DataFrame, on: list[str], fill=0) -> DataFrame:
    """Full outer join, missing side filled with ``fill``."""
    return left.join(right, on, "full_outer").na.fill(fill)


def left_fill(facts: DataFrame, table: DataFrame, on: list[str], fill=0, bounded: bool = False) -> DataFrame:
    """Left join; unmatched get ``fill``.  ``bounded`` = the right side is
    bounded by a parameter (e.g. one row per time group) and is broadcast."""
    right = F.broadcast(table) if bounded else table
    cols = [c for c in table.columns if c not in on]
    out = facts.join(right, on, "left")
    return out.na.fill(fill, subset=cols)


def join_back(scored: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Predictions carry their key and join back to the facts on it."""
    return scored.join(facts, key, "inner")
