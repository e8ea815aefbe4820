"""Tumbling and sliding time-window counts per user, one column per type.

The reference numbers windows from the smallest timestamp of the table:
for i in 0..n-1 (n = window // shift) a row falls into part
``((ts - ts_min + i*shift) div window) * n + i``; counts per (part, user, label)
and credential type are stacked over all i.

Plan at scale: ``ts_min`` is a scalar subquery (one tiny aggregate job, no
driver round trip, no join).  Rows are counted by pane first, the longest stretch
of time that every window holds whole or not at all (the greatest common divisor of
window and shift); only the pane rows are dealt by user, and there exploded into
their n window parts and summed, so a raw row is never copied and no copy is
shuffled.  A hot user's rows are spread over all of its panes before; its panes,
bounded by the time that the table covers, come to one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ts_min(df: DataFrame, ts: str) -> Column:
    return df.select(F.min(ts)).scalar()


def type_counts(types: list[str], type_col: str) -> list[Column]:
    """One count column per listed type (the pivot with listed values)."""
    return [F.count_if(F.col(type_col) == F.lit(t)).alias(t) for t in types]


def sliding_counts(df: DataFrame, window: int, shift: int, types: list[str], *,
                   ts: str = "TIMESTAMP", user: str = "USER_ID", label: str = "isBot",
                   type_col: str = "LOGIN_CREDENTIAL_TYPE", part_col: str = "TS_PART",
                   ts_min: Column | int | None = None) -> DataFrame:
    """Sliding-window counts, pivoted to one column per listed type."""
    if window <= 0 or shift <= 0:
        raise ValueError("window and shift must be positive")
    n = int(window / shift)
    if n < 1:
        raise ValueError("window must be at least one shift")
    base = _ts_min(df, ts) if ts_min is None else F.lit(ts_min) if not isinstance(ts_min, Column) else ts_min
    keys = [user, label, type_col, ts]
    clean = df.where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()
                     & F.col(keys[2]).isNotNull() & F.col(keys[3]).isNotNull())
    offs = (F.col(ts) - base).cast("long")
    pane = math.gcd(int(window), int(shift)) if n > 1 else int(window)
    panes = clean.select(user, label, type_col, offs.alias("_off")) \
        .withColumn("_pane", F.expr(f"_off div {pane}")).groupBy("_pane", user, label).agg(*type_counts(types, type_col))
    if n == 1:
        return panes.withColumnRenamed("_pane", part_col)
    parts = panes.repartition(user, label).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) \
        .withColumn(part_col, F.expr(f"((_pane * {pane} + _i * {int(shift)}) div {int(window)}) * {n} + _i"))
    return parts.groupBy(part_col, user, label).agg(*[F.sum(t).alias(t) for t in types])


def tumbling_counts(df: DataFrame, window: int, types: list[str], **kw) -> DataFrame:
    """A5: part = (ts - ts_min) div window; same keys and columns as A6."""
    return sliding_counts(df, window, window, types, **kw)
