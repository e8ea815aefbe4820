"""P16 half-day CASE columns and A7 two-level time groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

H = 3600
DAY = 86400


def half_day_bounds(week_start: int) -> list[tuple[int | None, int | None]]:
    """The reference's six half-day (lo, hi) bounds, strict on both sides.

    Relative to the first day's 7 pm (week_start + 19 h); ACT_5 ends 5 h
    before the third 7 pm while ACT_6 starts 7 h before it, so two hours are
    counted twice, as in the reference.
    """
    d1 = week_start + 19 * H
    d2, d3 = d1 + DAY, d1 + 2 * DAY
    return [(None, d1 - 7 * H), (d1 - 7 * H, d1 + 5 * H), (d1 + 5 * H, d2 - 7 * H),
            (d2 - 7 * H, d2 + 5 * H), (d2 + 5 * H, d3 - 5 * H), (d3 - 7 * H, d3 + 5 * H)]


def bucket_columns(ts, bounds, prefix: str = "ACT_") -> list[Column]:
    """One column per bucket holding ts when lo < ts < hi, else null."""
    t = F.col(ts) if isinstance(ts, str) else ts
    out = []
    for i, (lo, hi) in enumerate(bounds, start=1):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (t > F.lit(lo))
        if hi is not None:
            cond = cond & (t < F.lit(hi))
        out.append(F.when(cond, t).alias(f"{prefix}{i}"))
    return out


def ts_group(ts, min_ts, max_ts, parts: int | Column, short_parts: int | Column) -> Column:
    """p = trunc((ts-min)/period), sp = trunc(((ts-min) mod period)/short), p*short_parts+sp.

    period = (max-min)/parts and short = period/short_parts are doubles, as in
    the reference; ``cast(.. as long)`` truncates like Python's int(), and
    ``pmod`` equals Python's % for these operands.  ts = max gives one extra group.
    """
    t = F.col(ts) if isinstance(ts, str) else ts
    mn = min_ts if isinstance(min_ts, Column) else F.lit(min_ts)
    mx = max_ts if isinstance(max_ts, Column) else F.lit(max_ts)
    longs, shorts = (n if isinstance(n, Column) else F.lit(n) for n in (parts, short_parts))
    period = (mx - mn).cast("double") / longs.cast("double")
    short = period / shorts.cast("double")
    rel = (t - mn).cast("double")
    p = (rel / period).cast("long")
    sp = (F.pmod(rel, period) / short).cast("long")
    return p * shorts + sp


def ts_buckets():
    """``ts_group`` of an array of times since min_ts (span = max_ts - min_ts), as a function that travels with tasks: for each
    pair of period numbers its place and the groups, as whole doubles, from the same operations."""
    def buckets(rel, span, pairs):
        import numpy as np
        longs = {}
        with np.errstate(divide="ignore", invalid="ignore"):
            for i, (parts, short_parts) in enumerate(pairs):
                period = np.float64(span) / parts
                if parts not in longs:
                    within = np.fmod(rel, period)
                    longs = {parts: (np.trunc(rel / period), np.where(within < 0, np.fmod(within + period, period), within))}
                p, within = longs[parts]
                yield i, p * short_parts + np.trunc(within / (period / short_parts))
    return buckets
