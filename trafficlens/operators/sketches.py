"""A16, A18, A11 beside their exact forms: sketches by time slice that are kept and merged over windows.

A slice's sketch is one small column, bounded by its accuracy and not by the
rows; a window's answer merges its slices' sketches, so a day is read once
however many windows it is in.  Errors: distinct values (HyperLogLog, 2^12
registers) about 1.6 % at one standard deviation; quantiles (KLL, k = 200)
about 1.33 % of rank; values of at least 1 / ``TOP_TRACKED`` of a window's rows are
counted within that share, and exactly where a slice has fewer different values.
Nulls are left out of all three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_REGISTERS, RANKS, TOP_TRACKED = 12, 200, 1024


def slice_sketches(df: DataFrame, by: list[str], distinct: str, number: str, text: str) -> DataFrame:
    """One row a slice: the ``by`` columns, and the sketches distinct_s, quantile_s (of a whole number) and top_s."""
    return df.groupBy(*by).agg(
        F.hll_sketch_agg(distinct, F.lit(LOG_REGISTERS)).alias("distinct_s"),
        F.kll_sketch_agg_bigint(number, F.lit(RANKS)).alias("quantile_s"),
        F.expr(f"approx_top_k_accumulate(`{text}`, {TOP_TRACKED})").alias("top_s"))


def over_windows(slices: DataFrame, slice_col: str, length: int, window: str = "first_slice") -> DataFrame:
    """Each slice once for every window of ``length`` slices that it is in: ``window`` names the window's first slice.
    Only windows that begin at a slice there is."""
    starts = slices.select(F.col(slice_col).alias(window)).distinct()
    spread = slices.withColumn(window, F.explode(F.sequence(F.col(slice_col) - (length - 1), F.col(slice_col))))
    return spread.join(starts, window)


def merged(slices: DataFrame, by: list[str], quantiles: list[float], top: int) -> DataFrame:
    """One row a ``by``: distinct (estimated), quantiles (an array) and top (an array of value and count)."""
    m = slices.groupBy(*by).agg(F.hll_union_agg("distinct_s").alias("d"), F.kll_merge_agg_bigint("quantile_s", F.lit(RANKS)).alias("q"),
                                F.expr(f"approx_top_k_combine(top_s, {TOP_TRACKED})").alias("t"))
    at = F.array(*[F.kll_sketch_get_quantile_bigint("q", F.lit(float(x))) for x in quantiles])
    return m.select(*by, F.hll_sketch_estimate("d").alias("distinct"), at.alias("quantiles"), F.expr(f"approx_top_k_estimate(t, {top})").alias("top"))
