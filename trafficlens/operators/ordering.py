"""Row-position semantics without a single-partition window.

``with_row_index`` gives the global 0-based position of each row in
``order``: range-partition on the order keys, sort within partitions, count
rows per partition (a table with one row per partition), prefix-sum those
counts and broadcast the offsets back (bounded by the partition count).  The
data is shuffled once, into as many partitions as the session's shuffle setting
and AQE make of it.  Order keys must be unique (add a tie key) for a defined
index.  Range bounds come from a sample, so two reads of the same plan may cut
partitions differently; the range-partitioned rows are therefore written once
(compressed, into the session's ``spark.checkpoint.dir``) and both the counts
and the numbering read that copy.  It is meant for dictionaries.

``keys_at`` finds only the keys at given positions, for prefixes and splits of
whole tables: the order columns are read a few times, for all positions
together, and nothing is sorted, shuffled by row or written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.session import stored

#: Rows of a bracket that are listed on the driver to settle a position.
LISTED_ROWS = 10_000
#: Of a sketch, and how many evenly spaced values of a bracket one is asked for.
_ACCURACY, _GRID = 10_000, 500


def with_row_index(df: DataFrame, order: list, name: str = "row_idx") -> DataFrame:
    ranged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    ranged = stored(ranged, "row-index")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: an unpartitioned window here is bounded by their number.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_pos"))
            .drop("_pid", "_pos", "_off"))


def _measured(rows: DataFrame, measures: list[Column]) -> list:
    """One pass over ``rows`` for all measures."""
    return list(rows.agg(*measures).first())


def _listed(rows: DataFrame, wanted: Column) -> list[tuple]:
    """One pass that brings the wanted rows (a bounded number) to the driver, nulls first."""
    return sorted((tuple(r) for r in rows.where(wanted).collect()), key=lambda r: [(v is not None, v) for v in r])


def keys_at(df: DataFrame, order: list[str], ks: list[int], n: int) -> list[list]:
    """The order keys of the rows at positions ``ks`` (0-based) of ``n``; numeric or time columns, nulls first.

    A sketch brackets all positions by the first column.  Then every pass over
    the rows counts all brackets that are still open and takes a grid of values
    inside each, which narrows it some 500 times, so the number of passes
    grows with the logarithm of the rows and not with the positions.  A bracket
    of ``LISTED_ROWS`` rows or fewer is listed, all of them in one pass; a value that
    more rows have is settled by the columns after it.
    """
    c, w, rows = order[0], 2.0 / _ACCURACY, df.select(*order)
    col = F.col(c)
    probs = [min(1.0, max(0.0, k / max(n, 1) + d)) for k in ks for d in (-w, w)]
    nulls, marks = _measured(rows, [F.count_if(col.isNull()), F.percentile_approx(c, probs, _ACCURACY)])
    open_at = {k: tuple(marks[2 * i:2 * i + 2]) for i, k in enumerate(ks) if k >= nulls and marks is not None}
    within: dict[int, tuple] = {k: (None, None, 0) for k in ks if k < nulls}  # (lo, hi, rows before): between lo and hi, or equal to both
    many = {None: nulls}  # values and how many rows have them
    narrow = 2 * w * n > LISTED_ROWS  # else the first brackets are expected to be small enough, and no grid is taken
    while open_at:
        brackets, measures = sorted(set(open_at.values()), key=str), []
        for lo, hi in brackets:
            above, under = col > F.lit(lo) if lo is not None else F.lit(True), col < F.lit(hi) if hi is not None else F.lit(True)
            inside = above & under & col.isNotNull()
            ends = [F.count_if(col < F.lit(lo)), F.count_if(col == F.lit(lo))] if lo is not None else [F.lit(0).cast("long")] * 2
            last = [F.count_if(col == F.lit(hi))] if hi is not None and hi != lo else [F.lit(0).cast("long")]
            measures += [*(F.max(e) if lo is None else e for e in ends), F.count_if(inside & F.lit(lo is None or lo != hi)),
                         *(F.max(e) if hi is None or hi == lo else e for e in last),
                         F.percentile_approx(F.when(inside, col), [i / _GRID for i in range(_GRID + 1)], _ACCURACY) if narrow else F.lit(None)]
        got = _measured(rows, measures)
        found = {b: got[5 * i:5 * i + 5] for i, b in enumerate(brackets)}
        for k, (lo, hi) in list(open_at.items()):
            below, at_lo, between, at_hi, grid = found[lo, hi]
            start = nulls + below
            if k < start:  # the sketch was further off than it says
                open_at[k] = (None, lo)
            elif k < start + at_lo:
                within[k], many[lo] = (lo, lo, start), at_lo
            elif k < start + at_lo + between:
                start += at_lo
                if between <= LISTED_ROWS:
                    within[k] = (lo, hi, start)
                elif narrow:
                    place = (k - start) / between * _GRID
                    low, high = int(place - 1 - w * _GRID), int(place + 2 + w * _GRID)
                    new = grid[low] if low >= 0 else lo, grid[high] if high <= _GRID else hi
                    # The ends are values inside; a grid that does not narrow is as wide as two neighbouring values.
                    open_at[k] = new if new != (lo, hi) else (grid[max(low, 0)], grid[min(high, _GRID)])
                    continue
            elif k < start + at_lo + between + at_hi:
                within[k], many[hi] = (hi, hi, start + at_lo + between), at_hi
            else:
                open_at[k] = (hi, None)
            if k in within:
                del open_at[k]
        narrow = True
    out: dict[int, list] = {}
    wanted, shown = F.lit(False), []
    for k, (lo, hi, start) in within.items():
        if (lo is None or lo == hi) and start + many.get(lo, 0) > k and (lo, hi) == (lo, lo):
            if len(order) == 1:
                out[k] = [lo]
            elif many[lo] > LISTED_ROWS:
                same = rows.where(col.eqNullSafe(F.lit(lo))).select(*order[1:])
                out[k] = [lo, *keys_at(same, order[1:], [k - start], many[lo])[0]]
            else:
                wanted, shown = wanted | col.eqNullSafe(F.lit(lo)), [*shown, k]
        else:
            between = (col > F.lit(lo) if lo is not None else F.lit(True)) & (col < F.lit(hi) if hi is not None else F.lit(True))
            wanted, shown = wanted | (between & col.isNotNull()), [*shown, k]
    listed = _listed(rows, wanted) if shown else []
    for k in shown:
        lo, hi, start = within[k]
        if lo == hi:
            mine = [r for r in listed if r[0] == lo]
        else:
            mine = [r for r in listed if r[0] is not None and (lo is None or r[0] > lo) and (hi is None or r[0] < hi)]
        if not 0 <= k - start < len(mine):
            raise ValueError(f"no row at position {k}: the table changed while it was read")
        out[k] = list(mine[k - start])
    return [out[k] for k in ks]


def before_key(order: list[str], key: list, strict: bool = True) -> Column:
    """Rows that stand before ``key`` in ``order`` (nulls first)."""
    out = F.lit(not strict)
    for c, v in reversed(list(zip(order, key, strict=True))):
        less = F.lit(False) if v is None else F.col(c).isNull() | (F.col(c) < F.lit(v))
        out = less | (F.col(c).eqNullSafe(F.lit(v)) & out)
    return F.coalesce(out, F.lit(False))


def sort_rows(df: DataFrame, keys: list) -> DataFrame:
    """O1: total order; callers pass a unique tie key last."""
    return df.orderBy(*keys)


def keep_first_owner(df: DataFrame, uid: str, bid: str, order: str) -> DataFrame:
    """O2: per ``bid`` keep only the rows of the ``uid`` seen first (by ``order``).

    ``min_by`` is combined map-side, so a hot ``bid`` never gathers in one
    task; the owner table joins back with one row per bid (AQE splits skewed
    partitions of the big side).  Rows with a null ``bid`` are kept.
    """
    owners = df.where(F.col(bid).isNotNull()).groupBy(bid) \
        .agg(F.min_by(F.col(uid), F.col(order)).alias("_owner"), F.lit(1).alias("_has"))
    joined = df.join(owners, bid, "left")
    keep = F.col("_has").isNull() | F.col(uid).eqNullSafe(F.col("_owner"))
    return joined.where(keep).select(*df.columns)


def keep_first_browser(df: DataFrame, uid: str, bid: str, order: str) -> DataFrame:
    """O3: per ``uid`` keep only the rows with the first ``bid`` seen."""
    return keep_first_owner(df, uid=bid, bid=uid, order=order)


def first_rows(df: DataFrame, order: list[str], ks: list[int], n: int) -> list[Column]:
    """For each of ``ks`` the condition of the first k of ``n`` rows in ``order`` (which must be unique)."""
    inner = [k for k in ks if 0 < k < n]
    keys = dict(zip(inner, keys_at(df, order, inner, n), strict=True)) if inner else {}
    return [before_key(order, keys[k]) if k in keys else F.lit(k > 0) for k in ks]


def ordered_split(df: DataFrame, frac: float, order: list[str], split_col: str = "split") -> DataFrame:
    """First int(n*frac) rows in ``order`` are 'train', the rest 'test'."""
    n = df.count()
    head = first_rows(df, order, [int(n * frac)], n)[0]
    return df.withColumn(split_col, F.when(head, "train").otherwise("test"))


def top_weights(weights: Column | str, names: DataFrame, df: DataFrame, k: int = 1,
                name_idx: str = "idx", name_col: str = "feature") -> DataFrame:
    """Explode a weight array with positions, attach names, keep the k largest."""
    w = F.col(weights) if isinstance(weights, str) else weights
    ex = df.select(F.posexplode(w).alias("idx", "weight"))
    return ex.join(names.withColumnRenamed(name_idx, "idx"), "idx", "left") \
        .orderBy(F.desc("weight"), "idx").limit(k).select("idx", F.col(name_col).alias("feature"), "weight")
