"""Labelling, projections, filters, heads, samples, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_union(bots: DataFrame, users: DataFrame, label: str = "isBot") -> DataFrame:
    """Add label 1 / 0 and stack (duplicates kept)."""
    return bots.withColumn(label, F.lit(1)).unionByName(users.withColumn(label, F.lit(0)))


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """P2."""
    return df.drop(*cols)


def drop_any_null(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """dropna(how='any')."""
    return df.na.drop("any", subset=subset)


def null_filter(df: DataFrame, col: str, keep_null: bool) -> DataFrame:
    """Rows where col is (not) null."""
    return df.where(F.col(col).isNull() if keep_null else F.col(col).isNotNull())


def in_filter(df: DataFrame, col: str, values: list | None) -> DataFrame:
    """P5: set membership on constants; None means no filter (nulls never match)."""
    if values is None:
        return df
    return df.where(F.col(col).isin(list(values)))


def eq_filter(df: DataFrame, col: str, value) -> DataFrame:
    """P6."""
    return df.where(F.col(col) == F.lit(value))


def time_slice(df: DataFrame, ts: str, start, width, closed: str = "left") -> DataFrame:
    """Rows with start <= ts < start + width; closed='both' includes the end as the reference does."""
    t = F.col(ts)
    end = F.lit(start) + F.lit(width)
    cond = (t >= F.lit(start)) & ((t <= end) if closed == "both" else (t < end))
    return df.where(cond)


def take_head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First n rows in ``order`` (a top-n: TakeOrderedAndProject, no full sort).

    n < 0 follows pandas' head(-k): all rows but the last k, found by a top-k
    from the end; the order must be unique.
    """
    if n >= 0:
        return df.orderBy(*order).limit(n)
    last = df.select(*order).orderBy(*[F.col(c).desc() for c in order]).limit(-n)
    same = [F.col(c).eqNullSafe(F.col(f"_last_{c}")) for c in order]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    # At most -n rows, a parameter.
    return df.join(F.broadcast(last.withColumnsRenamed({c: f"_last_{c}" for c in order})), cond, "left_anti")


def hash_fraction(key_cols: list[str], seed: int) -> Column:
    """Deterministic uniform value in [0, 1) from md5(seed, key): engine-independent."""
    txt = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    return F.conv(F.substring(F.md5(txt), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_sample(df: DataFrame, frac: float, key_cols: list[str], seed: int = 17) -> DataFrame:
    """Reproducible Bernoulli sample keyed by row, independent of partitioning."""
    return df.where(hash_fraction(key_cols, seed) < F.lit(frac))


def hash_sample_n(df: DataFrame, n: int, key_cols: list[str], seed: int = 17) -> DataFrame:
    """Exactly n rows (top-n by key hash; no full sort)."""
    return df.withColumn("_h", hash_fraction(key_cols, seed)) \
        .orderBy("_h", *key_cols).limit(n).drop("_h")


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P10."""
    return df.withColumnsRenamed(mapping)


def expr_filter(df: DataFrame, predicate: str | None) -> DataFrame:
    """User-given SQL predicate text; empty means all rows."""
    if not predicate or not predicate.strip():
        return df
    return df.where(F.expr(predicate))


def select_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """P24 form 1: keep only listed columns that exist (listed order)."""
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])


def select_fill(df: DataFrame, keys: list[str], wanted: list[str], fill=0) -> DataFrame:
    """P24 form 2: reindex to the list; missing columns become ``fill``."""
    have = set(df.columns)
    return df.select(*keys, *[F.col(c) if c in have else F.lit(fill).cast("long").alias(c) for c in wanted])
