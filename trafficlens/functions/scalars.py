"""Scalar column helpers: casts, sentinels, array/text splits, prefixes, thresholds, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lossy_int(c) -> Column:
    """Version text to int; '10.0' -> 10 (through double, as pandas does); bad text -> 0."""
    return F.coalesce(_c(c).try_cast("double").try_cast("int"), F.lit(0))


def bool_norm(c) -> Column:
    """Boolean with null -> False."""
    return F.coalesce(_c(c).cast("boolean"), F.lit(False))


def none_text(c) -> Column:
    """Text form with null -> 'None' (the reference's str() of None)."""
    return F.coalesce(_c(c).cast("string"), F.lit("None"))


def absent_text() -> Column:
    """A missing request field becomes ''."""
    return F.lit("")


def array_slot(arr, i: int, default: str = "0") -> Column:
    """I-th element of an array (0-based) as text, default when absent."""
    return F.coalesce(F.get(_c(arr), i).cast("string"), F.lit(default))


def array_to_columns(arr, names: list[str], default: str = "0") -> list[Column]:
    """Array -> len(names) text columns."""
    return [array_slot(arr, i, default).alias(n) for i, n in enumerate(names)]


def split_part(text, sep_regex: str, k: int) -> Column:
    """K-th field (0-based) of delimited text, null when absent."""
    return F.get(F.split(_c(text), sep_regex, -1), k)


def split_to_columns(text, sep_regex: str, names: list[str]) -> list[Column]:
    """All fields at once from one split (the split is shared by Catalyst)."""
    arr = F.split(_c(text), sep_regex, -1)
    return [F.get(arr, i).alias(n) for i, n in enumerate(names)]


def prefixed(name: str, c=None) -> Column:
    """P20: 'Feature;value' so values of different columns cannot collide."""
    return F.concat_ws(";", F.lit(name), _c(c if c is not None else name).cast("string"))


def score_class(p, bound: float, strict: bool = True) -> Column:
    """1 when the score passes the bound (> or >=), else 0."""
    p = _c(p)
    return (p > F.lit(bound) if strict else p >= F.lit(bound)).cast("int")


def hash_bucket(c, n: int, method: str = "md5") -> Column:
    """stable hash of the text value, bucketed to [0, n).

    ``md5`` uses the first 32 bits of the MD5 hex digest (portable: any engine
    gives the same bucket); ``xxhash64`` is Spark's faster native hash.
    """
    x = _c(c).cast("string")
    if method == "xxhash64":
        return F.pmod(F.xxhash64(x), F.lit(n))
    return (F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % F.lit(n))
