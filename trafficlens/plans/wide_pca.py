"""F17, A24 for very wide sparse rows: principal components by a randomised range finder.

Rows are sparse entries (row, slot, value).  A few more random directions than
components wanted are drawn through the rows; each slot's directions come from a
hash of its number, so no matrix over the slots is ever made.  One or
more passes through rows and slots turn the directions towards the widest
ones; the components are then found among them.  Only matrices of the number of
directions (``k`` + ``OVERSAMPLE``) squared reach the driver, however many slots there are.

Centring is exact and keeps the rows sparse: the rows' projections are centred,
not the rows.  ``n`` counts all rows, those without an entry too.  A hot slot is
one row of the direction table and its entries are combined before the shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.scalars import hash_bucket
from trafficlens.session import cut_lineage

OVERSAMPLE, PASSES, SEED = 8, 2, 17


class Components(NamedTuple):
    """The components by slot (c1 ...), the rows' projections (p1 ...), the components' variances, the total variance."""
    components: DataFrame
    projections: DataFrame
    variances: list[float]
    total: float


def hashed_entries(df: DataFrame, key: str, columns: list[str], buckets: int) -> DataFrame:
    """(row, slot, value): each column's text one-hot in one of its ``buckets`` slots."""
    slots = [hash_bucket(F.coalesce(F.col(c).cast("string"), F.lit("")), buckets).cast("long") + i * buckets for i, c in enumerate(columns)]
    return df.select(F.col(key).alias("row"), F.explode(F.array(*slots)).alias("slot"), F.lit(1.0).alias("value"))


def _named(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i + 1}" for i in range(n)]


def _by_row(entries: DataFrame, directions: list[Column], names: list[str]) -> DataFrame:
    return entries.groupBy("row").agg(*[F.sum(F.col("value") * d).alias(c) for d, c in zip(directions, names, strict=True)])


def _moments(table: DataFrame, names: list[str]) -> tuple[list[float], list[list[float]]]:
    """Column sums, and sums of products, of a table: directions squared numbers."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = table.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in names],
                    *[F.coalesce(F.sum(F.col(names[i]) * F.col(names[j])), F.lit(0.0)) for i, j in pairs]).first()
    products = [[0.0] * len(names) for _ in names]
    for (i, j), v in zip(pairs, got[len(names):], strict=True):
        products[i][j] = products[j][i] = v
    return list(got[:len(names)]), products


def _turned(table: DataFrame, key: str, names: list[str], matrix, new: list[str], less=None) -> DataFrame:
    """The table's columns (less their means) times a matrix."""
    columns = [F.col(c) - F.lit(float(m)) for c, m in zip(names, less or [0.0] * len(names), strict=True)]
    return table.select(key, *[sum((c * F.lit(float(w)) for c, w in zip(columns[1:], matrix[1:, j], strict=True)), columns[0] * F.lit(float(matrix[0, j]))).alias(out)
                               for j, out in enumerate(new)])


def principal_components(entries: DataFrame, n: int, k: int, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = SEED) -> Components:
    """The first ``k`` components (fewer, if the rows have fewer) of ``n`` rows."""
    import numpy as np
    width = k + oversample
    entries = cut_lineage(entries.groupBy("row", "slot").agg(F.sum("value").alias("value")))  # an entry a cell
    square = F.sum(F.col("value") * F.col("value"))
    total = entries.groupBy("slot").agg((square - F.sum("value") * F.sum("value") / n).alias("v")).agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0] / max(n - 1, 1)
    if n < 2 or total <= 0:
        return Components(entries.select("slot").limit(0), entries.select("row").limit(0), [], 0.0)
    names, slots = _named("y", width), _named("q", width)
    coin = [F.pmod(F.xxhash64("slot", F.lit(seed), F.lit(j)), F.lit(2)) * 2.0 - 1.0 for j in range(width)]
    rows = cut_lineage(_by_row(entries, coin, names))
    for _ in range(passes):
        sums, _ = _moments(rows, names)
        centred = rows.select("row", *[(F.col(c) - F.lit(s / n)).alias(c) for c, s in zip(names, sums, strict=True)])
        by_slot = entries.join(centred, "row").groupBy("slot").agg(*[F.sum(F.col("value") * F.col(c)).alias(q) for c, q in zip(names, slots, strict=True)])
        by_slot = cut_lineage(by_slot)
        values, vectors = np.linalg.eigh(np.array(_moments(by_slot, slots)[1]))
        kept = values > 1e-12 * values.max()
        slots, names = _named("q", int(kept.sum())), _named("y", int(kept.sum()))
        by_slot = cut_lineage(_turned(by_slot, "slot", _named("q", len(values)), vectors[:, kept] / np.sqrt(values[kept]), slots))
        rows = cut_lineage(_by_row(entries.join(by_slot, "slot"), [F.col(q) for q in slots], names))
    sums, products = _moments(rows, names)
    means = [s / n for s in sums]
    covariance = (np.array(products) - n * np.outer(means, means)) / (n - 1)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:k]
    vectors = vectors[:, order] * np.where(np.abs(vectors[:, order]).max(0) == vectors[:, order].max(0), 1.0, -1.0)
    found = len(order)
    return Components(_turned(by_slot, "slot", slots, vectors, _named("c", found)), _turned(rows, "row", names, vectors, _named("p", found), means),
                      [float(max(v, 0.0)) for v in values[order]], float(total))
