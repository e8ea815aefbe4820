"""M3: k nearest neighbours through random-projection hash tables with multi-probe.

Each of ``TABLES`` tables cuts the space by planes through the origin, with
entries of 1 and -1; a vector's code says on which side of each it lies.  The number
of planes grows with the logarithm of the training rows, so a cell holds about
two rows, however many there are.  A query looks into its own cell and those
across its nearest planes (the least margins): all sides of ``PROBED`` of the planes.
What it meets is ranked by exact distance, ties by the training key.

Who meets whom is never listed: training rows and queries lie in blocks of bounded size,
each pair of blocks is one group, and a task compares the codes of its two blocks
and gives back each query's k nearest of those it meets. What is shuffled is the rows, once a block of the
other side, and k rows a query and training block; no training row is copied to the driver. Recall is a matter of the data:
vectors of random direction in 64 dimensions are the hardest (tests: at least
0.9 at every k up to 19), rows of few different counts or categories are found
whole.  Only the k training rows of least key among equal vectors can be
anyone's k nearest, so a hot group of equal rows is k rows; equal queries are asked
once.

Rows whose vector is null, holds a null or is not finite, and rows with a null
key, take no part.  All vectors must have ``dim`` entries.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from trafficlens.session import stored

TABLES, PROBED, MOST_PLANES, SEED = 6, 0.7, 62, 17
#: Rows of a block of training rows and of queries, and queries that a task compares at once.
KNOWN_BLOCK, ASKED_BLOCK, _AT_ONCE = 8192, 4096, 64


def planes(dim: int, count: int, seed: int = SEED, tables: int = TABLES) -> list[list[list[int]]]:
    """tables x count planes of ``dim`` entries 1 or -1; the first planes of a table are the same for every count."""
    out = []
    for t in range(tables):
        rng = random.Random(seed * 1000 + t)
        out.append([[rng.choice((-1, 1)) for _ in range(dim)] for _ in range(count)])
    return out


def plane_count(rows: int) -> int:
    """Planes a table for a number of training rows."""
    return max(1, min(MOST_PLANES, math.floor(math.log2(max(rows, 1)) + 0.5) - 1))


def probe_count(n_planes: int) -> int:
    """How many of its planes, the nearest, a query looks across."""
    return math.ceil(PROBED * n_planes)


def _coded(rows: DataFrame, of: list, probed: int) -> DataFrame:
    """``rows`` with ``code`` and ``across``: per table the sides of the planes, and which of them a query looks across, as bits."""
    tables = len(of)
    flat = [p for t in of for p in t]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        at = np.array(flat, float).T
        bits = at.shape[1] // tables
        value = 1 << np.arange(bits, dtype=np.int64)

        def packed(numbers):
            ends = pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * tables)
            return pa.ListArray.from_arrays(ends, pa.array(numbers.ravel(), pa.int64()))
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
            side = (x @ at).reshape(-1, tables, bits) if batch.num_rows else np.zeros((0, tables, bits))
            near = np.argsort(np.abs(side), axis=2, kind="stable")[:, :, :probed]
            yield pa.RecordBatch.from_arrays([*batch.columns, packed(((side > 0) * value).sum(2)), packed(value[near].sum(2))], names=[*batch.schema.names, "code", "across"])
    more = [StructField(c, ArrayType(LongType())) for c in ("code", "across")]
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *more]))


def _usable(rows: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    v = F.transform(vector, lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select(F.col(key).alias("key"), v.alias("vector"), *more).where(F.col("key").isNotNull() & whole)


def _best_of_blocks(k: int, dim: int, tables: int):
    """The function that gives, for a block of queries and one of training rows, each query's k nearest of those it meets."""
    def numbers(table, column, width):
        return table.column(column).combine_chunks().flatten().to_numpy().reshape(-1, width)

    def run(asked, known):
        import numpy as np
        import pyarrow as pa
        order = np.argsort(known.column("place").to_numpy(), kind="stable")
        x, code = numbers(known, "vector", dim)[order] if known.num_rows else np.zeros((0, dim)), None
        found = []
        if asked.num_rows and known.num_rows:
            code, name = numbers(known, "code", tables)[order], known.column("name").to_numpy()[order]
            first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))  # rows of one key are met together
            y, sought, across = numbers(asked, "vector", dim), numbers(asked, "code", tables), numbers(asked, "across", tables)
            xx, yy = (x * x).sum(1), (y * y).sum(1)
            for lo in range(0, len(y), _AT_ONCE):
                hi = min(lo + _AT_ONCE, len(y))
                met = np.zeros((hi - lo, len(x)), bool)
                for t in range(tables):
                    met |= ((sought[lo:hi, t, None] ^ code[None, :, t]) & ~across[lo:hi, t, None]) == 0
                if len(first) < len(x):
                    met = np.repeat(np.logical_or.reduceat(met, first, axis=1), np.diff(np.append(first, len(x))), axis=1)
                with np.errstate(all="ignore"):  # rows that are surely not among the k nearest go; an overflow keeps its row
                    size = yy[lo:hi, None] + xx[None]
                    near, slack = size - 2 * (y[lo:hi] @ x.T), 1e-10 * size
                    if len(x) > k:
                        kth = np.partition(np.where(met, near + slack, np.inf), k - 1, axis=1)[:, k - 1:k]
                        met &= ~(near - slack > kth)
                r, c = np.nonzero(met)
                far = np.zeros(len(r))
                with np.errstate(all="ignore"):
                    for j in range(dim):
                        far += (x[c, j] - y[lo + r, j]) ** 2
                by = np.lexsort((c, far, r))
                r, c, far = r[by], c[by], far[by]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                found.append((lo + r[rank < k], order[c[rank < k]], far[rank < k]))
        r, c, far = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.Table.from_arrays([asked.column("query").take(pa.array(r)), known.column("key").take(pa.array(c)), known.column("label").take(pa.array(c)), pa.array(far)],
                                    names=["query", "key", "label", "distance"])
    return run


def nearest(queries: DataFrame, train: DataFrame, k: int, dim: int, key: str = "id", vector: str = "vector", label: str = "label",
            tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """(query key, rank 1..k, key, label, distance squared) of the nearest training rows that the tables find."""
    first = F.row_number().over(Window.partitionBy("vector").orderBy("key"))
    known = _usable(train, key, vector, F.col(label).alias("label")).withColumn("copy", first).where(F.col("copy") <= k).drop("copy")
    asked = _usable(queries, key, vector)
    each = asked.groupBy("vector").agg(F.min("key").alias("query"))
    rows, lists = known.count(), max(1, math.ceil(each.count() / ASKED_BLOCK))
    n, blocks = plane_count(rows), max(1, math.ceil(rows / KNOWN_BLOCK))
    at = planes(dim, n, seed, tables)
    block, part = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("vector"), F.lit(lists)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    inside = Window.partitionBy("block").orderBy("key")
    placed = _coded(known, at, probe_count(n)).drop("across").withColumn("block", block) \
        .withColumns({"place": F.row_number().over(inside), "name": F.dense_rank().over(inside)}).withColumn("part", every(lists))
    sought = _coded(each, at, probe_count(n)).withColumn("part", part).withColumn("block", every(blocks))
    schema = StructType([each.schema["query"], known.schema["key"], known.schema["label"], StructField("distance", DoubleType())])
    met = sought.groupBy("block", "part").cogroup(placed.groupBy("block", "part")).applyInArrow(_best_of_blocks(k, dim, tables), schema)
    order = Window.partitionBy("query").orderBy("distance", "key")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    same = asked.join(each, "vector").select(F.col("key").alias("asked"), "query")
    return best.join(same, "query").select(F.col("asked").alias("query"), "rank", "key", "label", "distance")


def votes(found: DataFrame, k: int) -> DataFrame:
    """(query, k, vote): the label of most of the k nearest, for every k up to ``k``; ties: the least label."""
    counted = found.select("query", "label", F.explode(F.sequence("rank", F.lit(k))).alias("k")).groupBy("query", "k", "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("query", "k").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("vote"))


def scaled(rows: DataFrame, by: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``vector``: the columns, centred and divided by their deviation over ``by`` (a constant is only centred)."""
    return _scaled(rows, list(by.agg(*_moments(columns)).first()), columns)


def _moments(columns: list[str], of: Column | None = None) -> list[Column]:
    """Mean and deviation of each column, over the rows that ``of`` holds for."""
    return [f(F.col(c) if of is None else F.when(of, F.col(c))) for c in columns for f in (F.avg, F.stddev_pop)]


def _scaled(rows: DataFrame, moments: list, columns: list[str]) -> DataFrame:
    ms = [(moments[2 * i] or 0.0, moments[2 * i + 1] or 1.0) for i in range(len(columns))]
    return rows.withColumn("vector", F.array(*[(F.col(c).cast("double") - m) / s for c, (m, s) in zip(columns, ms, strict=True)]))


def neighbour_curve(train: DataFrame, holdout: DataFrame, columns: list[str], k: int, key: str = "id", label: str = "label",
                    fold_col: str = "fold", folds: int = 5) -> DataFrame:
    """M15 over neighbours: (param, cv_f1, holdout_f1) of class 1 for k = 1 .. ``k``; one search a fold and one on the
    holdout give all k.

    Equal rows have the same neighbours: each different row is asked once, and its vote counts for all its copies.
    The training rows are read for the copies that may be among the k nearest (the k of least key a fold) and for the
    scales, and only what is left of them is searched.
    """
    def copies(rows: DataFrame, *by: str) -> DataFrame:
        counted = rows.where(F.col(key).isNotNull()).groupBy(*by, *columns, label).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("id"))
        return counted.groupBy(*by, *columns).agg(F.min("id").alias("id"), F.collect_list(F.struct(F.col(label).alias("actual"), "n")).alias("of"))

    def f1(asked: DataFrame, known: DataFrame, moments: list) -> DataFrame:
        found = nearest(_scaled(asked, moments, columns), _scaled(known, moments, columns), k, len(columns), "id", "vector", "label")
        said = votes(found, k).join(asked.select(F.col("id").alias("query"), F.explode("of").alias("o")), "query").select("k", "vote", "o.*")
        total = lambda wanted: F.sum(F.when(wanted, F.col("n")).otherwise(0))
        hit, wrong = total((F.col("vote") == 1) & (F.col("actual") == 1)), total(F.col("vote") != F.col("actual"))
        return said.groupBy("k").agg(F.when(hit > 0, 2.0 * hit / (2 * hit + wrong)).otherwise(0.0).alias("f1"))
    least = F.row_number().over(Window.partitionBy(fold_col, *columns).orderBy(key))
    known = stored(train.where(F.col(key).isNotNull()).withColumn("_copy", least).where(F.col("_copy") <= k)
                   .select(F.col(key).alias("id"), F.col(label).alias("label"), fold_col, *columns), "known-rows")
    asked, last = stored(copies(train, fold_col), "asked-rows"), stored(copies(holdout), "asked-rows")
    wide = 2 * len(columns)
    moments = list(train.agg(*[m for f in range(folds) for m in _moments(columns, F.col(fold_col) != f)], *_moments(columns)).first())
    scores = None
    for f in range(folds):
        of = f1(asked.where(F.col(fold_col) == f), known.where(F.col(fold_col) != f), moments[f * wide:(f + 1) * wide]).withColumn("part", F.lit("cv"))
        scores = of if scores is None else scores.unionByName(of)
    scores = scores.unionByName(f1(last, known, moments[folds * wide:]).withColumn("part", F.lit("holdout")))
    mean = lambda part: F.avg(F.when(F.col("part") == part, F.col("f1")))
    return scores.groupBy(F.col("k").cast("double").alias("param")).agg(mean("cv").alias("cv_f1"), mean("holdout").alias("holdout_f1"))
