"""Random forests on different rows with their numbers of copies, all folds of a curve in one fit.

Rows have numeric ``columns``, a ``label`` of 0 or 1, a ``fold`` and ``copies``, how many
equal rows a row stands for.  A tree's bootstrap draws each of n copies as often as a Poisson
number of mean 1 says, so the row as often as one of mean n: drawn by a keyed hash of the row,
the same in every pass.  Trees grow level by level: in one pass per level the tasks sum the
drawn rows of all trees and folds by node, column, bin and class, a combining aggregate adds them up, and
the driver, where the model is, picks each node's split (least Gini impurity) among ``subset`` columns drawn for the node.

What is summed and sent is bounded by the model (folds x trees x nodes x columns x bins), not by the rows.
A column of up to ``BINS`` values is split between any two of them, another one at ``BINS`` quantiles.
"""

from __future__ import annotations

import random
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32


class Forest(NamedTuple):
    """Of every fold left out (-1: none) and tree, by node (children of i: 2i + 1, 2i + 2): the column (-1: a leaf), the last
    bin that goes left, the share of class 1; the gains by column."""
    left_out: list[int]
    cuts: list[list[float]]
    column: object
    bin: object
    share: object
    gains: object


def subset_size(subset: str, columns: int) -> int:
    """How many columns a node's split looks at: a number as text, or "auto", the root of their number."""
    return min(columns, int(subset)) if subset != "auto" else max(1, -int(-(columns ** 0.5) // 1))


def cut_points(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """Per column the values between which a tree may split; at most ``BINS`` - 1."""
    out = []
    for c in columns:
        few = [r[0] for r in rows.select(F.col(c).cast("double").alias(c)).distinct().limit(BINS + 1).collect()]
        if len(few) > BINS:
            few = rows.agg(F.percentile(F.col(c).cast("double"), F.array(*[F.lit(i / BINS) for i in range(BINS)]), F.col("copies").cast("long"))).first()[0]
        few = sorted(set(few))
        out.append([(a + b) / 2 for a, b in zip(few, few[1:], strict=False)])
    return out


def _reader(columns: list[str], cuts: list[list[float]], trees: int, seed: int):
    """The functions that read an Arrow batch; made here so that they travel with the tasks' own."""
    def binned(batch):
        import numpy as np
        return [np.searchsorted(np.array(cut, float), batch.column(c).to_numpy(), side="left") for c, cut in zip(columns, cuts, strict=True)]

    def drawn(batch):
        """Per tree and row how often the row is drawn."""
        import numpy as np
        keys, copies = batch.column("row").to_numpy().astype(np.uint64), batch.column("copies").to_numpy()
        z = keys[None] + (np.arange(trees, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1))[:, None] * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        u, out = (z >> np.uint64(11)).astype(float) / 2 ** 53, np.zeros((trees, batch.num_rows))
        small = copies <= 16
        chance = np.exp(-np.where(small, copies, 0.0))
        below = chance.copy()
        for n in range(1, 80):
            over = u > below
            if not (over & small).any():
                break
            out += over & small
            chance = chance * copies / n
            below = below + chance
        for i in np.flatnonzero(~small):
            out[:, i] = np.random.default_rng([seed, int(keys[i])]).poisson(copies[i], trees)
        return out

    def nodes_of(bins, column, split, levels):
        """Per tree and row the node at the end of so many levels, or the leaf before."""
        import numpy as np
        at, every = np.zeros((len(column), len(bins[0])), int), np.arange(len(column))[:, None]
        stacked, rows = np.stack(bins), np.arange(len(bins[0]))[None]
        for _ in range(levels):
            c = column[every, at]
            right = stacked[np.maximum(c, 0), rows] > split[every, at]
            at = np.where(c >= 0, 2 * at + 1 + right, at)
        return at
    return binned, drawn, nodes_of


def _keyed(rows: DataFrame, columns: list[str]) -> DataFrame:
    fold = F.col("fold") if "fold" in rows.columns else F.lit(0)
    return rows.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col("label").cast("double").alias("label"), fold.cast("long").alias("fold"),
                       F.col("copies").cast("double").alias("copies"), F.xxhash64(*columns, "label", fold).alias("row"))


def fit(rows: DataFrame, columns: list[str], left_out: list[int], trees: int = 100, depth: int = 5, subset: str = "auto", seed: int = 17) -> Forest:
    """A forest for every fold left out (-1: fitted on all rows)."""
    import numpy as np
    cuts, wide, models = cut_points(rows, columns), len(columns), len(left_out)
    held, look = _keyed(rows, columns), subset_size(subset, wide)
    binned, drawn, nodes_of = _reader(columns, cuts, trees, seed)
    slots = 2 ** (depth + 1) - 1
    column, split = np.full((models, trees, slots), -1), np.zeros((models, trees, slots), int)
    share, gains = np.zeros((models, trees, slots)), np.zeros((models, trees, wide))
    for level in range(depth + 1):
        first, width = 2 ** level - 1, 2 ** level
        shape = (models, trees, width, wide, BINS, 2)

        def run(batches, column=column, split=split, first=first, width=width, level=level):
            import numpy as np
            import pyarrow as pa
            each, out = trees * width * BINS * 2, np.zeros((models, wide, trees * width * BINS * 2))
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, weight, label, fold = binned(batch), drawn(batch), batch.column("label").to_numpy() > 0, batch.column("fold").to_numpy()
                for m, left in enumerate(left_out):
                    at = nodes_of(bins, column[m], split[m], level)
                    there = (at >= first) & (fold != left)[None]
                    t, r = np.nonzero(there & (weight > 0))
                    place, w = (t * width + at[t, r] - first) * BINS, weight[t, r]
                    for c in range(wide):
                        out[m, c] += np.bincount((place + bins[c][r]) * 2 + label[r], w, each)
            flat = out.ravel()
            full = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(flat[full])], names=["at", "v"])
        found = held.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # bounded by the model
        sums = np.zeros(int(np.prod(shape)))
        sums[found["at"].to_numpy()] = found["v"].to_numpy()
        sums = np.moveaxis(sums.reshape(models, wide, trees, width, BINS, 2), 1, 3)
        for m in range(models):
            for t in range(trees):
                for n in range(width):
                    node = sums[m, t, n]
                    total = node[0].sum(0)
                    size, at = total.sum(), first + n
                    if not size:
                        continue
                    share[m, t, at] = total[1] / size
                    if level == depth or not total.all():
                        continue
                    left = node.cumsum(1)[:, :-1]
                    right = total - left
                    nl, nr = left.sum(2), right.sum(2)
                    with np.errstate(all="ignore"):
                        after = (2 * left[..., 0] * left[..., 1] / nl + 2 * right[..., 0] * right[..., 1] / nr) / size
                    gain = np.where((nl > 0) & (nr > 0), 2 * total[0] * total[1] / size ** 2 - after, -1.0)
                    allowed = random.Random(f"{seed}|{t}|{at}").sample(range(wide), look)
                    c = max(allowed, key=lambda j, gain=gain: (gain[j].max(), -j))
                    if gain[c].max() <= 1e-15:
                        continue
                    column[m, t, at], split[m, t, at] = c, int(gain[c].argmax())
                    gains[m, t, c] += gain[c].max() * size
    return Forest(left_out, cuts, column, split, share, gains)


def importances(forest: Forest, model: int = 0) -> list[float]:
    """Gain by column, each tree's to the sum of 1, and the forest's to 1."""
    import numpy as np
    by_tree = forest.gains[model]
    total = by_tree.sum(1, keepdims=True)
    mean = np.where(total > 0, by_tree / np.where(total > 0, total, 1), 0.0).sum(0)
    return [float(v) for v in (mean / mean.sum() if mean.sum() > 0 else mean)]


def f1_scores(rows: DataFrame, columns: list[str], forest: Forest) -> list[float]:
    """F1 of class 1 of every model: on the fold that it left out, on all rows if it left out none."""
    import numpy as np
    models, trees, slots = forest.column.shape
    depth = slots.bit_length() - 1
    binned, _, nodes_of = _reader(columns, forest.cuts, trees, 0)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, actual, fold, copies = binned(batch), batch.column("label").to_numpy() > 0, batch.column("fold").to_numpy(), batch.column("copies").to_numpy()
            hits, wrong = np.zeros(models), np.zeros(models)
            for m, left in enumerate(forest.left_out):
                at = nodes_of(bins, forest.column[m], forest.bin[m], depth)
                said = forest.share[m][np.arange(trees)[:, None], at].mean(0) > 0.5
                mine = copies * ((fold == left) | (left < 0))
                hits[m], wrong[m] = (mine * (said & actual)).sum(), (mine * (said != actual)).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(models)), pa.array(hits), pa.array(wrong)], names=["m", "hits", "wrong"])
    sums = _keyed(rows, columns).mapInArrow(run, "m long, hits double, wrong double").groupBy("m").agg(F.sum("hits").alias("hits"), F.sum("wrong").alias("wrong")).collect()
    by = {r.m: 2 * r.hits / (2 * r.hits + r.wrong) if r.hits else 0.0 for r in sums}
    return [by.get(m, 0.0) for m in range(models)]


def features_curve(train: DataFrame, holdout: DataFrame, columns: list[str], subsets: list[str], trees: int = 100, depth: int = 5, folds: int = 5) -> list[tuple]:
    """(number of columns a split looks at, cv_f1, holdout_f1)."""
    rows = []
    for s in subsets:
        forest = fit(train, columns, [*range(folds), -1], trees, depth, s)
        by_fold = f1_scores(train, columns, forest)[:folds]
        whole = Forest([-1], forest.cuts, forest.column[-1:], forest.bin[-1:], forest.share[-1:], forest.gains[-1:])
        rows.append((float(s), sum(by_fold) / folds, f1_scores(holdout, columns, whole)[0]))
    return rows
