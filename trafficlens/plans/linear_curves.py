"""M15 over a linear learner's own parameters: every value and fold fitted together.

Rows are sparse (``slots``, ``values``, ``label``, ``fold``), as for ``sgd``; a column ``copies`` says how many
equal rows a row stands for.  A curve
has a logistic model a value and fold, and one a value for the holdout; they
differ in their penalty and in the fold they leave out.  All of them go through
``many.minimise``, so a step is one pass over the rows and one combining
aggregate.  The curve over iterations is one fit a fold, looked at after as many
iterations as each value says.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.plans.many import minimise
from trafficlens.session import session


def _margins():
    """Scores an Arrow batch under each model (a row of ``weights``, the intercept last)."""
    def margins(batch, weights):
        import numpy as np
        row = np.repeat(np.arange(batch.num_rows), batch.column("slots").value_lengths().to_numpy(zero_copy_only=False))
        slots, values = batch.column("slots").flatten().to_numpy(), batch.column("values").flatten().to_numpy()
        out = np.stack([np.bincount(row, values * w[slots], batch.num_rows) + w[-1] for w in weights], axis=1)
        return out, row, slots, values
    return margins


LOG, SQUARED_HINGE = "log", "squared hinge"


def _losses(rows: DataFrame, left_out: list[int], size: int, x, loss: str):
    """Summed loss, rows and gradient of every model; model m leaves fold left_out[m] out."""
    import numpy as np
    weights, margins, models, log = np.asarray(x).reshape(len(left_out), size + 1), _margins(), len(left_out), loss == LOG

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            score, row, slots, values = margins(batch, weights)
            sign = 2 * batch.column("label").to_numpy()[:, None] - 1
            copies = batch.column("copies").to_numpy()[:, None]
            there = np.where(batch.column("fold").to_numpy()[:, None] != np.array(left_out)[None], copies, 0.0)
            z = sign * score
            short = np.maximum(1 - z, 0.0)
            cost = np.logaddexp(0, -z) if log else short * short
            pull = there * (-sign / (1 + np.exp(np.clip(z, -700, 700))) if log else -2 * sign * short)
            g = np.stack([np.append(np.bincount(slots, pull[row, m] * values, size), pull[:, m].sum()) for m in range(models)])
            out = np.concatenate([g.ravel(), (there * cost).sum(0), there.sum(0)])
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["at", "v"])
    found = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # bounded by models x slots
    out = np.zeros(models * (size + 3))
    out[found["at"].to_numpy()] = found["v"].to_numpy()
    return out[-2 * models:-models], np.maximum(out[-models:], 1), out[:-2 * models]


def fit(rows: DataFrame, size: int, penalties: list[float], left_out: list[int], per_row: bool, iterations: int, tolerance: float,
        snapshots: tuple[int, ...] = (), loss: str = LOG):
    """Weights of all models (models x (size + 1)) and their snapshots: mean loss plus penalty / 2 of the squared weights
    without the intercept; ``per_row``: the penalty is divided by the model's rows."""
    import numpy as np
    starts = np.arange(len(penalties) + 1) * (size + 1)
    free = np.tile(np.arange(size + 1) == size, len(penalties))

    def at(x, _):
        total, n, g = _losses(rows, left_out, size, x, loss)
        weight = np.array(penalties) / n if per_row else np.array(penalties)
        pull = np.where(free, 0.0, x * np.repeat(weight, size + 1))
        return total / n + np.add.reduceat(np.where(free, 0.0, x) * pull, starts[:-1]) / 2, g / np.repeat(n, size + 1) + pull
    shape = len(penalties), size + 1
    x, taken = minimise(at, starts, iterations, tolerance, snapshots)
    return x.reshape(shape), {k: v.reshape(shape) for k, v in taken.items()}


def _f1(rows: DataFrame, left_out: list[int], weights) -> list[float]:
    """F1 of class 1 of every model on the fold it left out (on all rows for models that left out none: fold -1)."""
    margins, models = _margins(), len(left_out)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            said, actual = margins(batch, weights)[0] > 0, batch.column("label").to_numpy()[:, None] > 0
            mine = (batch.column("fold").to_numpy()[:, None] == np.array(left_out)[None]) | (np.array(left_out) < 0)[None]
            copies = batch.column("copies").to_numpy()[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(models)), pa.array(((said & actual & mine) * copies).sum(0)), pa.array((((said != actual) & mine) * copies).sum(0))],
                                             names=["m", "hits", "wrong"])
    found = rows.mapInArrow(run, "m long, hits double, wrong double").groupBy("m").agg(F.sum("hits").alias("hits"), F.sum("wrong").alias("wrong")).collect()
    by = {r["m"]: 2 * r["hits"] / (2 * r["hits"] + r["wrong"]) if r["hits"] else 0.0 for r in found}
    return [by.get(m, 0.0) for m in range(models)]


def _ready(rows: DataFrame) -> DataFrame:
    fold = F.col("fold") if "fold" in rows.columns else F.lit(0)
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    return rows.select("slots", "values", F.col("label").cast("double").alias("label"), fold.cast("long").alias("fold"), copies.cast("double").alias("copies"))


def penalty_curve(train: DataFrame, holdout: DataFrame, size: int, values: list[float], penalty, per_row: bool = False, folds: int = 5,
                  iterations: int = 60, tolerance: float = 1e-5) -> DataFrame:
    """(param, cv_f1, holdout_f1) for each value, whose penalty is ``penalty(value)``."""
    held = _ready(train).persist()
    try:
        left_out = [k for _ in values for k in (*range(folds), -1)]
        weights, _ = fit(held, size, [penalty(v) for v in values for _ in range(folds + 1)], left_out, per_row, iterations, tolerance)
        by_fold = _f1(held, left_out, weights)
    finally:
        held.unpersist()
    last = _f1(_ready(holdout), [-1] * len(values), weights[folds::folds + 1])
    rows = [(float(v), sum(by_fold[i * (folds + 1):i * (folds + 1) + folds]) / folds, last[i]) for i, v in enumerate(values)]
    return session().createDataFrame(rows, "param double, cv_f1 double, holdout_f1 double")


def map_scores(train: DataFrame, size: int, maps: list[tuple[float, int]], folds: int = 5, loss: str = SQUARED_HINGE, tolerance: float = 1e-6) -> DataFrame:
    """Maps of (regParam, maxIter), as ``tuning.cv_results`` has them: params, cv_metric, best (ties: the first).
    One run fits all maps and folds; a map's iterations are where it is looked at."""
    held, left_out = _ready(train).persist(), [k for _ in maps for k in range(folds)]
    looks = tuple(sorted({n for _, n in maps}))
    try:
        _, taken = fit(held, size, [a for a, _ in maps for _ in range(folds)], left_out, False, looks[-1], tolerance, looks, loss)
        scores = {n: _f1(held, left_out, taken[n]) for n in looks}
    finally:
        held.unpersist()
    means = [sum(scores[n][i * folds:(i + 1) * folds]) / folds for i, (_, n) in enumerate(maps)]
    best = means.index(max(means))
    rows = [(json.dumps({"maxIter": n, "regParam": a}), float(f1), i == best) for i, ((a, n), f1) in enumerate(zip(maps, means, strict=True))]
    return session().createDataFrame(rows, "params string, cv_metric double, best boolean")


def iteration_curve(train: DataFrame, holdout: DataFrame, size: int, values: list[int], penalty: float = 1e-4, folds: int = 5) -> DataFrame:
    """(param, cv_f1, holdout_f1) after each number of iterations, from one run of all folds."""
    held, left_out = _ready(train).persist(), [*range(folds), -1]
    try:
        _, taken = fit(held, size, [penalty] * (folds + 1), left_out, False, max(values), 1e-9, tuple(values))
        by_fold = {v: _f1(held, left_out, taken[v]) for v in values}
    finally:
        held.unpersist()
    import numpy as np
    last = _f1(_ready(holdout), [-1] * len(values), np.stack([taken[v][folds] for v in values]))
    rows = [(float(v), sum(by_fold[v][:folds]) / folds, last[i]) for i, v in enumerate(values)]
    return session().createDataFrame(rows, "param double, cv_f1 double, holdout_f1 double")
