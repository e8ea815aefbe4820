"""Folds, grid and random search, validation and split-size curves.

Folds are stratified exactly without a per-class window: the keyed hash is
spread evenly, so a class is cut into stretches of it, whose sizes one combining
aggregate counts; a row's rank is its place in its stretch behind the stretches
before, and fold = rank mod k.  Rows are shuffled once and not written.
CrossValidator reads the fold column (``foldCol``), so folds do not depend on
partitioning.
"""

from __future__ import annotations

import json
import random
from itertools import product
from typing import NamedTuple

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficlens.operators.evaluate import class_report
from trafficlens.operators.rows import hash_fraction
from trafficlens.session import stored

#: Stretches of the keyed hash that a class is cut into.
STRETCHES = 4096


def stratified_folds(df: DataFrame, label: str, key_cols: list[str], k: int, seed: int = 17,
                     col: str = "fold") -> DataFrame:
    """``df`` with each row's fold, its rank within its class by keyed hash, mod ``k``; ``df`` is read twice."""
    h = df.withColumn("_h", hash_fraction(key_cols, seed)).withColumn("_stretch", F.floor(F.col("_h") * STRETCHES).cast("int"))
    before = Window.partitionBy(label).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    # A row a class and stretch: a tiny table.
    sizes = h.groupBy(label, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    firsts = sizes.select(label, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy(label, "_stretch").orderBy("_h", *key_cols)) - 1
    return h.withColumn("_rn", place).join(F.broadcast(firsts), [label, "_stretch"]) \
        .withColumn(col, ((F.col("_rn") + F.col("_first")) % k).cast("int")).select(*df.columns, col)


def f1_evaluator(label: str = "label", metric: str = "f1", copies: str | None = None) -> MulticlassClassificationEvaluator:
    """Class-1 F1 (metricLabel=1) or accuracy; ``copies``: a column that says how many equal rows a row stands for."""
    more = {"weightCol": copies} if copies else {}
    if metric == "accuracy":
        return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy", **more)
    return MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0, **more)


def grid_search(estimator, grid: list, data: DataFrame, label: str = "label", fold_col: str = "fold",
                metric: str = "f1", parallelism: int = 8, folds: int = 5, copies: str | None = None):
    """CrossValidator over the maps, ``folds`` folds taken from ``fold_col``; refits the best on all rows."""
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=f1_evaluator(label, metric, copies),
                        foldCol=fold_col, numFolds=folds, parallelism=parallelism, seed=17)
    return cv.fit(data)


def drawn(space: dict, draws: int, seed: int = 17) -> list[tuple]:
    """``draws`` different points of a parameter space, with a seed."""
    every = list(product(*space.values()))
    if draws > len(every):
        raise ValueError(f"{draws} draws from {len(every)} maps")
    return random.Random(seed).sample(every, draws)


def random_maps(estimator, space: dict, draws: int, seed: int = 17) -> list:
    """The drawn points as parameter maps."""
    return [{estimator.getParam(k): v for k, v in zip(space, values, strict=True)} for values in drawn(space, draws, seed)]


def cv_results(cv_model) -> DataFrame:
    """One row a parameter map: all its parameters as JSON, the mean metric, and whether it is the best one."""
    rows = [(json.dumps({p.name: v for p, v in pm.items()}, sort_keys=True), float(m))
            for pm, m in zip(cv_model.getEstimatorParamMaps(), cv_model.avgMetrics, strict=True)]
    best = max(range(len(rows)), key=lambda i: rows[i][1])
    return SparkSession.getActiveSession().createDataFrame([(*r, i == best) for i, r in enumerate(rows)],
                                                            "params string, cv_metric double, best boolean")


class Search(NamedTuple):
    """A finished search: the maps' scores, the best map refitted, and its class report on the holdout."""
    results: DataFrame
    model: object
    report: DataFrame


def search(estimator, grid: list, train: DataFrame, holdout: DataFrame, label: str = "label", fold_col: str = "fold",
           metric: str = "f1", folds: int = 5) -> Search:
    """M12 / M13 as a whole: score the maps on ``train``, refit the best one on it, report on ``holdout``."""
    cv = grid_search(estimator, grid, train, label, fold_col, metric, folds=folds)
    scored = cv.bestModel.transform(holdout).select(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"))
    return Search(cv_results(cv), cv.bestModel, class_report(scored, "y", "pred"))


def validation_curve(estimator, param: str, values: list, train: DataFrame, test: DataFrame,
                     label: str = "label", fold_col: str = "fold", folds: int = 5) -> DataFrame:
    """(param, cv_f1, holdout_f1) for each value."""
    p = estimator.getParam(param)
    grid = ParamGridBuilder().addGrid(p, values).build()
    cv = grid_search(estimator, grid, train, label, fold_col, folds=folds)
    ev = f1_evaluator(label)
    rows = []
    for pm, m in zip(grid, cv.avgMetrics, strict=True):
        model = estimator.copy(pm).fit(train)
        rows.append((float(pm[p]), float(m), float(ev.evaluate(model.transform(test)))))
    return SparkSession.getActiveSession().createDataFrame(rows, "param double, cv_f1 double, holdout_f1 double")


def split_size_curve(estimator, data: DataFrame, shares: list[float], label: str, key_cols: list[str],
                     k: int = 2, merged=None) -> DataFrame:
    """For each test share, the rows on both sides, CV F1 (2 folds, as the reference has it here) on the train part
    and holdout F1.

    Shares and folds go by the same keyed hash, so a train part is the first rows of each class in the folds' order, and
    one numbering gives the folds of all shares.  ``merged(rows, *by)``, if given, puts one row with its ``copies`` for
    all equal ones (for an estimator with weights); it is called once for all shares.
    """
    copies = "copies" if merged else None
    ev = f1_evaluator(label, copies=copies)
    rows = []
    if copies:
        estimator = estimator.copy({estimator.weightCol: copies})
    u = F.col("_u")
    band = sum((F.when(u < 1.0 - s, 1).otherwise(0) for s in sorted(shares)), F.lit(0))  # in the train part of that many shares, the first ones
    placed = stratified_folds(data.withColumn("_u", hash_fraction(key_cols, 17)).withColumn("_band", band), label, key_cols, k).drop("_u")
    placed = merged(placed, "fold", "_band") if merged else stored(placed, "split-sizes")
    n = F.sum(copies) if copies else F.count(F.lit(1))
    by_band = {r[0]: int(r[1]) for r in placed.groupBy("_band").agg(n).collect()}  # a row a share
    for s in shares:
        place = sorted(shares).index(s)
        train, test = placed.where(F.col("_band") > place), placed.where(F.col("_band") <= place)
        kept = sum(c for b, c in by_band.items() if b > place)
        cv = grid_search(estimator, [{}], train, label, folds=k, copies=copies)
        rows.append((float(s), kept, sum(by_band.values()) - kept, float(cv.avgMetrics[0]), float(ev.evaluate(cv.bestModel.transform(test)))))
    return SparkSession.getActiveSession().createDataFrame(rows, "test_share double, train_rows long, test_rows long, cv_f1 double, holdout_f1 double")


def fold_scores(estimator, data: DataFrame, label: str = "label", fold_col: str = "fold", folds: int = 5, copies: str | None = None) -> DataFrame:
    """M14 by fold: (fold, rows, positives, f1), each fold scored by a model of the others; ``copies``: how many rows a row is."""
    n = F.col(copies) if copies else F.lit(1)
    counts = {r[0]: (int(r[1]), int(r[2])) for r in data.groupBy(fold_col).agg(F.sum(n), F.sum(F.when(F.col(label) == 1, n).otherwise(0))).collect()}
    if copies:
        estimator = estimator.copy({estimator.weightCol: copies})
    ev, rows = f1_evaluator(label, copies=copies), []
    for k in range(folds):
        model = estimator.fit(data.where(F.col(fold_col) != k))
        rows.append((k, *counts.get(k, (0, 0)), float(ev.evaluate(model.transform(data.where(F.col(fold_col) == k))))))
    return SparkSession.getActiveSession().createDataFrame(rows, "fold int, rows long, positives long, f1 double")
