"""M12, M15 over depth: one fitted tree, cut at every depth.

A tree grows level by level and a node's split does not look at the greatest
depth, so the tree of depth d is the deepest tree with its nodes at depth d as
leaves.  One fit a fold therefore scores all depths: rows are counted by
(leaf, label) in one aggregate, and each leaf's ancestor at depth d gives the
class there.  Leaves and nodes are bounded by the model.
"""

from __future__ import annotations

import json
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.plans.models import node_rows
from trafficlens.session import session


def leaf_classes(model, depths: list[int]) -> DataFrame:
    """(leaf, depth, prediction): the class that the tree, cut at ``depth``, gives the rows of ``leaf`` (leaves are
    numbered from left to right, as the model's leaf column numbers them)."""
    nodes, out, leaves = {r["id"]: r for r in node_rows(model)}, [], 0
    open_nodes = [(0, ())]
    while open_nodes:
        at, above = open_nodes.pop()
        node = nodes[at]
        path = (*above, float(max(range(len(node["impurityStats"])), key=lambda c: node["impurityStats"][c])))
        if node["leftChild"] < 0:
            out += [(float(leaves), d, path[min(d, len(path) - 1)]) for d in depths]
            leaves += 1
        else:
            open_nodes += [(node["rightChild"], path), (node["leftChild"], path)]
    return session().createDataFrame(out, "leaf double, depth int, prediction double")


def scores_by_depth(model, data: DataFrame, depths: list[int], label: str = "label", copies: str | None = None) -> DataFrame:
    """(depth, f1) of class 1 on ``data`` (``copies``: how many rows a row is) for the model cut at each depth."""
    counted = model.setLeafCol("leaf").transform(data).groupBy("leaf", label).agg((F.sum(copies) if copies else F.count(F.lit(1))).alias("n"))
    found = counted.join(F.broadcast(leaf_classes(model, depths)), "leaf")  # one row a leaf and depth: bounded by the model
    actual, said, n = F.col(label) == 1.0, F.col("prediction") == 1.0, F.col("n")
    hits, wrong = F.sum(F.when(actual & said, n).otherwise(0)), F.sum(F.when(actual != said, n).otherwise(0))
    return found.groupBy("depth").agg(F.when(hits > 0, 2.0 * hits / (2 * hits + wrong)).otherwise(0.0).alias("f1"))


def depth_scores(tree, depths: list[int], train: DataFrame, holdout: DataFrame | None = None, label: str = "label",
                 fold_col: str = "fold", folds: int = 5, copies: str | None = None) -> tuple[DataFrame, object | None]:
    """(depth, cv_f1 and, with a holdout, holdout_f1) for every depth, from one fit a fold and one on all of ``train``;
    and that last, deepest model.  ``copies``: a column that says how many equal rows a row stands for."""
    deepest = tree.copy({tree.maxDepth: max(depths), **({tree.weightCol: copies} if copies else {})})

    def of_fold(k: int):
        if k == folds:
            model = deepest.fit(train)
            return model, scores_by_depth(model, holdout, depths, label, copies).collect()
        return None, scores_by_depth(deepest.fit(train.where(F.col(fold_col) != k)), train.where(F.col(fold_col) == k), depths, label, copies).collect()
    jobs = folds + (holdout is not None)
    with ThreadPool(jobs) as pool:
        found = pool.map(inheritable_thread_target(of_fold), range(jobs))
    spark = session()
    scores = [dict(map(tuple, rows)) for _, rows in found]
    rows = [(d, sum(s[d] for s in scores[:folds]) / folds, scores[folds][d] if holdout is not None else None) for d in depths]
    return spark.createDataFrame(rows, "depth int, cv_f1 double, holdout_f1 double"), found[-1][0]


def search_results(scores: DataFrame) -> DataFrame:
    """The scores as the other searches give them: one row a parameter map, the first of the best marked."""
    rows = sorted(scores.select("depth", "cv_f1").collect())
    best = max(range(len(rows)), key=lambda i: (rows[i].cv_f1, -i))
    return scores.sparkSession.createDataFrame([(json.dumps({"maxDepth": d}), f1, i == best) for i, (d, f1) in enumerate(rows)],
                                               "params string, cv_metric double, best boolean")


def classes_at(model, data: DataFrame, depth: int) -> DataFrame:
    """``data`` with the prediction of the model cut at ``depth``."""
    cut = F.broadcast(leaf_classes(model, [depth]).select("leaf", F.col("prediction").alias("cut_prediction")))
    return model.setLeafCol("leaf").transform(data).join(cut, "leaf").drop("leaf", "prediction", "rawPrediction", "probability") \
        .withColumnRenamed("cut_prediction", "prediction")
