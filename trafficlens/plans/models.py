"""Learners and model flows on pyspark.ml.

Learners are Spark's distributed ones (trees, forests, linear models).  Fitted
model artifacts (tree nodes, coefficients, PCA loadings) are bounded by the
model, never by the data.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.operators.rows import hash_fraction
from trafficlens.session import cut_lineage, scratch_path, session


def hash_split(df: DataFrame, key_cols: list[str], test_share: float, seed: int = 17,
               col: str = "part") -> DataFrame:
    """M11: 'train' / 'test' by a keyed hash: reproducible and independent of partitioning."""
    return df.withColumn(col, F.when(hash_fraction(key_cols, seed) < F.lit(1.0 - test_share), "train")
                         .otherwise("test"))


def decision_tree(label: str = "label", features: str = "features", depth: int = 5, impurity: str = "gini",
                  seed: int = 17) -> DecisionTreeClassifier:
    """M1; Spark refuses a depth above 30."""
    return DecisionTreeClassifier(labelCol=label, featuresCol=features, maxDepth=depth,
                                  impurity=impurity, seed=seed)


def random_forest(label: str = "label", features: str = "features", trees: int = 100, depth: int = 5,
                  subset: str = "auto", seed: int = 17) -> RandomForestClassifier:
    """M2."""
    return RandomForestClassifier(labelCol=label, featuresCol=features, numTrees=trees, maxDepth=depth,
                                  featureSubsetStrategy=subset, seed=seed)


def importances(model, names: list[str]) -> DataFrame:
    """M2: feature importances by name (bounded by the feature count)."""
    vals = model.featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(names, vals, strict=True)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def linear_svm(label: str = "label", features: str = "features", alpha: float = 1e-4, max_iter: int = 100) -> LinearSVC:
    """M4: hinge loss with L2; Spark's optimiser (OWL-QN), not SGD."""
    return LinearSVC(labelCol=label, featuresCol=features, regParam=alpha, maxIter=max_iter)


def logistic(label: str = "label", features: str = "features", C: float = 1.0, n: int | None = None,
             max_iter: int = 100) -> LogisticRegression:
    """M5: inverse regularisation C -> regParam = 1/(C*n); standardization off for parity."""
    reg = 1.0 / (C * n) if n else 0.0
    return LogisticRegression(labelCol=label, featuresCol=features, regParam=reg, maxIter=max_iter,
                              standardization=False)


def p_bot(df: DataFrame, prob: str = "probability", out: str = "predict_proba") -> DataFrame:
    """P(class 1) per row."""
    return df.withColumn(out, vector_to_array(F.col(prob))[1])


def raw_score(raw: str = "rawPrediction") -> Column:
    """The raw score of class 1."""
    return vector_to_array(F.col(raw))[1]


def checked_score(prediction: str = "prediction", probability: str | None = "probability", raw: str = "rawPrediction",
                  threshold: float = 0.5) -> Column:
    """What holds of a scored row whatever the learner found: the class is 0 or 1, P(1) is a probability, and the
    class is P(1) (without one: the raw score of class 1) over its threshold."""
    p = F.col(prediction)
    score = vector_to_array(F.col(probability or raw))[1]
    ok = p.isin(0.0, 1.0) & ((p == 1.0) == (score > F.lit(threshold if probability else 0.0)))
    return F.coalesce(ok & score.between(0.0, 1.0) if probability else ok, F.lit(False))


def saved_nodes(model) -> DataFrame:
    """The node table that a fitted tree or forest saves (a forest's rows have a treeID); bounded by the model."""
    spark = session()
    path = scratch_path(spark, "tree")
    model.write().save(path)
    return spark.read.parquet(f"{path}/data")


def node_rows(model) -> list:
    """The nodes of a fitted tree on the driver, where the model itself is."""
    return saved_nodes(model).select("id", "prediction", "impurityStats", "leftChild", "rightChild", "split").collect()


def tree_nodes(model, names: list[str]) -> DataFrame:
    """The learned tree, one row a node: the split (feature and threshold), impurity, rows, class counts and
    prediction, and the nodes below.  Read from the node table that the model saves; bounded by the tree."""
    t = saved_nodes(model)
    inner = F.col("leftChild") >= 0
    feature = F.when(inner, F.element_at(F.array(*map(F.lit, names)), F.col("split.featureIndex") + 1))
    numeric = F.col("split.numCategories") < 0
    return t.select(F.col("id").alias("node"), feature.alias("feature"),
                    F.when(inner & numeric, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
                    F.when(inner & ~numeric, F.col("split.leftCategoriesOrThreshold")).alias("left_categories"),
                    "impurity", F.col("rawCount").alias("rows"), F.col("impurityStats").alias("class_counts"), "prediction",
                    F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"))


def selected_features(weights: DataFrame, weight: str = "weight") -> DataFrame:
    """Rows with |weight| >= mean |weight| (the library default)."""
    return weights.where(F.abs(weight) >= weights.select(F.avg(F.abs(weight))).scalar())


def named_weights(coefs, names: DataFrame) -> DataFrame:
    """Weights with the names of their slots (``encode.slot_names``): feature 'column=value', weight."""
    slots = names.count()
    if slots != len(coefs):
        raise ValueError(f"{len(coefs)} weights and {slots} names")
    w = names.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(coefs)], "slot int, weight double")
    return w.join(names, "slot").select(F.concat_ws("=", "column", "value").alias("feature"), "weight")


def save_load(model: PipelineModel, path: str) -> PipelineModel:
    """One folder for the whole fitted chain (encoders + learner)."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def loadings_of(pca_model) -> DataFrame:
    """Squared loadings of a fitted PCA by slot, summed over its components."""
    pc = pca_model.pc.toArray()
    rows = [(int(i), float((pc[i] ** 2).sum())) for i in range(pc.shape[0])]
    return SparkSession.getActiveSession().createDataFrame(rows, "slot int, sq double")


def loadings_by_source(loadings: DataFrame, slots: DataFrame) -> DataFrame:
    """Squared loadings (slot, sq) summed per source column (slots: slot, column)."""
    return loadings.join(slots, "slot").groupBy("column").agg(F.sum("sq").alias("loading"))


def fit_materialised(stages: list, df: DataFrame) -> PipelineModel:
    """Fit feature stages, cut the lineage of the featurised rows once, then fit the learner.

    An iterative learner reads its input once per iteration; re-running the
    feature plan (joins, indexers, encoders) each time dominates the cost.
    The featurised rows are checkpointed reliably into the shared
    ``spark.checkpoint.dir`` (so a lost executor recomputes nothing upstream),
    and the returned PipelineModel holds every stage for serving.
    """
    prep = Pipeline(stages=stages[:-1]).fit(df)
    label = stages[-1].getOrDefault("labelCol")
    feats = cut_lineage(prep.transform(df).select(stages[-1].getOrDefault("featuresCol"), label))
    learner = stages[-1].fit(feats)
    return PipelineModel(stages=[*prep.stages, learner])


def one_distributed_fit(stages: list, df: DataFrame) -> PipelineModel:
    """M7 re-aimed: the reference trains batch by batch for memory; one
    distributed fit over all partitions replaces it."""
    return fit_materialised(stages, df)
