"""M9: the bucket-vector logistic classifier as a pyspark.ml Estimator / Model pair.

A user's logins (of the listed credential types, or all) are counted by time
group (A7, A8), optionally as shares (A9); the sparse vector of a user goes to
a logistic regression against the user's first label (A10).  Fitting, predicting and
scoring are by user, on login rows.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from trafficlens.functions.timebuckets import ts_group
from trafficlens.operators.aggregates import bucket_counts, first_label, row_normalise
from trafficlens.operators.evaluate import f1_positive
from trafficlens.plans.models import logistic
from trafficlens.session import scratch_path


def bucket_vectors(df: DataFrame, user: str, group: str, value: str, size: int, out: str = "features") -> DataFrame:
    """Long (user, group, value) rows -> one sparse vector per user (at most ``size`` entries).

    The entries are written in the vector type's storage form and read back as
    that type, which also cuts the lineage before an iterative learner.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(group).cast("int").alias("i"), F.col(value).cast("double").alias("v"))))
    form = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("_e.i").alias("indices"), F.col("_e.v").alias("values"))
    path = scratch_path(df.sparkSession, "bucket-vectors")
    df.groupBy(user).agg(entries.alias("_e")).select(user, form.alias(out)).write.parquet(path)
    schema = StructType([df.schema[user], StructField(out, VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path)


class _BLParams(Params):
    parts = Param(Params._dummy(), "parts", "long periods", TypeConverters.toInt)
    shortParts = Param(Params._dummy(), "shortParts", "short periods per long period", TypeConverters.toInt)
    credentialTypes = Param(Params._dummy(), "credentialTypes", "types that count; empty: all rows", TypeConverters.toListString)
    shares = Param(Params._dummy(), "shares", "shares of a user's rows instead of counts", TypeConverters.toBoolean)
    minTs = Param(Params._dummy(), "minTs", "start of the first period", TypeConverters.toFloat)
    maxTs = Param(Params._dummy(), "maxTs", "end of the last period", TypeConverters.toFloat)
    C = Param(Params._dummy(), "C", "inverse regularisation", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    userCol = Param(Params._dummy(), "userCol", "user key", TypeConverters.toString)
    tsCol = Param(Params._dummy(), "tsCol", "epoch time", TypeConverters.toString)
    typeCol = Param(Params._dummy(), "typeCol", "credential type", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "1 = bot", TypeConverters.toString)
    orderCol = Param(Params._dummy(), "orderCol", "row order", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(parts=4, shortParts=168, credentialTypes=[], shares=False, C=1.0, maxIter=100, userCol="USER_ID",
                         tsCol="TIMESTAMP", typeCol="LOGIN_CREDENTIAL_TYPE", labelCol="isBot", orderCol="ROW_ID")

    def vectors(self, df: DataFrame) -> DataFrame:
        """(user, label, features) of the users that have a counted row; bucket 0 is left out, as in the reference."""
        get = self.getOrDefault
        user = get("userCol")
        types = get("credentialTypes")
        rows = df.where(F.col(get("typeCol")).isin(types)) if types else df
        grouped = rows.withColumn("TS_GROUP", ts_group(get("tsCol"), get("minTs"), get("maxTs"), get("parts"), get("shortParts")))
        size = get("parts") * get("shortParts") + 1
        # Rows outside the fitted range have no slot.
        long = bucket_counts(grouped, user, "TS_GROUP", drop_first=True).where(F.col("TS_GROUP").between(1, size - 1))
        if get("shares"):
            long = row_normalise(long, user)
        vec = bucket_vectors(long, user, "TS_GROUP", "share" if get("shares") else "n", size)
        label = first_label(rows, user, get("labelCol"), get("orderCol"))
        return vec.join(label, user)


class BucketLogit(Estimator, _BLParams):
    @keyword_only
    def __init__(self, *, parts=4, shortParts=168, credentialTypes=None, shares=False, minTs=None, maxTs=None, C=1.0, maxIter=100,
                 userCol="USER_ID", tsCol="TIMESTAMP", typeCol="LOGIN_CREDENTIAL_TYPE", labelCol="isBot", orderCol="ROW_ID"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "BucketLogitModel":
        est = self.copy()
        if not (self.isSet("minTs") and self.isSet("maxTs")):
            lo, hi = df.agg(F.min(self.getOrDefault("tsCol")), F.max(self.getOrDefault("tsCol"))).first()
            est._set(minTs=float(lo), maxTs=float(hi))
        users = est.vectors(df).withColumn("_y", F.col(self.getOrDefault("labelCol")).cast("double"))
        learner = logistic("_y", "features", C=self.getOrDefault("C"), n=users.count(), max_iter=self.getOrDefault("maxIter"))
        model = BucketLogitModel(learner.fit(users))
        return est._copyValues(model)


class BucketLogitModel(Model, _BLParams):
    def __init__(self, logit: LogisticRegressionModel | None = None):
        super().__init__()
        self.logit = logit

    def _transform(self, df: DataFrame) -> DataFrame:
        """(user, label, features, probability, prediction) by user."""
        return self.logit.transform(self.vectors(df))

    def score(self, df: DataFrame) -> DataFrame:
        """F1 of class 1 over the users."""
        label = self.getOrDefault("labelCol")
        return f1_positive(self.transform(df).withColumn("_pred", F.col("prediction").cast("int")), label, "_pred")

    def save(self, path: str) -> str:
        """The logistic model and, as one JSON line, the parameters."""
        self.logit.write().overwrite().save(f"{path}/logit")
        params = {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}
        self._spark().createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")
        return path

    @staticmethod
    def _spark():
        from pyspark.sql import SparkSession
        return SparkSession.getActiveSession()

    @classmethod
    def load(cls, path: str) -> "BucketLogitModel":
        params = json.loads(cls._spark().read.text(f"{path}/params").first()[0])
        return cls(LogisticRegressionModel.load(f"{path}/logit"))._set(**params)


def search_grid(train: DataFrame, valid: DataFrame, parts: list[int], short_parts: list[int],
                credential_types: list[list[str]], **fixed) -> tuple[list[tuple[dict, float]], BucketLogitModel]:
    """M9's grid: fit each map on ``train``, score it by user on ``valid``; (map, f1) of all, and the best one's model
    (ties: the first)."""
    scored, best = [], None
    for p in parts:
        for s in short_parts:
            for types in credential_types:
                params = {"parts": p, "shortParts": s, "credentialTypes": types}
                model = BucketLogit(**params, **fixed).fit(train)
                f1 = model.score(valid).first()[0]
                scored.append((params, f1))
                if best is None or f1 > best[0]:
                    best = (f1, model)
    return scored, best[1]
