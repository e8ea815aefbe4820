"""M8: the quantile-vote classifier as a pyspark.ml Estimator / Model pair, and its grid.

fit:     time groups (A7) -> per class, users per count -> q-quantile of those
         frequencies per group (A11) -> bots and users side by side, missing = 0 (J5).
predict: time groups with the fitted range -> rows per (user, group) -> join the
         quantile table, missing = 0 (J6) -> signed vote per user (A12).
score:   F1 of the vote against each user's first label (A10, E2).

The model's state is two numbers (time range) and the quantile table, which
has at most parts * short_parts + 1 rows: a bounded table, broadcast in predict.
It is written with ``save`` and read with ``QuantileVoteModel.load``.
"""

from __future__ import annotations

import json

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.timebuckets import ts_group
from trafficlens.operators.aggregates import first_label, signed_vote
from trafficlens.operators.evaluate import f1_positive
from trafficlens.operators.joins import left_fill
from trafficlens.session import cut_lineage, stored


class _QVParams(Params):
    quantile = Param(Params._dummy(), "quantile", "quantile of count frequencies", TypeConverters.toFloat)
    parts = Param(Params._dummy(), "parts", "long periods", TypeConverters.toInt)
    shortParts = Param(Params._dummy(), "shortParts", "short periods per long period", TypeConverters.toInt)
    userCol = Param(Params._dummy(), "userCol", "user key", TypeConverters.toString)
    tsCol = Param(Params._dummy(), "tsCol", "epoch time", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "1 = bot", TypeConverters.toString)
    orderCol = Param(Params._dummy(), "orderCol", "row order", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(quantile=0.2, parts=4, shortParts=168, userCol="USER_ID", tsCol="TIMESTAMP",
                         labelCol="isBot", orderCol="ROW_ID")


def _side_by_side(freq: DataFrame, keys: list[str], label: str, quantile) -> DataFrame:
    """J5 in one pass: the classes' quantiles of ``_freq`` per ``keys``, a class without rows as 0."""
    def of(value):
        return F.percentile(F.when(F.col(label) == value, F.col("_freq")), quantile)
    return freq.groupBy(*keys).agg(of(1).alias("size_bots"), of(0).alias("size_users"))


class QuantileVoteClassifier(Estimator, _QVParams):
    @keyword_only
    def __init__(self, *, quantile=0.2, parts=4, shortParts=168, userCol="USER_ID", tsCol="TIMESTAMP",
                 labelCol="isBot", orderCol="ROW_ID"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "QuantileVoteModel":
        ts, user, label = self.getOrDefault("tsCol"), self.getOrDefault("userCol"), self.getOrDefault("labelCol")
        rng = df.agg(F.min(ts).alias("mn"), F.max(ts).alias("mx")).first()
        model = QuantileVoteModel(rng["mn"], rng["mx"])
        self._copyValues(model)
        # Both classes in one pass over the rows.
        sizes = model.groups(df).groupBy("TS_GROUP", user, label).agg(F.count(F.lit(1)).alias("_n"))
        freq = sizes.groupBy("TS_GROUP", label, "_n").agg(F.count(F.lit(1)).alias("_freq"))
        table = _side_by_side(freq, ["TS_GROUP"], label, F.lit(self.getOrDefault("quantile"))).na.fill(0.0)
        # Computed once: predict and score read the stored table.
        model.table = cut_lineage(table)
        return model


class QuantileVoteModel(Model, _QVParams):
    def __init__(self, min_ts=None, max_ts=None, table: DataFrame | None = None):
        super().__init__()
        self.min_ts, self.max_ts, self.table = min_ts, max_ts, table

    def groups(self, df: DataFrame) -> DataFrame:
        return df.withColumn("TS_GROUP", ts_group(self.getOrDefault("tsCol"), self.min_ts, self.max_ts,
                                                  self.getOrDefault("parts"), self.getOrDefault("shortParts")))

    def test_table(self, df: DataFrame) -> DataFrame:
        user = self.getOrDefault("userCol")
        sizes = self.groups(df).groupBy(user, "TS_GROUP").agg(F.count(F.lit(1)).alias("size"))
        return left_fill(sizes, self.table, ["TS_GROUP"], 0.0, bounded=True)

    def _transform(self, df: DataFrame) -> DataFrame:
        return signed_vote(self.test_table(df), self.getOrDefault("userCol"), "size", "size_users", "size_bots")

    def score(self, df: DataFrame) -> DataFrame:
        user = self.getOrDefault("userCol")
        truth = first_label(df, user, self.getOrDefault("labelCol"), self.getOrDefault("orderCol"))
        pred = self.transform(df).select(user, "predicted")
        return f1_positive(truth.join(pred, user, "inner"), self.getOrDefault("labelCol"), "predicted")

    def save(self, path: str) -> str:
        """Parameters and time range as one JSON line, the quantile table as Parquet."""
        state = {"min_ts": self.min_ts, "max_ts": self.max_ts, "params": {p.name: self.getOrDefault(p) for p in self.params}}
        spark = self.table.sparkSession
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
        self.table.write.mode("overwrite").parquet(f"{path}/table")
        return path

    @classmethod
    def load(cls, path: str) -> "QuantileVoteModel":
        spark = SparkSession.getActiveSession()
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        model = cls(state["min_ts"], state["max_ts"], spark.read.parquet(f"{path}/table"))
        return model._set(**state["params"])


# --- the grid of the reference ---------------------------------------------

# The parameter grid.
GRID_PARTS = [1, 2, 3, 4, 5, 6, 7, 8]
GRID_SHORT_PARTS = [1, 10, 20, 30, 40, 50, 100, 150, 200]
GRID_QUANTILES = [0.001, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5]

#: Counted rows of a partition: a task spreads them over the folds and short parts, so this bounds what it holds.
GRID_ROWS = 100_000


def grid_scores(df: DataFrame, fold: Column, folds: int, parts=GRID_PARTS, short_parts=GRID_SHORT_PARTS, quantiles=GRID_QUANTILES,
                user: str = "USER_ID", ts: str = "TIMESTAMP", label: str = "isBot", order: str = "ROW_ID") -> DataFrame:
    """Cross-validated F1 of every map: (parts, short_parts, quantile, f1), the mean over the folds.

    For each fold the others' rows are fitted (time range included) and the fold's
    users scored.  Rows are counted to (fold, user, label, time) first and kept with a user's rows
    together, ``GRID_ROWS`` a partition.  So sizes by user and time group are made inside the tasks that
    count them, for one number of parts and all short parts at a time, and are never shuffled or written:
    what moves is how often each size occurs in a time group, and summed hits of each map.
    """
    spark = df.sparkSession
    rows = df.select(user, ts, label, order, fold.alias("fold")).where(F.col(user).isNotNull() & F.col(ts).isNotNull())
    merged = stored(rows.groupBy("fold", user, label, ts).agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("o")), "grid-counts")
    truth = merged.groupBy("fold", user).agg(F.min_by(F.col(label), F.col("o")).alias("y"))
    by_fold = merged.groupBy("fold").agg(F.min(ts).alias("mn"), F.max(ts).alias("mx"), F.count(F.lit(1)).alias("n")).where("fold IS NOT NULL").collect()  # a row a fold
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(r.n for r in by_fold) // GRID_ROWS))
    others = {h: [r for r in by_fold if r.fold != h] for h in range(folds)}
    ranges = [(h, min(r.mn for r in of), max(r.mx for r in of)) for h, of in others.items() if of]
    ranges = F.broadcast(spark.createDataFrame(ranges, "held int, mn long, mx long"))
    counted = merged.drop("o").join(truth, ["fold", user]).repartition(tasks, user).persist(StorageLevel.DISK_ONLY)
    try:
        found = [r for p in parts for r in _grid_hits(counted, ranges, p, short_parts, quantiles, user, ts, label, folds)]
    finally:
        counted.unpersist()
    names = [f"{name}{i}" for i in range(len(quantiles)) for name in ("tp", "fp", "fn")]
    scored = spark.createDataFrame(found, "held int, parts int, short_parts int, " + ", ".join(f"{n} long" for n in names))

    def f1(i):
        all_ = 2 * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}")
        return F.when(all_ != 0, 2 * F.col(f"tp{i}") / all_).otherwise(0.0)
    points = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), f1(i).alias("f1")) for i, q in enumerate(quantiles)]))
    return scored.select("held", "parts", "short_parts", points.alias("p")) \
        .groupBy("parts", "short_parts", F.col("p.quantile").alias("quantile")).agg((F.sum("p.f1") / folds).alias("f1"))


def _grid_hits(counted: DataFrame, ranges: DataFrame, parts: int, short_parts: list[int], quantiles: list[float], user: str, ts: str,
               label: str, folds: int) -> list[tuple]:
    """(held, parts, short_parts, hits, false alarms and misses of each quantile) for one number of parts; bounded by the grid."""
    period = (F.col("mx") - F.col("mn")).cast("double") / F.lit(float(parts))
    short = period / F.col("short_parts").cast("double")
    rel = (F.col(ts) - F.col("mn")).cast("double")
    group = (rel / period).cast("long") * F.col("short_parts") + (F.pmod(rel, period) / short).cast("long")
    pairs = F.explode(F.array(*[F.lit(s) for s in short_parts]))

    def sizes(held, *by):
        return counted.withColumn("held", held).join(ranges, "held").withColumn("short_parts", pairs).withColumn("TS_GROUP", group) \
            .groupBy("held", "short_parts", "TS_GROUP", user, *by).agg(F.sum("c").alias("n"))
    keys = ["held", "short_parts", "TS_GROUP"]
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda h: h != F.col("fold")))
    freq = sizes(others, label).groupBy(*keys, label, "n").agg(F.count(F.lit(1)).alias("_freq"))
    # At most held folds x time groups rows: bounded by the grid.
    table = F.broadcast(stored(_side_by_side(freq, keys, label, F.array(*[F.lit(float(q)) for q in quantiles])), "grid-quantiles"))
    joined = sizes(F.col("fold"), "y").join(table, keys, "left")

    def vote(i):
        at = lambda c: F.coalesce(F.get(F.col(c), F.lit(i)), F.lit(0.0))
        return F.signum(F.round(F.abs(F.col("n") - at("size_users")) - F.abs(F.col("n") - at("size_bots")), 9))
    votes = joined.groupBy("held", "short_parts", user, "y").agg(*[F.sum(vote(i)).alias(f"v{i}") for i in range(len(quantiles))])
    scored = votes.groupBy("held", F.lit(parts).alias("parts"), "short_parts").agg(*[e for i in range(len(quantiles)) for e in (
        F.count_if((F.col(f"v{i}") > 0) & (F.col("y") == 1)), F.count_if((F.col(f"v{i}") > 0) & (F.col("y") == 0)),
        F.count_if((F.col(f"v{i}") <= 0) & (F.col("y") == 1)))])
    return [tuple(r) for r in scored.collect()]


def search_grid(train: DataFrame, holdout: DataFrame, fold: Column, folds: int, **grid) -> tuple[dict, "QuantileVoteModel", DataFrame]:
    """Best map (ties: the smallest), its model refitted on ``train``, and its F1 on ``holdout``."""
    best = grid_scores(train, fold, folds, **grid).orderBy(F.desc("f1"), "parts", "short_parts", "quantile").first()
    params = {"parts": best.parts, "shortParts": best.short_parts, "quantile": best["quantile"]}
    model = QuantileVoteClassifier(**params).fit(train)
    return {**params, "f1": best.f1}, model, model.score(holdout)
