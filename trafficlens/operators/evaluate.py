"""Classification metrics as aggregates over (label, prediction).

Everything reduces to a few counts first (one map-side-combined aggregate),
so metrics cost one pass over the scored rows.  AUC is exact: scores are
reduced to distinct values, and the running count of negatives is a
distributed prefix sum (one written range layout + per-partition offsets),
never a single-partition window over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.session import cut_lineage


def _counts(df: DataFrame, y: str, pred: str) -> DataFrame:
    yc, pc = F.col(y), F.col(pred)
    return df.agg(F.count_if((yc == 1) & (pc == 1)).alias("tp"), F.count_if((yc == 0) & (pc == 1)).alias("fp"),
                  F.count_if((yc == 1) & (pc == 0)).alias("fn"), F.count_if((yc == 0) & (pc == 0)).alias("tn"))


def _div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def accuracy(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Share of correct predictions and its complement."""
    acc = F.avg((F.col(y) == F.col(pred)).cast("double"))
    return df.agg(acc.alias("accuracy"), (F.lit(1.0) - acc).alias("test_error"))


def f1_positive(df: DataFrame, y: str, pred: str) -> DataFrame:
    """2tp / (2tp + fp + fn) of class 1; 0 when there is nothing to score."""
    c = _counts(df, y, pred)
    return c.select(_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def class_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, f1, support for classes 0 and 1 and the weighted mean."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def one(cls, t, p_all, s_all):
        prec, rec = _div(t, p_all), _div(t, s_all)
        return F.struct(F.lit(cls).alias("class"), prec.alias("precision"), rec.alias("recall"),
                        _div(2 * prec * rec, prec + rec).alias("f1"), s_all.alias("support"))
    c = _counts(df, y, pred).select(one("1", tp, tp + fp, tp + fn).alias("a"), one("0", tn, tn + fn, tn + fp).alias("b"))
    a, b = F.col("a"), F.col("b")

    def mean(m):
        return _div(a[m] * a["support"] + b[m] * b["support"], a["support"] + b["support"]).alias(m)
    both = F.struct(F.lit("weighted avg").alias("class"), mean("precision"), mean("recall"), mean("f1"),
                    (a["support"] + b["support"]).alias("support"))
    # One row of counts becomes the three rows: the scored rows are read once.
    return c.select(F.explode(F.array(a, b, both)).alias("r")).select("r.*")


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Complete 2x2 grid with counts and shares of the total."""
    c = _counts(df, y, pred)
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    cells = [(1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn")]
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("pred"), F.col(n).alias("n"),
                                        _div(F.col(n), total).alias("share")) for a, b, n in cells]))
    return c.select(grid.alias("g")).select("g.*")


def distributed_prefix_sum(df: DataFrame, order: str, cols: list[str], suffix: str = "_before") -> DataFrame:
    """Exclusive running sums of ``cols`` along a unique ``order`` key, partitioned.

    Range-partition on ``order``; per-partition totals (one row per partition)
    give each partition its offset; inside a partition a window ordered by
    ``order`` adds the local running sum.  Range bounds come from a sample, and
    a second read may be cut elsewhere, so the layout is written once (a
    reliable checkpoint) and both the totals and the rows are read from it.
    """
    ranged = cut_lineage(df.repartitionByRange(order).withColumn("_pid", F.spark_partition_id()))
    tot = ranged.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in cols])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_o_{c}") for c in cols])
    local = Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offs), "_pid")
    for c in cols:
        out = out.withColumn(c + suffix, F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(local), F.lit(0)))
    return out.drop("_pid", *[f"_o_{c}" for c in cols])


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """E5: exact ROC AUC (ties count 1/2) by the rank-sum rule over distinct scores."""
    g = df.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    c = distributed_prefix_sum(g, score, ["neg"])
    return c.agg((F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg")))
                  / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def prefix_curve(df: DataFrame, y: str, pred: str, order: list, cuts: list[float]) -> DataFrame:
    """F1 on the first int(n*c) rows (in ``order``, unique) for each cut c.

    The keys at the cuts are found first (``keys_at``: no sort, no copy); then one
    pass over the rows counts tp/fp/fn before each of them.
    """
    from .ordering import first_rows
    n = df.count()
    rows, cuts = [], sorted(cuts)
    for i, (c, head) in enumerate(zip(cuts, first_rows(df, order, [int(n * c) for c in cuts], n), strict=True)):
        yc, pc = F.col(y), F.col(pred)
        rows.append((c, [F.count_if(head & cond).alias(f"{name}_{i}") for name, cond in (
            ("tp", (yc == 1) & (pc == 1)), ("fp", (yc == 0) & (pc == 1)), ("fn", (yc == 1) & (pc == 0)))]))
    counts = df.agg(*[e for _, es in rows for e in es])
    points = [F.struct(F.lit(float(c)).alias("cut"), _div(2 * F.col(f"tp_{i}"), 2 * F.col(f"tp_{i}") + F.col(f"fp_{i}")
                                                         + F.col(f"fn_{i}")).alias("f1")) for i, (c, _) in enumerate(rows)]
    return counts.select(F.explode(F.array(*points)).alias("p")).select("p.*")
