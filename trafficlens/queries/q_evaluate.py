"""E1-E5, O5 on the scores stand-in (p = value / 500, y = isBot)."""

from pyspark.sql import functions as F

from trafficlens.operators import evaluate as ev
from trafficlens.sources import standins as si
from trafficlens.sources.tables import read
from trafficlens.sqltwins import SCORES, with_

from . import register

_S = with_(SCORES, "s AS (SELECT ROW_ID, y, CAST(p > 0.5 AS INTEGER) AS pred FROM scores)",
           """c AS (SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn FROM s)""")


def _scored(spark, d):
    return si.scores(spark, d).withColumn("pred", (F.col("p") > 0.5).cast("int"))


@register("q_e1_accuracy", _S + "SELECT avg(CAST(y = pred AS DOUBLE)) AS accuracy, 1.0 - avg(CAST(y = pred AS DOUBLE)) "
          "AS test_error FROM s")
def q_e1(spark, d):
    return ev.accuracy(_scored(spark, d), "y", "pred")


@register("q_e2_f1", _S + "SELECT CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM c")
def q_e2(spark, d):
    return ev.f1_positive(_scored(spark, d), "y", "pred")


@register("q_e3_class_report", _S + """, per AS (
  SELECT '1' AS class, CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, tp + fn AS support FROM c
  UNION ALL
  SELECT '0', CASE WHEN tn + fn <> 0 THEN tn / (tn + fn) ELSE 0.0 END,
         CASE WHEN tn + fp <> 0 THEN tn / (tn + fp) ELSE 0.0 END, tn + fp FROM c),
per2 AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM per)
SELECT class, precision, recall, f1, support FROM per2
UNION ALL
SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
       sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per2""")
def q_e3(spark, d):
    return ev.class_report(_scored(spark, d), "y", "pred")


@register("q_e4_confusion", _S + """SELECT * FROM (
  SELECT 1 AS y, 1 AS pred, tp AS n, tp / (tp + fp + fn + tn) AS share FROM c
  UNION ALL SELECT 0, 1, fp, fp / (tp + fp + fn + tn) FROM c
  UNION ALL SELECT 1, 0, fn, fn / (tp + fp + fn + tn) FROM c
  UNION ALL SELECT 0, 0, tn, tn / (tp + fp + fn + tn) FROM c) t""")
def q_e4(spark, d):
    return ev.confusion(_scored(spark, d), "y", "pred")


E5_SQL = """WITH s AS (SELECT round(value) / 500.0 AS p, CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS y
  FROM events),
g AS (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM s GROUP BY p),
c AS (SELECT p, pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM g)
SELECT sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM c"""


@register("q_e5_roc_auc", E5_SQL)
def q_e5(spark, d):
    e = read(spark, d, "events", ["user_id", "value"])
    s = e.select((F.round("value") / 500.0).alias("p"), si.is_bot_col().alias("y"))
    return ev.roc_auc(s, "y", "p")


_CUTS = [round(0.1 * i, 1) for i in range(1, 10)]


@register("q_o5_prefix_curve", _S.replace("WITH ", "WITH ", 1) + """, r AS (SELECT y, pred, row_number() OVER (ORDER BY ROW_ID) - 1 AS rn,
  count(*) OVER () AS n FROM s),
cuts AS (SELECT CAST(unnest(""" + repr(_CUTS) + """) AS DOUBLE) AS cut)
SELECT cut, CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM (
  SELECT cut, count(*) FILTER (WHERE y = 1 AND pred = 1 AND rn < floor(n * cut)) AS tp,
         count(*) FILTER (WHERE y = 0 AND pred = 1 AND rn < floor(n * cut)) AS fp,
         count(*) FILTER (WHERE y = 1 AND pred = 0 AND rn < floor(n * cut)) AS fn
  FROM cuts, r GROUP BY cut) t""")
def q_o5(spark, d):
    return ev.prefix_curve(_scored(spark, d), "y", "pred", ["ROW_ID"], _CUTS)


@register("q_e5_roc_auc_evaluator", E5_SQL)
def q_e5b(spark, d):
    """E5 through Spark's BinaryClassificationEvaluator (numBins=0: exact curve); same value as the rank sum."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    e = read(spark, d, "events", ["user_id", "value"])
    s = e.select((F.round("value") / 500.0).alias("p"), si.is_bot_col().cast("double").alias("y"))
    auc = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(s)
    return spark.range(1).select(F.lit(float(auc)).alias("auc"))
