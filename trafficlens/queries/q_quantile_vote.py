"""M8 with its parts J5, J6, A12: the quantile-vote classifier end to end in SQL."""

from pyspark.sql import functions as F

from trafficlens.operators.rows import hash_fraction
from trafficlens.plans.quantile_vote import GRID_PARTS, GRID_QUANTILES, GRID_SHORT_PARTS, QuantileVoteClassifier, grid_scores
from trafficlens.sources import standins as si
from trafficlens.sqltwins import LOGINS, with_

from . import register
from .q_aggregates import _MM, _tsg_sql

QV = dict(quantile=0.2, parts=7, shortParts=1)

_QV_SQL = with_(LOGINS, _MM,
                f"g AS (SELECT USER_ID, isBot, ROW_ID, {_tsg_sql(QV['parts'], QV['shortParts'])} AS TS_GROUP FROM logins, mm)",
                "c AS (SELECT isBot, TS_GROUP, USER_ID, count(*) AS n FROM g GROUP BY 1, 2, 3)",
                "f AS (SELECT isBot, TS_GROUP, n, count(*) AS freq FROM c GROUP BY 1, 2, 3)",
                f"q AS (SELECT isBot, TS_GROUP, quantile_cont(freq, {QV['quantile']}) AS size FROM f GROUP BY 1, 2)",
                """qt AS (SELECT coalesce(b.TS_GROUP, u.TS_GROUP) AS TS_GROUP, coalesce(b.size, 0.0) AS size_bots,
  coalesce(u.size, 0.0) AS size_users FROM (SELECT * FROM q WHERE isBot = 1) b
  FULL OUTER JOIN (SELECT * FROM q WHERE isBot = 0) u ON b.TS_GROUP = u.TS_GROUP)""",
                "t AS (SELECT USER_ID, TS_GROUP, count(*) AS size FROM g GROUP BY 1, 2)",
                """tt AS (SELECT t.USER_ID, t.TS_GROUP, t.size, coalesce(qt.size_bots, 0.0) AS size_bots,
  coalesce(qt.size_users, 0.0) AS size_users FROM t LEFT JOIN qt ON t.TS_GROUP = qt.TS_GROUP)""",
                """v AS (SELECT USER_ID, CAST(sum(sign(round(abs(size - size_users) - abs(size - size_bots), 9))) AS DOUBLE) AS vote
  FROM tt GROUP BY 1)""")


def _model(spark, d):
    lg = si.logins(spark, d)
    return lg, QuantileVoteClassifier(**QV).fit(lg)


@register("q_j5_outer_fill", _QV_SQL + "SELECT TS_GROUP, size_bots, size_users FROM qt")
def q_j5(spark, d):
    return _model(spark, d)[1].table


@register("q_j6_left_fill", _QV_SQL + "SELECT USER_ID, TS_GROUP, size, size_bots, size_users FROM tt")
def q_j6(spark, d):
    lg, m = _model(spark, d)
    return m.test_table(lg)


@register("q_a12_signed_vote", _QV_SQL + "SELECT USER_ID, vote FROM v")
def q_a12(spark, d):
    lg, m = _model(spark, d)
    return m.transform(lg).select("USER_ID", "vote")


@register("q_m8_quantile_vote_predict", _QV_SQL + "SELECT USER_ID, vote, CAST(vote > 0 AS INTEGER) AS predicted FROM v")
def q_m8(spark, d):
    lg, m = _model(spark, d)
    return m.transform(lg)


@register("q_m8_quantile_vote_f1", _QV_SQL + """, lab AS (SELECT USER_ID, arg_min(isBot, ROW_ID) AS isBot FROM logins GROUP BY 1),
j AS (SELECT lab.isBot AS y, CAST(v.vote > 0 AS INTEGER) AS p FROM lab JOIN v ON lab.USER_ID = v.USER_ID),
cm AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND p = 0) AS fn FROM j)
SELECT CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM cm""")
def q_m8f1(spark, d):
    lg, m = _model(spark, d)
    return m.score(lg)



FOLDS = 3
_FOLD = f"CAST(floor(CAST(('0x' || substring(md5('17|' || CAST(ROW_ID AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 * {FOLDS}) AS INTEGER)"


@register("q_m8_grid_scores", with_(LOGINS, f"f AS (SELECT *, {_FOLD} AS fold FROM logins)", f"hs AS (SELECT unnest(range({FOLDS})) AS held)",
          "rg AS (SELECT held, min(TIMESTAMP) AS mn, max(TIMESTAMP) AS mx FROM f, hs WHERE fold <> held GROUP BY 1)",
          f"pr AS (SELECT p.parts, s.short_parts FROM (SELECT unnest({GRID_PARTS}) AS parts) p, (SELECT unnest({GRID_SHORT_PARTS}) AS short_parts) s)",
          """c AS (SELECT held, parts, short_parts, USER_ID, isBot, fold = held AS test,
  CAST(trunc((TIMESTAMP - mn) / ((mx - mn) / CAST(parts AS DOUBLE))) AS BIGINT) * short_parts
  + CAST(trunc((fmod(CAST(TIMESTAMP - mn AS DOUBLE), (mx - mn) / CAST(parts AS DOUBLE)))
    / (((mx - mn) / CAST(parts AS DOUBLE)) / CAST(short_parts AS DOUBLE))) AS BIGINT) AS g, count(*) AS n
  FROM f JOIN rg ON TRUE, pr GROUP BY ALL)""",
          "fr AS (SELECT held, parts, short_parts, g, isBot, n, count(*) AS freq FROM c WHERE NOT test GROUP BY ALL)",
          f"""q AS (SELECT held, parts, short_parts, g, quantile_cont(freq, {GRID_QUANTILES}) FILTER (isBot = 1) AS b,
  quantile_cont(freq, {GRID_QUANTILES}) FILTER (isBot = 0) AS u FROM fr GROUP BY ALL)""",
          "t AS (SELECT held, parts, short_parts, USER_ID, g, sum(n) AS n FROM c WHERE test GROUP BY ALL)",
          f"""v AS (SELECT held, parts, short_parts, USER_ID, i, sum(sign(round(abs(t.n - coalesce(u[i], 0.0)) - abs(t.n - coalesce(b[i], 0.0)), 9))) AS vote
  FROM t LEFT JOIN q USING (held, parts, short_parts, g), (SELECT unnest(range(1, {len(GRID_QUANTILES) + 1})) AS i) x GROUP BY ALL)""",
          "y AS (SELECT fold AS held, USER_ID, arg_min(isBot, ROW_ID) AS y FROM f GROUP BY 1, 2)",
          """m AS (SELECT held, parts, short_parts, i, count(*) FILTER (vote > 0 AND y = 1) AS tp, count(*) FILTER (vote > 0 AND y = 0) AS fp,
  count(*) FILTER (vote <= 0 AND y = 1) AS fn FROM v JOIN y USING (held, USER_ID) GROUP BY ALL)""") +
          f"""SELECT parts, short_parts, CAST(({GRID_QUANTILES})[i] AS DOUBLE) AS quantile,
  round(sum(CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END) / {FOLDS}, 9) AS f1 FROM m GROUP BY ALL""")
def q_m8grid(spark, d):
    """The reference's 720 maps, cross-validated over 3 folds of the rows."""
    fold = F.floor(hash_fraction(["ROW_ID"], 17) * FOLDS).cast("int")
    return grid_scores(si.logins(spark, d), fold, FOLDS).withColumn("f1", F.round("f1", 9))
