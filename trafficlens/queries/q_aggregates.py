"""A1-A4, A7-A11, A13-A25 over the stand-ins and driver tables."""

from pyspark.sql import functions as F

from trafficlens.functions.ip import int_to_ip
from trafficlens.functions.timebuckets import half_day_bounds, ts_group
from trafficlens.operators import aggregates as ag
from trafficlens.sources import standins as si
from trafficlens.sources.tables import read
from trafficlens.sqltwins import AUTH, HTTP, LOGINS, SCORES, with_

from . import register
from .q_rows import _IP_SQL, _NULLY_SQL, _nully_orders


def _act_counts_sql():
    cols = []
    for i, (lo, hi) in enumerate(half_day_bounds(si.AUTH_WEEK_START), start=1):
        cond = " AND ".join(x for x in (f"TIMESTAMP > {lo}" if lo is not None else "",
                                         f"TIMESTAMP < {hi}" if hi is not None else "") if x)
        cols.append(f"count(CASE WHEN {cond} THEN TIMESTAMP END) AS COUNT_ACT_{i}")
    return ", ".join(cols)


@register("q_a1_activity_counts", with_(AUTH) + f"SELECT IP, count(TIMESTAMP) AS COUNT_ACT_WEEK, {_act_counts_sql()}, "
          "arg_min(BOT_OR_HUMAN, TIMESTAMP) AS label FROM auth GROUP BY IP")
def q_a1(spark, d):
    return ag.activity_counts(si.auth(spark, d), half_day_bounds(si.AUTH_WEEK_START))


@register("q_a2_simple_stats", with_(AUTH) + f"SELECT {_IP_SQL} AS IP, CAST(trunc(avg(TIMESTAMP)) AS BIGINT) AS MEAN, "
          "CASE WHEN count(TIMESTAMP) > 1 THEN CAST(count(TIMESTAMP) * sum(CAST(TIMESTAMP - {o} AS HUGEINT) * "
          "CAST(TIMESTAMP - {o} AS HUGEINT)) - sum(CAST(TIMESTAMP - {o} AS HUGEINT)) * sum(CAST(TIMESTAMP - {o} AS HUGEINT)) "
          "AS DOUBLE) / CAST(CAST(count(TIMESTAMP) AS HUGEINT) * (count(TIMESTAMP) - 1) AS DOUBLE) END AS variance, "
          "max(TIMESTAMP) AS MAX, min(TIMESTAMP) AS MIN FROM auth GROUP BY 1".replace("{o}", str(si.AUTH_WEEK_START)))
def q_a2(spark, d):
    a = si.auth(spark, d).select(int_to_ip("IP").alias("IP"), "TIMESTAMP")
    return ag.simple_stats(a, "IP", origin=si.AUTH_WEEK_START)


@register("q_a3_span_days", with_(LOGINS) + "SELECT (max(TIMESTAMP) - min(TIMESTAMP)) / 86400000.0 AS span_days FROM logins")
def q_a3(spark, d):
    return ag.span_days(si.logins(spark, d), unit_per_day=86_400_000)


@register("q_a4_credential_profile", with_(LOGINS, """per AS (SELECT LOGIN_CREDENTIAL_TYPE, count(*) AS a,
  count(*) FILTER (WHERE isBot = 1) AS b, count(*) FILTER (WHERE isBot = 0) AS u FROM logins GROUP BY 1)""",
    """n AS (SELECT count(DISTINCT USER_ID) AS na, count(DISTINCT USER_ID) FILTER (WHERE isBot = 1) AS nb,
  count(DISTINCT USER_ID) FILTER (WHERE isBot = 0) AS nu FROM logins)""") +
    "SELECT LOGIN_CREDENTIAL_TYPE, a / na AS mean_all, CASE WHEN b > 0 THEN b / nb END AS mean_bots, "
    "CASE WHEN u > 0 THEN u / nu END AS mean_users FROM per, n")
def q_a4(spark, d):
    return ag.credential_profile(si.logins(spark, d))


def _tsg_sql(parts, short):
    return (f"CAST(trunc((TIMESTAMP - mn) / ((mx - mn) / {float(parts)})) AS BIGINT) * {short} + "
            f"CAST(trunc(fmod(CAST(TIMESTAMP - mn AS DOUBLE), (mx - mn) / {float(parts)}) / "
            f"(((mx - mn) / {float(parts)}) / {float(short)})) AS BIGINT)")


_MM = "mm AS (SELECT min(TIMESTAMP) AS mn, max(TIMESTAMP) AS mx FROM logins)"


def logins_grouped(spark, d, parts, short):
    lg = si.logins(spark, d)
    both = lg.select(F.struct(F.min("TIMESTAMP").alias("mn"), F.max("TIMESTAMP").alias("mx"))).scalar()
    rows = lg.withColumn("_b", both)
    return rows.withColumn("TS_GROUP", ts_group("TIMESTAMP", F.col("_b.mn"), F.col("_b.mx"), parts, short)).drop("_b")


@register("q_a7_ts_group", with_(LOGINS, _MM) + f"SELECT ROW_ID, USER_ID, {_tsg_sql(4, 168)} AS TS_GROUP FROM logins, mm")
def q_a7(spark, d):
    return logins_grouped(spark, d, 4, 168).select("ROW_ID", "USER_ID", "TS_GROUP")


_A8_SQL = with_(LOGINS, _MM, f"g AS (SELECT USER_ID, {_tsg_sql(4, 168)} AS TS_GROUP FROM logins, mm)")


@register("q_a8_bucket_counts", _A8_SQL + "SELECT USER_ID, TS_GROUP, count(*) AS n FROM g WHERE TS_GROUP <> 0 GROUP BY 1, 2")
def q_a8(spark, d):
    return ag.bucket_counts(logins_grouped(spark, d, 4, 168), "USER_ID", "TS_GROUP", drop_first=True)


@register("q_a9_row_normalise", _A8_SQL + ", c AS (SELECT USER_ID, TS_GROUP, count(*) AS n FROM g WHERE TS_GROUP <> 0 "
          "GROUP BY 1, 2) SELECT USER_ID, TS_GROUP, n, n / sum(n) OVER (PARTITION BY USER_ID) AS share FROM c")
def q_a9(spark, d):
    c = ag.bucket_counts(logins_grouped(spark, d, 4, 168), "USER_ID", "TS_GROUP", drop_first=True)
    return ag.row_normalise(c, "USER_ID")


@register("q_a10_first_label", with_(LOGINS) + "SELECT USER_ID, arg_min(isBot, ROW_ID) AS isBot FROM logins GROUP BY 1")
def q_a10(spark, d):
    return ag.first_label(si.logins(spark, d), "USER_ID", "isBot", "ROW_ID")


@register("q_a11_count_frequency_quantile", with_(LOGINS, _MM, f"g AS (SELECT USER_ID, {_tsg_sql(4, 10)} AS TS_GROUP "
          "FROM logins, mm)", "c AS (SELECT TS_GROUP, USER_ID, count(*) AS n FROM g GROUP BY 1, 2)",
          "f AS (SELECT TS_GROUP, n, count(*) AS freq FROM c GROUP BY 1, 2)") +
          "SELECT TS_GROUP, quantile_cont(freq, 0.2) AS size FROM f GROUP BY 1")
def q_a11(spark, d):
    return ag.count_frequency_quantile(logins_grouped(spark, d, 4, 10), "TS_GROUP", "USER_ID", 0.2)


@register("q_a13_value_counts", "SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def q_a13(spark, d):
    return ag.value_counts(read(spark, d, "events", ["event_type"]), "event_type")


@register("q_a13_value_counts_head", with_(HTTP) + "SELECT userAgent, count(*) AS count FROM http WHERE userAgent IS NOT "
          "NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def q_a13h(spark, d):
    return ag.value_counts(si.http(spark, d), "userAgent", top=5)


@register("q_a14_normalised_crosstab", "SELECT o_orderstatus, o_orderpriority, count(*) / (SELECT count(*) FROM orders) "
          "AS share FROM orders GROUP BY 1, 2")
def q_a14(spark, d):
    return ag.normalised_crosstab(read(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@register("q_a15_counts_by_class", with_(HTTP) + "SELECT operation, isBot, count(*) AS count FROM http GROUP BY 1, 2")
def q_a15(spark, d):
    return ag.counts_by_class(si.http(spark, d), "operation", "isBot")


@register("q_a16_distinct_values", "SELECT DISTINCT l_returnflag FROM lineitem")
def q_a16(spark, d):
    return ag.distinct_values(read(spark, d, "lineitem"), "l_returnflag")


@register("q_a16_distinct_count", "SELECT count(DISTINCT f) + max(CAST(f IS NULL AS INTEGER)) AS n_unique FROM "
          "(SELECT nullif(l_returnflag, 'R') AS f FROM lineitem) t")
def q_a16c(spark, d):
    li = read(spark, d, "lineitem", ["l_returnflag"]).select(F.nullif("l_returnflag", F.lit("R")).alias("f"))
    return ag.distinct_count(li, "f")


@register("q_a17_non_null_counts", f"SELECT count(o_orderkey) AS o_orderkey, count(o_orderstatus) AS o_orderstatus, "
          f"count(o_orderpriority) AS o_orderpriority, count(o_totalprice) AS o_totalprice FROM ({_NULLY_SQL}) t")
def q_a17(spark, d):
    return ag.non_null_counts(_nully_orders(spark, d))


@register("q_a18_text_summary", """WITH long AS (
  SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
vc AS (SELECT "column", value, count(*) AS c FROM long WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT "column", CAST(sum(c) AS BIGINT) AS "count", count(*) AS "unique",
       first(value ORDER BY c DESC, value) AS top, max(c) AS freq
FROM vc GROUP BY 1""")
def q_a18(spark, d):
    return ag.text_summary(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("q_a19_user_rollup", with_(SCORES) + "SELECT userId, max(p) AS max_p, max(y) AS y, "
          "CAST(max(p) > 0.9 AS INTEGER) AS pred FROM scores GROUP BY 1")
def q_a19(spark, d):
    return ag.user_rollup(si.scores(spark, d), "userId", "p", "y", 0.9)


@register("q_a20_score_range", with_(SCORES) + "SELECT min(p) AS min_p, max(p) AS max_p, avg(p) AS mean_p FROM scores")
def q_a20(spark, d):
    return ag.score_range(si.scores(spark, d), "p")


@register("q_a21_majority_baseline", "SELECT 1.0 - avg(quality) AS baseline FROM labels")
def q_a21(spark, d):
    return ag.majority_baseline(read(spark, d, "labels"), "quality")


@register("q_a22_non_null_share", f"SELECT count(o_orderstatus) / count(*) AS o_orderstatus, "
          f"count(o_orderpriority) / count(*) AS o_orderpriority FROM ({_NULLY_SQL}) t")
def q_a22(spark, d):
    return ag.non_null_share(_nully_orders(spark, d), ["o_orderstatus", "o_orderpriority"])


@register("q_a23_predicted_positive", with_(SCORES) + "SELECT count(*) FILTER (WHERE 1.0 - p < p) AS n_pred_bots FROM scores")
def q_a23(spark, d):
    return ag.predicted_positive(si.scores(spark, d), "p")


@register("q_a25_row_count", "SELECT count(*) AS n_rows FROM orders")
def q_a25(spark, d):
    return ag.row_count(read(spark, d, "orders"))
