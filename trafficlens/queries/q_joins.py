"""J2-J4, J7 (J1 with the agent job, J5/J6 with the quantile vote)."""

from pyspark.sql import functions as F

from trafficlens.operators import joins as jn
from trafficlens.operators.aggregates import value_counts
from trafficlens.sources import files as fs
from trafficlens.sources import standins as si
from trafficlens.sources.tables import read
from trafficlens.sqltwins import BOT_LIST, HTTP, SCORES, USER_BROWSER, with_

from . import register


@register("q_j2_only_in_bots", """WITH e AS (SELECT CAST(floor(value) AS BIGINT) AS v, user_id FROM events),
b AS (SELECT v FROM e WHERE user_id % 10 = 0), u AS (SELECT DISTINCT v FROM e WHERE user_id % 10 <> 0)
SELECT v, count(*) AS count FROM b WHERE v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM u WHERE u.v IS NOT DISTINCT FROM b.v)
GROUP BY v""")
def q_j2(spark, d):
    e = read(spark, d, "events", ["user_id", "value"]).select(F.floor("value").cast("long").alias("v"), "user_id")
    bot = F.col("user_id") % 10 == 0
    only = jn.only_in_first(e.where(bot).select("v"), e.where(~bot).select("v"), "v")
    return value_counts(only, "v")


@register("q_j3_semi_on_marker", with_(USER_BROWSER) + "SELECT userId, browserId, ROW_ID FROM user_browser WHERE browserId "
          "IN (SELECT browserId FROM user_browser WHERE userId = 'null')")
def q_j3(spark, d):
    return jn.semi_on_marker(si.user_browser(spark, d), "browserId", "userId", "null")


@register("q_j4_membership_flag", with_(HTTP, BOT_LIST) + "SELECT ROW_ID, userId, CASE WHEN userId IN (SELECT "
          "userId FROM bot_list) THEN 1 ELSE 0 END AS inList FROM http")
def q_j4(spark, d):
    h = si.http(spark, d).select("ROW_ID", "userId")
    return jn.membership_flag(h, si.bot_list(spark, d), "userId")


J7_SQL = with_(SCORES, HTTP) + "SELECT s.ROW_ID, s.p, h.operation, h.userId FROM scores s JOIN http h ON s.ROW_ID = h.ROW_ID"


@register("q_j7_join_back", J7_SQL)
def q_j7(spark, d):
    s = si.scores(spark, d).select("ROW_ID", "p")
    h = si.http(spark, d).select("ROW_ID", "operation", "userId")
    return jn.join_back(s, h, "ROW_ID")


@register("q_j7_colocated", J7_SQL)
def q_j7c(spark, d):
    """Predictions and facts kept in buckets of the row key: the join itself shuffles nothing."""
    s = fs.write_bucketed(si.scores(spark, d).select("ROW_ID", "p"), "ROW_ID", 8, "predictions")
    h = fs.write_bucketed(si.http(spark, d).select("ROW_ID", "operation", "userId"), "ROW_ID", 8, "facts")
    return fs.join_colocated(spark, s, h, "ROW_ID")
