"""O1-O4, O6."""

from pyspark.sql import functions as F

from trafficlens.operators import ordering as od
from trafficlens.sources import standins as si
from trafficlens.sources.tables import read
from trafficlens.sqltwins import LOGINS, USER_BROWSER, with_

from . import register


@register("q_o1_sort", "SELECT event_id, user_id FROM events ORDER BY user_id, event_id")
def q_o1(spark, d):
    return od.sort_rows(read(spark, d, "events", ["event_id", "user_id"]), ["user_id", "event_id"])


@register("q_o2_keep_first_owner", with_(USER_BROWSER) + """, own AS (SELECT browserId, arg_min(userId, ROW_ID) AS owner
  FROM user_browser GROUP BY 1)
SELECT ub.userId, ub.browserId, ub.ROW_ID FROM user_browser ub JOIN own USING (browserId) WHERE ub.userId = own.owner""")
def q_o2(spark, d):
    return od.keep_first_owner(si.user_browser(spark, d), "userId", "browserId", "ROW_ID")


@register("q_o3_keep_first_browser", with_(USER_BROWSER) + """, own AS (SELECT userId, arg_min(browserId, ROW_ID) AS first_b
  FROM user_browser GROUP BY 1)
SELECT ub.userId, ub.browserId, ub.ROW_ID FROM user_browser ub JOIN own USING (userId) WHERE ub.browserId = own.first_b""")
def q_o3(spark, d):
    return od.keep_first_browser(si.user_browser(spark, d), "userId", "browserId", "ROW_ID")


@register("q_o4_ordered_split", with_(LOGINS) + """SELECT ROW_ID, CASE WHEN rn < floor(n * 0.5) THEN 'train' ELSE 'test' END
  AS split FROM (SELECT ROW_ID, row_number() OVER (ORDER BY TIMESTAMP, ROW_ID) - 1 AS rn, count(*) OVER () AS n
  FROM logins) t""")
def q_o4(spark, d):
    lg = si.logins(spark, d).select("ROW_ID", "TIMESTAMP")
    return od.ordered_split(lg, 0.5, ["TIMESTAMP", "ROW_ID"]).select("ROW_ID", "split")


@register("q_o6_top_weights", with_(LOGINS) + f"""SELECT CAST(list_position({si.EVENT_TYPES!r}, LOGIN_CREDENTIAL_TYPE) - 1
  AS INTEGER) AS idx, LOGIN_CREDENTIAL_TYPE AS feature, avg(isBot) AS weight FROM logins GROUP BY 2
  ORDER BY weight DESC, idx LIMIT 2""")
def q_o6(spark, d):
    lg = si.logins(spark, d)
    shares = [(F.count_if((F.col("LOGIN_CREDENTIAL_TYPE") == t) & (F.col("isBot") == 1))
               / F.count_if(F.col("LOGIN_CREDENTIAL_TYPE") == t)) for t in si.EVENT_TYPES]
    w = lg.agg(F.array(*shares).alias("w"))
    names = spark.createDataFrame([(i, t) for i, t in enumerate(si.EVENT_TYPES)], "idx int, feature string")
    return od.top_weights("w", names, w, k=2)
