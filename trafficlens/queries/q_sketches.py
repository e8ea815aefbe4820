"""A16, A18, A11 by kept sketches: days merged into weeks, held against the exact figures."""

from pyspark.sql import functions as F

from trafficlens.operators import sketches as sk
from trafficlens.sources import standins as si
from trafficlens.sqltwins import LOGINS, with_

from . import register
from .results import write_result

DAY, WEEK = 86_400_000, 7
_DAYS = with_(LOGINS, f"d AS (SELECT *, TIMESTAMP // {DAY} AS day, TIMESTAMP % {DAY} AS ms FROM logins)",
              f"w AS (SELECT s.day AS week, d.* FROM (SELECT DISTINCT day FROM d) s JOIN d ON d.day BETWEEN s.day AND s.day + {WEEK - 1})")


def _days(spark, d):
    lg = si.logins(spark, d)
    return lg.withColumn("day", F.floor(F.col("TIMESTAMP") / DAY)).withColumn("ms", F.col("TIMESTAMP") % DAY)


def _weeks(spark, d):
    """(every login once a week it is in, the weeks' answers from the days' kept sketches)."""
    days = _days(spark, d)
    kept = write_result(spark, d, "day-sketches", sk.slice_sketches(days, ["day"], "USER_ID", "ms", "LOGIN_CREDENTIAL_TYPE"))
    return sk.over_windows(days, "day", WEEK, "week"), sk.merged(sk.over_windows(kept, "day", WEEK, "week"), ["week"], [0.1, 0.5, 0.9], 2)


@register("q_a16_sketch_weeks", _DAYS + "SELECT week, count(DISTINCT USER_ID) AS users, TRUE AS near FROM w GROUP BY 1")
def q_a16s(spark, d):
    """Users a week, and that the merged sketch is within 5 % of them."""
    rows, weeks = _weeks(spark, d)
    exact = rows.groupBy("week").agg(F.count_distinct("USER_ID").alias("users"))
    return exact.join(weeks, "week").select("week", "users", (F.abs(F.col("distinct") / F.col("users") - 1) <= 0.05).alias("near"))


@register("q_a11_sketch_weeks", _DAYS + "SELECT week, q, count(*) AS rows, TRUE AS near FROM w, (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q) t GROUP BY 1, 2")
def q_a11s(spark, d):
    """Deciles of the time of day a week: the share of rows up to the merged sketch's value is within 2 % of the decile."""
    rows, weeks = _weeks(spark, d)
    asked = weeks.select("week", F.explode(F.arrays_zip(F.array(*map(F.lit, [0.1, 0.5, 0.9])).alias("q"), F.col("quantiles").alias("value"))).alias("a"))
    ranks = rows.join(asked, "week").groupBy("week", "a.q").agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("ms") <= F.col("a.value")).cast("double")).alias("share"))
    return ranks.select("week", "q", "rows", (F.abs(F.col("share") - F.col("q")) <= 0.02).alias("near"))


@register("q_a18_sketch_weeks", _DAYS + "SELECT week, type, n FROM (SELECT week, LOGIN_CREDENTIAL_TYPE AS type, count(*) AS n, "
          "row_number() OVER (PARTITION BY week ORDER BY count(*) DESC) AS place FROM w GROUP BY 1, 2) WHERE place = 1")
def q_a18s(spark, d):
    """The commonest type a week and its count: exact, as a day has fewer types than the sketch tracks."""
    _, weeks = _weeks(spark, d)
    return weeks.select("week", F.col("top")[0]["item"].alias("type"), F.col("top")[0]["count"].alias("n"))
