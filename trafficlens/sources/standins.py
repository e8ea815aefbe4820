"""Stand-ins for the reference's tables, derived by Spark from the driver tables.

Each stand-in is a lazy projection of ``events`` (or another driver table), so
its size grows with the data and Catalyst prunes and pushes filters through
it.  The rules are listed in FIXTURES.md section 2; the SQL twins used by the
oracle are in ``trafficlens.sqltwins``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.ip import wrap_int32

from .tables import epoch_millis, read

# The five event types of the driver's events table, used as the
# credential types of the logins stand-in.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

# The twelve literal user agents of the http stand-in (index 0 first; see user_agent_col).
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.6099.109 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Safari/605.1.15",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.6099.144 Mobile Safari/537.36",
    "Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/16.6 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 (compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm)",
    "curl/8.4.0",
    "python-requests/2.31.0",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.91",
    "Mozilla/5.0 (Linux; Android 13; SM-X700) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.6045.163 Safari/537.36",
]

# Fixed value: week start of the auth stand-in (2024-01-01 00:00:00 UTC, seconds).
AUTH_WEEK_START = 1704067200


def _events(spark: SparkSession, sf_dir: str, cols) -> DataFrame:
    return read(spark, sf_dir, "events", cols)


def is_bot_col():
    return (F.col("user_id") % 10 == 0).cast("int")


def acts_as_bot_col():
    """Whether a user behaves like a bot: most bots do, some hide, and some people look like one."""
    u = F.col("user_id")
    return ((u % 10 == 0) & (u % 70 != 0)) | (u % 41 == 7)


def event_type_col():
    """What shows in behaviour: who acts as a bot has mostly errors, three in four errors of the others are views."""
    kind, at = F.col("event_type"), F.col("event_id")
    return F.when(acts_as_bot_col(), F.when(at % 10 < 8, "error").otherwise(kind)) \
        .when((kind == "error") & (at % 4 != 0), "view").otherwise(kind)


def k_col():
    """The number held in ``props`` (``{"k": n}``)."""
    return F.regexp_extract(F.col("props"), r'"k":\s*(\d+)', 1).cast("long")


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USER_ID, TIMESTAMP (ms), LOGIN_CREDENTIAL_TYPE, isBot, ROW_ID (row order)."""
    ev = _events(spark, sf_dir, ["event_id", "ts", "user_id", "event_type"])
    return ev.select(
        F.col("user_id").alias("USER_ID"),
        epoch_millis(ev, "ts").alias("TIMESTAMP"),
        event_type_col().alias("LOGIN_CREDENTIAL_TYPE"),
        is_bot_col().alias("isBot"),
        F.col("event_id").alias("ROW_ID"),
    )


def bots_and_users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two unlabelled login tables the reference starts from (P1 input)."""
    lg = logins(spark, sf_dir).drop("isBot")
    cond = F.col("USER_ID") % 10 == 0
    return lg.where(cond), lg.where(~cond)


def auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IP INT, TIMESTAMP LONG seconds, BOT_OR_HUMAN 'bot'/'human'; who acts as a bot comes in bursts."""
    ev = _events(spark, sf_dir, ["event_id", "ts", "user_id"])
    at = F.expr("div(" + _ms_sql(ev) + ", 1000)")
    # In bursts: four of ten events fall into the first three days, eight of ten into the first half of their day.
    turn = F.when(acts_as_bot_col(), F.col("event_id") % 10).otherwise(9)
    at = F.when(turn < 4, AUTH_WEEK_START + (at - AUTH_WEEK_START) % (3 * 86400)).otherwise(at)
    return ev.select(
        wrap_int32(F.col("user_id") * F.lit(2654435761)).alias("IP"),
        F.when(turn < 8, at - at % 86400 + at % 43200).otherwise(at).alias("TIMESTAMP"),
        F.when(F.col("user_id") % 10 == 0, "bot").otherwise("human").alias("BOT_OR_HUMAN"),
    )


def _ms_sql(ev: DataFrame) -> str:
    from pyspark.sql.types import TimestampNTZType

    from .tables import ntz_millis_sql
    if isinstance(ev.schema["ts"].dataType, TimestampNTZType):
        return ntz_millis_sql("ts")
    return "unix_millis(ts)"


def user_agent_col():
    """One of the agents; places 6 to 9 are tools, which who acts as a bot mostly shows and others rarely."""
    agents, own = F.array(*[F.lit(a) for a in USER_AGENTS]), F.col("user_id") % 12
    acts, at = acts_as_bot_col(), F.col("event_id")
    place = F.when(acts & (at % 10 < 7), 6 + F.floor(F.col("user_id") / 10) % 4) \
        .when(~acts & own.between(6, 9) & (at % 8 != 0), own - 6).otherwise(own)
    return F.when(F.col("user_id") % 25 == 0, F.lit(None).cast("string")).otherwise(F.element_at(agents, (place + 1).cast("int")))


def http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP-request stand-in: one row per event."""
    ev = _events(spark, sf_dir, ["event_id", "ts", "user_id", "event_type", "props"])
    k = k_col()
    return ev.select(
        F.col("event_id").alias("ROW_ID"),
        F.col("user_id").alias("userId"),
        event_type_col().alias("operation"),
        F.concat(F.lit("r"), (k % 3).cast("string")).alias("requestType"),
        F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"),
        k.alias("browserId"),
        epoch_millis(ev, "ts").alias("timestamp"),
        user_agent_col().alias("userAgent"),
        is_bot_col().alias("isBot"),
    )


def user_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(userId, browserId, ROW_ID); userId is text, 'null' for user_id % 7 = 0 on browsers k < 20."""
    ev = _events(spark, sf_dir, ["event_id", "user_id", "props"])
    anon = (F.col("user_id") % 7 == 0) & (k_col() < 20)
    return ev.select(
        F.when(anon, F.lit("null")).otherwise(F.col("user_id").cast("string")).alias("userId"),
        k_col().alias("browserId"),
        F.col("event_id").alias("ROW_ID"),
    )


def bot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct user ids of the bots that had an error; as long as there are such bots."""
    ev = _events(spark, sf_dir, ["user_id", "event_type"])
    return ev.where((is_bot_col() == 1) & (F.col("event_type") == "error")).select(F.col("user_id").alias("userId")).distinct()


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row scores: p = value / 500 clipped to 1, y = isBot."""
    ev = _events(spark, sf_dir, ["event_id", "user_id", "value"])
    return ev.select(
        F.col("event_id").alias("ROW_ID"),
        F.col("user_id").alias("userId"),
        F.least(F.col("value") / 500.0, F.lit(1.0)).alias("p"),
        is_bot_col().alias("y"),
    )


def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: doc_id, text, label (quality as DOUBLE)."""
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    lab = read(spark, sf_dir, "labels", ["doc_id", "quality"])
    return docs.join(lab, "doc_id", "inner").select("doc_id", "text", F.col("quality").cast("double").alias("label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding (64 floats), label 0-9."""
    return read(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
