"""Projections, filters and scalar expressions."""

from pyspark.sql import functions as F

from trafficlens.functions import ip as ipf
from trafficlens.functions import scalars as sc
from trafficlens.functions.timebuckets import bucket_columns, half_day_bounds
from trafficlens.operators import rows
from trafficlens.operators.windows import sliding_counts
from trafficlens.sources import files as fs
from trafficlens.sources import standins as si
from trafficlens.sources.tables import read
from trafficlens.sqltwins import AUTH, HTTP, LOGINS, SCORES, with_

from . import register

SLICE_START = 1704153600000  # 2024-01-02 00:00:00 UTC in ms
SLICE_MS = 43_200_000        # 12 h, the reference's slice width


@register("q_s1_parquet_projection", "SELECT event_id, user_id, event_type FROM events")
def q_s1(spark, d):
    return read(spark, d, "events", ["event_id", "user_id", "event_type"])


@register("q_p1_label_union", with_(LOGINS) +
          "SELECT USER_ID, TIMESTAMP, LOGIN_CREDENTIAL_TYPE, ROW_ID, isBot FROM logins")
def q_p1(spark, d):
    bots, users = si.bots_and_users(spark, d)
    return rows.label_union(bots, users)


@register("q_p2_drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def q_p2(spark, d):
    return rows.drop_columns(read(spark, d, "orders"), ["o_orderdate", "o_orderpriority"])


_NULLY_SQL = """SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
  nullif(o_orderpriority, '1-URGENT') AS o_orderpriority, o_totalprice FROM orders"""


def _nully_orders(spark, d):
    o = read(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"])
    return o.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
                    F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("o_orderpriority"), "o_totalprice")


@register("q_p3_drop_any_null", f"SELECT * FROM ({_NULLY_SQL}) t WHERE o_orderkey IS NOT NULL AND "
          "o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL")
def q_p3(spark, d):
    return rows.drop_any_null(_nully_orders(spark, d))


@register("q_p4_null_filter", with_(HTTP) + "SELECT ROW_ID, userId FROM http WHERE userAgent IS NULL")
def q_p4(spark, d):
    return rows.null_filter(si.http(spark, d), "userAgent", keep_null=True).select("ROW_ID", "userId")


@register("q_p4_not_null_filter", with_(HTTP) + "SELECT ROW_ID, userAgent FROM http WHERE userAgent IS NOT NULL")
def q_p4b(spark, d):
    return rows.null_filter(si.http(spark, d), "userAgent", keep_null=False).select("ROW_ID", "userAgent")


@register("q_p5_in_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def q_p5(spark, d):
    return rows.in_filter(read(spark, d, "events", ["event_id", "event_type"]), "event_type", ["click", "view"])


@register("q_p6_eq_filter", "SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def q_p6(spark, d):
    return rows.eq_filter(read(spark, d, "events", ["event_id", "user_id", "event_type"]), "event_type", "error") \
        .select("event_id", "user_id")


@register("q_p7_time_slice", with_(LOGINS) + f"SELECT ROW_ID, TIMESTAMP FROM logins WHERE TIMESTAMP >= {SLICE_START} "
          f"AND TIMESTAMP < {SLICE_START + SLICE_MS}")
def q_p7(spark, d):
    return rows.time_slice(si.logins(spark, d), "TIMESTAMP", SLICE_START, SLICE_MS).select("ROW_ID", "TIMESTAMP")


@register("q_p7_time_slice_both_ends", with_(LOGINS) + f"SELECT ROW_ID, TIMESTAMP FROM logins WHERE TIMESTAMP "
          f"BETWEEN {SLICE_START} AND {SLICE_START + SLICE_MS}")
def q_p7b(spark, d):
    return rows.time_slice(si.logins(spark, d), "TIMESTAMP", SLICE_START, SLICE_MS, closed="both") \
        .select("ROW_ID", "TIMESTAMP")


@register("q_p7_slices_on_disk", with_(LOGINS) + f"SELECT ROW_ID, TIMESTAMP FROM logins WHERE TIMESTAMP "
          f"BETWEEN {SLICE_START + 1000} AND {SLICE_START + SLICE_MS + 1000}")
def q_p7d(spark, d):
    """A slice across two of the layout's folders, which alone are read."""
    lg = si.logins(spark, d).select("ROW_ID", "TIMESTAMP")
    path = fs.write_by_slice(lg, fs.fresh(spark, "login-slices"), "TIMESTAMP", SLICE_START, SLICE_MS)
    low = SLICE_START + 1000
    return fs.read_between(spark, path, "TIMESTAMP", SLICE_START, SLICE_MS, low, low + SLICE_MS, closed="both")


@register("q_p8_take_head", "SELECT event_id, user_id, ts FROM events ORDER BY ts, event_id LIMIT 100")
def q_p8(spark, d):
    return rows.take_head(read(spark, d, "events", ["event_id", "user_id", "ts"]), 100, ["ts", "event_id"])


@register("q_p8_all_but_last", "SELECT event_id, user_id FROM events WHERE event_id <> (SELECT max(event_id) FROM events)")
def q_p8b(spark, d):
    return rows.take_head(read(spark, d, "events", ["event_id", "user_id"]), -1, ["event_id"])


_HF = "CAST(('0x' || substring(md5('17|' || CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"


@register("q_p9_hash_sample", f"SELECT event_id, user_id FROM events WHERE {_HF} < 0.1")
def q_p9(spark, d):
    return rows.hash_sample(read(spark, d, "events", ["event_id", "user_id"]), 0.1, ["event_id"], seed=17)


@register("q_p9_hash_sample_n", f"SELECT event_id, user_id FROM events ORDER BY {_HF}, event_id LIMIT 50")
def q_p9n(spark, d):
    return rows.hash_sample_n(read(spark, d, "events", ["event_id", "user_id"]), 50, ["event_id"], seed=17)


@register("q_p10_rename", with_(HTTP) + "SELECT ROW_ID, userId, isBot AS target FROM http")
def q_p10(spark, d):
    return rows.rename(si.http(spark, d).select("ROW_ID", "userId", "isBot"), {"isBot": "target"})


_VTEXT = "CASE WHEN {k} % 7 = 0 THEN 'x' || CAST({k} AS VARCHAR) ELSE CAST({k} / 10.0 AS VARCHAR) END"


@register("q_p11_lossy_int", "SELECT event_id, COALESCE(CAST(trunc(TRY_CAST(" + _VTEXT.format(
    k="CAST(regexp_extract(props, '\"k\":\\s*(\\d+)', 1) AS BIGINT)") + " AS DOUBLE)) AS INTEGER), 0) AS version FROM events")
def q_p11(spark, d):
    ev = read(spark, d, "events", ["event_id", "props"])
    k = si.k_col()
    txt = F.when(k % 7 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise((k / 10.0).cast("string"))
    return ev.select("event_id", sc.lossy_int(txt).alias("version"))


@register("q_p12_bool_norm", "SELECT event_id, COALESCE(CASE WHEN user_id % 5 = 0 THEN NULL ELSE value > 100 END, "
          "false) AS isMobile FROM events")
def q_p12(spark, d):
    ev = read(spark, d, "events", ["event_id", "user_id", "value"])
    raw = F.when(F.col("user_id") % 5 != 0, F.col("value") > 100)
    return ev.select("event_id", sc.bool_norm(raw).alias("isMobile"))


@register("q_p13_none_text", with_(HTTP) + "SELECT ROW_ID, COALESCE(userAgent, 'None') AS userAgent, '' AS referrer FROM http")
def q_p13(spark, d):
    h = si.http(spark, d)
    return h.select("ROW_ID", sc.none_text("userAgent").alias("userAgent"), sc.absent_text().alias("referrer"))


@register("q_p14_array_to_columns", "SELECT p_partkey, COALESCE(string_split(p_name, ' ')[1], '0') AS v0, "
          "COALESCE(string_split(p_name, ' ')[2], '0') AS v1, COALESCE(string_split(p_name, ' ')[3], '0') AS v2, "
          "COALESCE(string_split(p_name, ' ')[9], '0') AS v8 FROM part")
def q_p14(spark, d):
    p = read(spark, d, "part", ["p_partkey", "p_name"])
    arr = F.split("p_name", " ", -1)
    return p.select("p_partkey", *sc.array_to_columns(arr, ["v0", "v1", "v2"]), sc.array_slot(arr, 8).alias("v8"))


@register("q_p15_split_columns", "SELECT page_id, " + ", ".join(
    f"string_split(url, '/')[{k + 1}] AS f{k}" for k in range(5)) + " FROM pages")
def q_p15(spark, d):
    p = read(spark, d, "pages", ["page_id", "url"])
    return p.select("page_id", *sc.split_to_columns("url", "/", [f"f{k}" for k in range(5)]))


def _bucket_sql():
    parts = []
    for i, (lo, hi) in enumerate(half_day_bounds(si.AUTH_WEEK_START), start=1):
        cond = " AND ".join(x for x in (f"TIMESTAMP > {lo}" if lo is not None else "",
                                         f"TIMESTAMP < {hi}" if hi is not None else "") if x)
        parts.append(f"CASE WHEN {cond} THEN TIMESTAMP END AS ACT_{i}")
    return ", ".join(parts)


@register("q_p16_bucket_columns", with_(AUTH) + f"SELECT IP, TIMESTAMP, {_bucket_sql()} FROM auth")
def q_p16(spark, d):
    a = si.auth(spark, d)
    return a.select("IP", "TIMESTAMP", *bucket_columns("TIMESTAMP", half_day_bounds(si.AUTH_WEEK_START)))


@register("q_p17_score_class", with_(SCORES) +
          "SELECT ROW_ID, CAST(p > 0.5 AS INTEGER) AS over_half, CAST(p >= 0.3 AS INTEGER) AS from_03 FROM scores")
def q_p17(spark, d):
    s = si.scores(spark, d)
    return s.select("ROW_ID", sc.score_class("p", 0.5).alias("over_half"),
                    sc.score_class("p", 0.3, strict=False).alias("from_03"))


_U = "((CAST(IP AS BIGINT) + 4294967296) % 4294967296)"
_IP_SQL = (f"CAST({_U} // 16777216 AS VARCHAR) || '.' || CAST(({_U} // 65536) % 256 AS VARCHAR) || '.' || "
           f"CAST(({_U} // 256) % 256 AS VARCHAR) || '.' || CAST({_U} % 256 AS VARCHAR)")


@register("q_p18_int_to_ip", with_(AUTH) + f"SELECT DISTINCT IP, {_IP_SQL} AS ip_text FROM auth")
def q_p18(spark, d):
    return si.auth(spark, d).select("IP", ipf.int_to_ip("IP").alias("ip_text")).distinct()


@register("q_p19_ip_to_int", with_(AUTH, f"t AS (SELECT DISTINCT IP, {_IP_SQL} AS ip_text FROM auth)") + """
SELECT IP, ip_text, back, bad, empty_first FROM (
  SELECT IP, ip_text,
    CAST(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS INTEGER) AS back,
    CAST(NULL AS INTEGER) AS bad,
    CAST(CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END AS INTEGER) AS empty_first
  FROM (SELECT IP, ip_text,
          CAST(string_split(ip_text, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(ip_text, '.')[2] AS BIGINT) * 65536
          + CAST(string_split(ip_text, '.')[3] AS BIGINT) * 256 + CAST(string_split(ip_text, '.')[4] AS BIGINT) AS v,
          CAST(string_split(ip_text, '.')[2] AS BIGINT) * 65536
          + CAST(string_split(ip_text, '.')[3] AS BIGINT) * 256 + CAST(string_split(ip_text, '.')[4] AS BIGINT) AS w
        FROM t) s) u""")
def q_p19(spark, d):
    t = si.auth(spark, d).select("IP", ipf.int_to_ip("IP").alias("ip_text")).distinct()
    return t.select("IP", "ip_text", ipf.ip_to_int("ip_text").alias("back"),
                    ipf.ip_to_int(F.concat(F.col("ip_text"), F.lit(".9"))).alias("bad"),
                    ipf.ip_to_int(F.regexp_replace("ip_text", r"^[0-9]+", "")).alias("empty_first"))


@register("q_p20_prefixed", with_(HTTP) + "SELECT ROW_ID, 'operation;' || operation AS operation, "
          "'method;' || method AS method FROM http")
def q_p20(spark, d):
    h = si.http(spark, d)
    return h.select("ROW_ID", sc.prefixed("operation").alias("operation"), sc.prefixed("method").alias("method"))


@register("q_p23_expr_filter", "SELECT event_id, value FROM events WHERE value > 100")
def q_p23(spark, d):
    return rows.expr_filter(read(spark, d, "events", ["event_id", "value"]), "value > 100")


_W, _S = 6 * 3600 * 1000, 3600 * 1000


@register("q_p24_select_fill", with_(LOGINS, "mn AS (SELECT min(TIMESTAMP) AS m FROM logins)") +
          f"SELECT CAST(((TIMESTAMP - m + i * {_S}) // {_W}) * 6 + i AS BIGINT) AS TS_PART, USER_ID, isBot, "
          "count(*) FILTER (WHERE LOGIN_CREDENTIAL_TYPE = 'click') AS click, "
          "count(*) FILTER (WHERE LOGIN_CREDENTIAL_TYPE = 'view') AS view, CAST(0 AS BIGINT) AS refund "
          "FROM logins, mn, range(0, 6) t(i) GROUP BY 1, 2, 3")
def q_p24(spark, d):
    wc = sliding_counts(si.logins(spark, d), _W, _S, ["click", "view"])
    return rows.select_fill(wc, ["TS_PART", "USER_ID", "isBot"], ["click", "view", "refund"])


@register("q_p24_select_existing", with_(LOGINS) +
          "SELECT USER_ID, TIMESTAMP FROM logins")
def q_p24b(spark, d):
    return rows.select_existing(si.logins(spark, d), ["USER_ID", "TIMESTAMP", "DEVICE_ID"])
