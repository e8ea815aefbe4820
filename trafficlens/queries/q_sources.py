"""Round trips through written files (fresh folders under
the shared checkpoint folder) and the UI-event log parser."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from trafficlens.plans import models as md
from trafficlens.sources import files as fs
from trafficlens.sources import standins as si
from trafficlens.sources.tables import read
from trafficlens.sources.uilog import corrupt_lines, parse_lines, render_from_events
from trafficlens.sqltwins import AUTH, LOGINS, SCORES, TEXT, with_

from . import register


@register("q_s2_csv_typed", with_(AUTH) + "SELECT CAST(IP AS BIGINT) AS IP, TIMESTAMP, BOT_OR_HUMAN FROM auth")
def q_s2(spark, d):
    p = fs.write_csv(si.auth(spark, d), fs.fresh(spark, "auth-csv"))
    return fs.read_csv_typed(spark, p)


@register("q_s3_csv_untyped_cast", with_(AUTH) + "SELECT IP, TIMESTAMP, BOT_OR_HUMAN FROM auth")
def q_s3(spark, d):
    p = fs.write_csv(si.auth(spark, d), fs.fresh(spark, "auth-csv"))
    return fs.read_csv_untyped(spark, p, {"IP": "int", "TIMESTAMP": "long"})


@register("q_s4_tsv", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props FROM events")
def q_s4(spark, d):
    ev = read(spark, d, "events", ["event_id", "event_type", "props"])
    p = fs.write_csv(ev, fs.fresh(spark, "events-tsv"), sep="\t")
    return fs.read_tsv(spark, p)


@register("q_s5_libsvm", """SELECT CAST(label AS DOUBLE) AS label, CAST(slot AS INTEGER) AS slot, value FROM (
  SELECT label, generate_subscripts(embedding, 1) - 1 AS slot, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings) t""")
def q_s5(spark, d):
    e = si.vectors(spark, d).select(F.col("label").cast("double").alias("label"),
                                    array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    p = fs.write_libsvm(e, fs.fresh(spark, "emb-libsvm"))
    back = fs.read_libsvm(spark, p, 64)
    return back.select("label", F.posexplode(vector_to_array("features")).alias("slot", "value"))


@register("q_s6_rows_with_schema", with_(TEXT) + "SELECT doc_id AS id, text, label FROM text")
def q_s6(spark, d):
    """The labelled-document bean schema applied to rows derived from the tables."""
    t = si.text(spark, d).withColumnRenamed("doc_id", "id")
    return fs.with_schema(t, fs.LABELED_DOCUMENT_SCHEMA)


@register("q_s6_document_schema", "SELECT doc_id AS id, text FROM documents")
def q_s6b(spark, d):
    docs = read(spark, d, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "id")
    return fs.with_schema(docs, fs.DOCUMENT_SCHEMA)


@register("q_s7_parquet_same_partitions", "SELECT * FROM orders")
def q_s7(spark, d):
    o = read(spark, d, "orders")
    p = fs.write_parquet(o, fs.fresh(spark, "orders"), same_partitions_as=o)
    return spark.read.parquet(p)


@register("q_s8_parquet_sink", with_(LOGINS) + "SELECT USER_ID, TIMESTAMP, LOGIN_CREDENTIAL_TYPE, isBot FROM logins")
def q_s8(spark, d):
    lg = si.logins(spark, d).drop("ROW_ID")
    return spark.read.parquet(fs.write_parquet(lg, fs.fresh(spark, "logins")))


@register("q_s8_busy_slices", with_(LOGINS, "mn AS (SELECT min(TIMESTAMP) AS m FROM logins)",
          "s AS (SELECT *, (TIMESTAMP - m) // 86400000 AS slice FROM logins, mn)",
          "b AS (SELECT slice FROM s WHERE LOGIN_CREDENTIAL_TYPE = 'error' GROUP BY 1 HAVING count(*) > (SELECT count(*) / 30 FROM s WHERE LOGIN_CREDENTIAL_TYPE = 'error'))") +
          "SELECT ROW_ID, USER_ID, TIMESTAMP, LOGIN_CREDENTIAL_TYPE, isBot, CAST(slice AS INTEGER) AS slice FROM s WHERE slice IN (SELECT slice FROM b)")
def q_s8s(spark, d):
    """All logins of the days with more than a thirtieth of the errors: the days are found while the job runs, and prune the layout."""
    lg = si.logins(spark, d)
    start = lg.agg(F.min("TIMESTAMP")).first()[0]
    path = fs.write_by_slice(lg, fs.fresh(spark, "login-days"), "TIMESTAMP", start, 86_400_000)
    errors = spark.read.parquet(path).where("LOGIN_CREDENTIAL_TYPE = 'error'")
    busy = errors.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > errors.agg(F.count(F.lit(1)) / 30).scalar())
    return fs.read_listed(spark, path, busy)


@register("q_s9_csv_head", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM "
          "(SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100) t")
def q_s9(spark, d):
    o = read(spark, d, "orders", ["o_orderkey", "o_orderstatus"])
    p = fs.write_csv_head(o, fs.fresh(spark, "orders-head"), 100, ["o_orderkey"])
    return spark.read.option("header", True).csv(p)


@register("q_s11_prediction_sink", with_(SCORES) + "SELECT ROW_ID, userId, p AS predict_proba FROM scores")
def q_s11(spark, d):
    s = si.scores(spark, d).select("ROW_ID", "userId", F.col("p").alias("predict_proba"))
    return spark.read.parquet(fs.write_parquet(s, fs.fresh(spark, "predictions")))


_K = "CAST(regexp_extract(props, '\"k\":\\s*(\\d+)', 1) AS BIGINT)"
_MS = "(epoch_us(ts) // 1000)"
UI_SQL = f"""WITH e AS (SELECT *, {_K} AS k, {_MS} AS ms FROM events WHERE event_type <> 'error')
SELECT CASE WHEN event_type = 'purchase' THEN 'WARNING' ELSE 'INFO' END AS level,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS asctime,
  CASE WHEN event_type IN ('click', 'signup') THEN 'click' WHEN event_type = 'view' THEN 'mouse_move' ELSE 'css_load' END
    AS stat_type,
  CASE WHEN event_type IN ('click', 'signup') THEN 'el' || CAST(k AS VARCHAR) END AS element_id,
  CASE WHEN event_type IN ('click', 'signup') THEN 'c' || CAST(k AS VARCHAR) || ' btn' END AS element_class_name,
  CASE WHEN event_type IN ('click', 'signup') THEN 'BUTTON' END AS element_tag_name,
  CASE WHEN event_type IN ('click', 'signup') THEN 't' || CAST(user_id AS VARCHAR) END AS element_oktarget,
  CASE WHEN event_type IN ('click', 'signup') THEN k + 0.25::DOUBLE END AS element_position_top_left_x,
  CASE WHEN event_type IN ('click', 'signup') THEN user_id::DOUBLE END AS element_position_top_left_y,
  CASE WHEN event_type IN ('click', 'signup') THEN k + 0.75::DOUBLE END AS element_position_bottom_right_x,
  CASE WHEN event_type IN ('click', 'signup') THEN user_id + 0.5::DOUBLE END AS element_position_bottom_right_y,
  CASE WHEN event_type IN ('click', 'signup') THEN k + 0.5::DOUBLE WHEN event_type = 'view' THEN user_id::DOUBLE END
    AS mouse_position_x,
  CASE WHEN event_type IN ('click', 'signup') THEN user_id::DOUBLE WHEN event_type = 'view' THEN k + 0.5::DOUBLE END
    AS mouse_position_y,
  CAST(CASE WHEN event_type IN ('click', 'signup') THEN 1280 WHEN event_type = 'view' THEN 1920 END AS DOUBLE)
    AS window_width,
  CAST(CASE WHEN event_type IN ('click', 'signup') THEN 720 WHEN event_type = 'view' THEN 1080 END AS DOUBLE)
    AS window_height,
  CASE WHEN event_type IN ('click', 'signup') THEN ms + 0.5::DOUBLE WHEN event_type <> 'purchase' THEN ms::DOUBLE END
    AS client_timestamp,
  CASE WHEN event_type = 'purchase' THEN CAST(k AS DOUBLE) END AS max_css_load_duration,
  CASE WHEN event_type = 'purchase' THEN CAST(user_id AS DOUBLE) END AS min_css_load_duration
FROM e"""


@register("q_s12_ui_log_parse", UI_SQL)
def q_s12(spark, d):
    ev = read(spark, d, "events", ["ts", "user_id", "event_type", "props"])
    return parse_lines(render_from_events(ev))


@register("q_s12_ui_log_corrupt", f"SELECT 'INFO [' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || "
          f"lpad(CAST({_MS} % 1000 AS VARCHAR), 3, '0') || '] not json ' || CAST({_K} AS VARCHAR) AS line "
          "FROM events WHERE event_type = 'error'")
def q_s12c(spark, d):
    ev = read(spark, d, "events", ["ts", "user_id", "event_type", "props"])
    return corrupt_lines(render_from_events(ev))


@register("q_s13_model_save_load", "SELECT event_id AS ROW_ID, TRUE AS same FROM events")
def q_s13(spark, d):
    from .q_learners import _http_lr
    h, _, _, model = _http_lr(spark, d)
    loaded = md.save_load(model, fs.fresh(spark, "http-model"))
    before = md.p_bot(model.transform(h)).select("ROW_ID", F.col("predict_proba").alias("p_before"))
    after = md.p_bot(loaded.transform(h)).select("ROW_ID", F.col("predict_proba").alias("p_after"))
    return before.join(after, "ROW_ID").select("ROW_ID", (F.col("p_before") == F.col("p_after")).alias("same"))
