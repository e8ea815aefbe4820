"""File streams run to completion with availableNow."""

from pyspark.sql import functions as F

from trafficlens.operators.ordering import first_rows
from trafficlens.plans import sgd
from trafficlens.sources import files as fs
from trafficlens.sources import standins as si
from trafficlens.sources.tables import epoch_millis, read
from trafficlens.sources.uilog import render_from_events
from trafficlens.sqltwins import LOGINS, with_
from trafficlens.streaming import polls as pl
from trafficlens.streaming import streams as st

from . import register
from .q_sources import UI_SQL
from .results import made, scored_rows


def _feed(df, name):
    """Write a table for a stream to read: as many files as the table has partitions, in parallel.

    The stream takes all of them in one trigger, so no row is late.
    """
    path = fs.fresh(df.sparkSession, name)
    df.write.parquet(path)
    return path


@register("q_t1_ui_event_stream", UI_SQL)
def q_t1(spark, d):
    ev = read(spark, d, "events", ["ts", "user_id", "event_type", "props"])
    folder = fs.fresh(spark, "ui-log")
    render_from_events(ev).write.text(folder)
    out = st.run_append(st.ui_event_stream(spark, folder, max_files=2), fs.fresh(spark, "ui-events"))
    return spark.read.parquet(out)


@scored_rows("q_t2_online_scoring", "q_t2_keys", "SELECT CAST(event_id AS VARCHAR) AS ROW_ID, TRUE AS scored FROM events", ["ROW_ID"])
def q_t2(spark, d):
    """Requests with the 23 named fields (some missing) scored by the served model: class and P(bot)."""
    from pyspark.sql.types import StringType, StructField, StructType

    from trafficlens.plans.headers import HEADER_FIELDS, fit_headers_model, training_rows
    from trafficlens.plans.models import checked_score, save_load
    http = si.http(spark, d)
    served = save_load(fit_headers_model(http), fs.fresh(spark, "served-model"))
    folder = fs.fresh(spark, "requests")
    rows = training_rows(http)
    # Every fifth request omits two fields (the JSON writer drops null fields).
    gap = F.col("ROW_ID") % 5 == 0
    rows.select(F.col("ROW_ID").cast("string").alias("ROW_ID"),
                *[F.when(~gap | ~F.lit(c in ("DeviceCpu", "AgentVersion")), F.col(c)).alias(c) for c in HEADER_FIELDS]) \
        .write.json(folder)
    fields = ["ROW_ID", *HEADER_FIELDS]
    schema = StructType([StructField(c, StringType()) for c in fields])
    scored = st.score_requests(spark, folder, schema, served, fields) \
        .select("ROW_ID", "prediction", "predict_proba", checked_score().alias("scored"))
    return spark.read.parquet(st.run_append(scored, fs.fresh(spark, "scored-requests")))


@register("q_t3_live_verdicts", """SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS window_start,
  count(*) FILTER (WHERE least(value / 500.0, 1.0) < 0.5) AS users,
  count(*) FILTER (WHERE least(value / 500.0, 1.0) >= 0.5) AS bots FROM events GROUP BY 1""")
def q_t3(spark, d):
    ev = read(spark, d, "events", ["ts", "value"])
    src = ev.select(F.timestamp_millis(epoch_millis(ev, "ts")).alias("ts"),
                    F.least(F.col("value") / 500.0, F.lit(1.0)).alias("p"))
    stream = spark.readStream.schema(src.schema).parquet(_feed(src, "scored-stream"))
    log = st.run_upsert_log(st.verdict_counts(stream, "ts", "p"), fs.fresh(spark, "verdicts"))
    return st.latest_per_key(spark, log, ["window_start"])


POLL_MS = 3600 * 1000


@register("q_t3_polls", f"""WITH s AS (SELECT epoch_us(ts) // 1000 AS ms, least(value / 500.0, 1.0) AS p FROM events)
SELECT ms // {POLL_MS} * {POLL_MS} AS poll_start, count(*) FILTER (WHERE p < 0.5) AS users, count(*) FILTER (WHERE p >= 0.5) AS bots
FROM s GROUP BY 1 HAVING poll_start + {POLL_MS} <= (SELECT max(ms) FROM s) - {POLL_MS}""")
def q_t3p(spark, d):
    """Verdicts by hourly poll: what the polls that the watermark closed gave out."""
    ev = read(spark, d, "events", ["ts", "value"])
    src = ev.select(F.timestamp_millis(epoch_millis(ev, "ts")).alias("ts"), F.least(F.col("value") / 500.0, F.lit(1.0)).alias("p"))
    stream = spark.readStream.schema(src.schema).parquet(_feed(src, "poll-stream"))
    return pl.polls(spark, pl.run_polls(pl.poll_counts(stream, "ts", "p", POLL_MS), fs.fresh(spark, "polls")))


W6, S1 = 6 * 3600 * 1000, 3600 * 1000


@register("q_t4_sliding_login_stream", with_(LOGINS) + f"""SELECT CAST((TIMESTAMP // {S1} - j) * {S1} AS BIGINT)
  AS window_start, USER_ID, isBot, """ + ", ".join(f"count(*) FILTER (WHERE LOGIN_CREDENTIAL_TYPE = '{t}') AS {t}"
                                                   for t in si.EVENT_TYPES) +
          " FROM logins, range(0, 6) t(j) GROUP BY 1, 2, 3")
def q_t4(spark, d):
    lg = si.logins(spark, d).drop("ROW_ID")
    stream = spark.readStream.schema(lg.schema).parquet(_feed(lg, "login-stream"))
    log = st.run_upsert_log(st.sliding_login_stream(stream, W6, S1, si.EVENT_TYPES), fs.fresh(spark, "login-windows"))
    return st.latest_per_key(spark, log, ["window_start", "USER_ID", "isBot"])


SLICE_MS = 43_200_000  # 12 h, the reference's training slice

_T5 = with_(LOGINS, "mn AS (SELECT min(TIMESTAMP) AS m FROM logins)",
            "h AS (SELECT *, row_number() OVER (ORDER BY TIMESTAMP, ROW_ID) <= count(*) OVER () // 2 AS first_half FROM logins)",
            "c AS (SELECT CAST((TIMESTAMP - m) // " + str(SLICE_MS) + " AS INTEGER) AS _slice, first_half, "
            f"CAST(((TIMESTAMP - m + i * {S1}) // {W6}) * 6 + i AS BIGINT) AS TS_PART, USER_ID, isBot, "
            + ", ".join(f"count(*) FILTER (WHERE LOGIN_CREDENTIAL_TYPE = '{t}') AS {t}" for t in si.EVENT_TYPES)
            + " FROM h, mn, range(0, 6) t(i) GROUP BY 1, 2, 3, 4, 5)")


def _sliced(spark, d):
    """Logins fed as files, as many at a time as there are cores; the first half of time marked; the 12 h slices' window counts."""
    lg = si.logins(spark, d)
    n = lg.count()
    marked = lg.withColumn("first_half", first_rows(lg, ["TIMESTAMP", "ROW_ID"], [n // 2], n)[0]).drop("ROW_ID")
    ts_min = lg.agg(F.min("TIMESTAMP")).first()[0]
    return st.run_slices(spark, _feed(marked, "login-slices"), marked.schema, fs.fresh(spark, "slice-features"), ts_min, SLICE_MS,
                         W6, S1, si.EVENT_TYPES, part="first_half", max_files=spark.sparkContext.defaultParallelism)


@register("q_t5_slice_features", _T5 + "SELECT * FROM c")
def q_t5(spark, d):
    return _sliced(spark, d)


def _slots(features):
    slots, values = sgd.count_slots(si.EVENT_TYPES)
    return features.select("*", F.col("isBot").cast("double").alias("label"), slots.alias("slots"), values.alias("values"))


def _learned_slices(spark, d, fresh):
    """The folder of states of a hinge learner that takes the first half of time slice by slice, as files arrive, and
    the number of its batches."""
    def make():
        lg = si.logins(spark, d)
        n, ts_min = lg.agg(F.count(F.lit(1)), F.min("TIMESTAMP")).first()
        first = lg.where(first_rows(lg, ["TIMESTAMP", "ROW_ID"], [n // 2], n)[0]).drop("ROW_ID")
        source = fs.write_by_slice(first, fs.fresh(spark, "training-slices"), "TIMESTAMP", ts_min, SLICE_MS)
        folder, learner = fs.fresh(spark, "slice-learner"), sgd.Learner(len(si.EVENT_TYPES), sgd.HINGE, eta=10.0, steps=1)
        # A slice is one batch, however many files hold it; slices in their order, not in that in which tasks end.
        slices = sorted(fs.slice_folders(spark, source), key=lambda s: (s is not None, s))
        for i, at in enumerate(slices):
            stream = spark.readStream.schema(first.schema).parquet(fs.slice_folder(source, at))
            sgd.learn_stream(stream, learner, folder, lambda batch: _slots(st.slice_counts(batch, ts_min, SLICE_MS, W6, S1, si.EVENT_TYPES)), before=i)
        return folder, len(slices)
    return made(spark, d, "slice-learner", make, fresh)


@scored_rows("q_t5_train_by_slices", "q_t5_keys", _T5 + "SELECT _slice, TS_PART, USER_ID, isBot, TRUE AS scored FROM c WHERE NOT first_half",
             ["_slice", "TS_PART", "USER_ID", "isBot"])
def q_t5t(spark, d):
    """Trained on the first half of time, slice by slice from the weights before; every row of the second half's slices is scored."""
    folder, n = _learned_slices(spark, d, fresh=True)
    scored = sgd.scored(_slots(_sliced(spark, d).where("not first_half")), sgd.read_state(spark, folder, n - 1))
    return scored.select("_slice", "TS_PART", "USER_ID", "isBot", "prediction", "score",
                         (F.col("prediction") == (F.col("score") > 0).cast("double")).alias("scored"))


@register("q_t5_slice_curve")
def q_t5c(spark, d):
    """F1 on the second half's slices after each slice that was learned."""
    return sgd.curve(_slots(_sliced(spark, d).where("not first_half")), _learned_slices(spark, d, fresh=False)[0])
