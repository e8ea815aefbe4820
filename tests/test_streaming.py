"""Stream = batch and stratified folds."""

from pyspark.sql import functions as F

from tests.conftest import SF, SMOKE
from trafficlens.operators.windows import type_counts
from trafficlens.sources import standins as si
from trafficlens.sources.files import fresh
from trafficlens.streaming import streams as st

W6, S1 = 6 * 3600 * 1000, 3600 * 1000


def window_counts(lg):
    w = F.window(F.timestamp_millis(F.col("TIMESTAMP")), f"{W6} milliseconds", f"{S1} milliseconds")
    return lg.groupBy(w.alias("w"), "USER_ID", "isBot").agg(*type_counts(si.EVENT_TYPES, "LOGIN_CREDENTIAL_TYPE")) \
        .select(F.unix_millis(F.col("w.start")).alias("window_start"), "USER_ID", "isBot", *si.EVENT_TYPES)


def test_sliding_stream_equals_batch(spark):
    import __spark_entry__ as ent
    stream = ent.queries()["q_t4_sliding_login_stream"](spark, SF)
    batch = window_counts(si.logins(spark, SF))
    assert stream.count() == batch.count()
    assert stream.exceptAll(batch).count() == 0


def test_several_triggers_resume_and_keep_their_watermark(spark):
    """Files in time order, one a trigger, in two runs of the same folder: the second goes on where the first ended."""
    lg = si.logins(spark, SMOKE).drop("ROW_ID")
    source, run = fresh(spark, "ordered"), fresh(spark, "run")
    lo, hi = lg.agg(F.min("TIMESTAMP"), F.max("TIMESTAMP")).first()
    cut = lambda i: lo + (hi + 1 - lo) * i // 4
    log = None
    for i in range(4):
        lg.where((F.col("TIMESTAMP") >= cut(i)) & (F.col("TIMESTAMP") < cut(i + 1))).coalesce(1).write.mode("append").parquet(source)
        if i % 2:
            stream = spark.readStream.schema(lg.schema).option("maxFilesPerTrigger", 1).parquet(source)
            log = st.run_upsert_log(st.sliding_login_stream(stream, W6, S1, si.EVENT_TYPES), run)
    got = st.latest_per_key(spark, log, ["window_start", "USER_ID", "isBot"])
    want = window_counts(lg)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert st.read_batches(spark, log).select("_batch").distinct().count() >= 4


def test_a_slice_over_several_files_and_a_retried_batch(spark):
    """T5: slices cut over files and batches add up, and a batch that is tried again counts once."""
    lg = si.logins(spark, SMOKE).drop("ROW_ID")
    source, run, slice_ms = fresh(spark, "slices"), fresh(spark, "slice-run"), 43_200_000
    lg.repartition(5).write.parquet(source)
    ts_min = lg.agg(F.min("TIMESTAMP")).first()[0]
    whole = st.slice_counts(lg, ts_min, slice_ms, W6, S1, si.EVENT_TYPES)
    args = (lg.schema, run, ts_min, slice_ms, W6, S1, si.EVENT_TYPES)
    got = st.run_slices(spark, source, *args)
    assert got.exceptAll(whole.select(*got.columns)).count() == 0 and got.count() == whole.count()
    # A second try of the last batch, as after a failure before its commit.
    import glob
    import os
    commits = run.removeprefix("file:") + "/checkpoint/commits"
    last = max(int(os.path.basename(p)) for p in glob.glob(commits + "/[0-9]*"))
    for p in glob.glob(f"{commits}/{last}") + glob.glob(f"{commits}/.{last}.crc"):
        os.remove(p)
    again = st.run_slices(spark, source, *args)
    assert again.exceptAll(whole.select(*again.columns)).count() == 0 and again.count() == whole.count()


def test_ui_stream_equals_batch(spark):
    import __spark_entry__ as ent
    q = ent.queries()
    a, b = q["q_t1_ui_event_stream"](spark, SF), q["q_s12_ui_log_parse"](spark, SF)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stratified_folds_balanced(spark):
    from trafficlens.plans.tuning import stratified_folds
    lg = si.logins(spark, SF).select("ROW_ID", F.col("isBot").cast("double").alias("label"))
    f = stratified_folds(lg, "label", ["ROW_ID"], 5)
    per = f.groupBy("label", "fold").count().collect()
    by_label = {}
    for r in per:
        by_label.setdefault(r["label"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 and len(v) == 5 for v in by_label.values())
    assert f.count() == lg.count()


def test_online_scoring_fills_missing_fields(spark):
    """Requests missing some of the 23 fields are scored (missing = '')."""
    from pyspark.sql.types import StringType, StructField, StructType

    from trafficlens.plans.headers import HEADER_FIELDS, fit_headers_model, training_rows
    http = si.http(spark, SMOKE)
    model = fit_headers_model(http, max_iter=5)
    rows = training_rows(http)
    folder = fresh(spark, "test-requests")
    keep = HEADER_FIELDS[::2]  # every other field missing from the requests
    rows.select(F.col("ROW_ID").cast("string").alias("ROW_ID"), *keep).write.json(folder)
    fields = ["ROW_ID", *HEADER_FIELDS]
    schema = StructType([StructField(c, StringType()) for c in ["ROW_ID", *keep]])
    out = spark.read.parquet(st.run_append(
        st.score_requests(spark, folder, schema, model, fields).select("ROW_ID", "predict_proba"), fresh(spark, "test-scored")))
    assert out.count() == rows.count() == http.count()
    assert out.where((F.col("predict_proba") < 0) | (F.col("predict_proba") > 1)
                     | F.col("predict_proba").isNull()).count() == 0


def _events(spark, rows, folder):
    ev = spark.createDataFrame(rows, "event_id long, ms long, user_id long, event_type string")
    ev.select("event_id", F.expr("CAST(timestamp_millis(ms) AS TIMESTAMP_NTZ)").alias("ts"), "user_id", "event_type").write.parquet(f"{folder}/events.parquet")
    return folder


def test_a_slice_in_several_files_is_one_batch(spark, tmp_path):
    """Four slices in the first half of time, each cut into files: a state a slice, and the files' rows are all learned."""
    from trafficlens.queries import q_streaming as qs
    d = _events(spark, [(i, 1_704_067_200_000 + i * 432_000, i % 23, "error" if i % 3 else "view") for i in range(800)], str(tmp_path))
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder, n = qs._learned_slices(spark, d, fresh=True)
        assert n == 4 and [r.done for r in qs.sgd.states(spark, folder).orderBy("batch").collect()] == [1, 2, 3, 4]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_folds_are_ranks_by_hash_and_write_nothing(spark):
    import os

    from trafficlens import session as se
    from trafficlens.operators.rows import hash_fraction
    from trafficlens.plans.tuning import stratified_folds
    rows = spark.createDataFrame([(i // 2, i % 2, float(i % 3 == 0)) for i in range(500)], "a long, b long, label double")
    se.stored(rows.limit(1), "any")
    before = sorted(os.listdir(se._scratch_root(spark).removeprefix("file:")))
    found = stratified_folds(rows, "label", ["a", "b"], 4).withColumn("h", hash_fraction(["a", "b"], 17)).collect()
    assert sorted(os.listdir(se._scratch_root(spark).removeprefix("file:"))) == before and len(found) == 500
    for y in (0.0, 1.0):
        ranked = sorted((r for r in found if r.label == y), key=lambda r: (r.h, r.a, r.b))
        assert [r.fold for r in ranked] == [i % 4 for i in range(len(ranked))]
