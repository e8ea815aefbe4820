"""Properties and edge cases."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, SMOKE
from trafficlens.functions.ip import int_to_ip, ip_to_int
from trafficlens.functions.timebuckets import bucket_columns, half_day_bounds, ts_group
from trafficlens.operators import aggregates as ag
from trafficlens.operators import evaluate as ev
from trafficlens.operators.ordering import ordered_split
from trafficlens.operators.windows import sliding_counts
from trafficlens.sources import standins as si

W6, S1 = 6 * 3600 * 1000, 3600 * 1000


def test_entry_smoke(spark):
    import __spark_entry__ as ent
    df = ent.entry(spark)
    assert df.columns[:3] == ["TS_PART", "USER_ID", "isBot"]
    assert df.count() > 0


def test_panes_equal_the_direct_form(spark):
    """Counting by pane first gives what numbering every raw row's windows gives, also for odd window lengths."""
    lg = si.logins(spark, SF)
    mn = lg.agg(F.min("TIMESTAMP")).first()[0]
    for window, shift in ((W6, S1), (W6, 25 * 60_000), (7 * S1, 2 * S1), (S1, S1)):
        n = int(window / shift)
        direct = lg.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) \
            .withColumn("TS_PART", F.expr(f"((TIMESTAMP - {mn} + i * {shift}) div {window}) * {n} + i")) \
            .groupBy("TS_PART", "USER_ID", "isBot").agg(*[F.count_if(F.col("LOGIN_CREDENTIAL_TYPE") == t).alias(t) for t in si.EVENT_TYPES])
        panes = sliding_counts(lg, window, shift, si.EVENT_TYPES)
        assert direct.exceptAll(panes).count() == 0 and panes.exceptAll(direct).count() == 0


def test_row_normalise_sums_to_one(spark):
    lg = si.logins(spark, SF)
    mn, mx = lg.select(F.min("TIMESTAMP")).scalar(), lg.select(F.max("TIMESTAMP")).scalar()
    g = lg.withColumn("TS_GROUP", ts_group("TIMESTAMP", mn, mx, 4, 10))
    sh = ag.row_normalise(ag.bucket_counts(g, "USER_ID", "TS_GROUP"), "USER_ID")
    sums = [r[1] for r in sh.groupBy("USER_ID").agg(F.sum("share")).collect()]
    assert all(abs(s - 1.0) < 1e-9 for s in sums)


def test_ts_group_max_gives_extra_group(spark):
    df = spark.createDataFrame([(0,), (50,), (100,)], "t long")
    got = [r[0] for r in df.select(ts_group("t", 0, 100, 2, 5)).collect()]
    assert got == [0, 5, 10]


def test_class_report_supports_sum_to_n(spark):
    s = si.scores(spark, SF).withColumn("pred", (F.col("p") > 0.5).cast("int"))
    rep = {r["class"]: r for r in ev.class_report(s, "y", "pred").collect()}
    assert rep["0"]["support"] + rep["1"]["support"] == s.count() == rep["weighted avg"]["support"]


def test_f1_empty_class_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, pred int")
    assert ev.f1_positive(df, "y", "pred").first()[0] == 0.0


def test_auc_matches_brute_force(spark):
    rows = [(float(x % 7) / 7, int(x % 3 == 0)) for x in range(300)]
    df = spark.createDataFrame(rows, "p double, y int")
    auc = ev.roc_auc(df, "y", "p").first()[0]
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y == 0]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(auc - want) < 1e-12


def test_ordered_split_disjoint_and_complete(spark):
    lg = si.logins(spark, SF).select("ROW_ID", "TIMESTAMP")
    sp = ordered_split(lg, 0.7, ["TIMESTAMP", "ROW_ID"])
    n = lg.count()
    assert sp.count() == n
    assert sp.where("split = 'train'").count() == int(n * 0.7)
    first_test = sp.where("split = 'test'").agg(F.min(F.struct("TIMESTAMP", "ROW_ID"))).first()[0]
    last_train = sp.where("split = 'train'").agg(F.max(F.struct("TIMESTAMP", "ROW_ID"))).first()[0]
    assert tuple(last_train) < tuple(first_test)


def test_ip_round_trip(spark):
    a = si.auth(spark, SF).select("IP").distinct()
    back = a.select("IP", ip_to_int(int_to_ip("IP")).alias("b"))
    assert back.where(F.col("IP") != F.col("b")).count() == 0


def test_ip_strict_raises(spark):
    df = spark.createDataFrame([("1.2.3",)], "t string")
    with pytest.raises(Exception):
        df.select(ip_to_int("t", strict=True)).collect()


def test_bucket_bound_is_in_no_bucket(spark):
    b = half_day_bounds(si.AUTH_WEEK_START)
    bound = b[1][0]
    df = spark.createDataFrame([(bound,)], "TIMESTAMP long")
    assert all(v is None for v in df.select(*bucket_columns("TIMESTAMP", b)).first())


def test_null_keys_drop_out_of_windows(spark):
    df = spark.createDataFrame([(1, 0, 0, "A"), (None, 1, 0, "A"), (2, 2, 0, None)],
                               "USER_ID long, TIMESTAMP long, isBot int, LOGIN_CREDENTIAL_TYPE string")
    out = sliding_counts(df, 10, 10, ["A"]).collect()
    assert [(r["USER_ID"], r["A"]) for r in out] == [(1, 1)]


def test_unseen_category_all_zero(spark):
    from trafficlens.operators.encode import one_hot_fit, to_array
    fit = spark.createDataFrame([("a",), ("b",)], "c string")
    model = one_hot_fit(fit, ["c"])
    got = model.transform(spark.createDataFrame([("a",), ("z",)], "c string")).select(to_array("c_vec")).collect()
    assert list(got[0][0]) == [1.0, 0.0] and list(got[1][0]) == [0.0, 0.0]


def test_label_encoder_unknown_golden(spark):
    """Fit on two names; an unseen name maps to the 'unknown' class."""
    from trafficlens.operators.encode import codes_with_unknown, encode_unknown
    fit = spark.createDataFrame([("user_1", "Igor Nikolaev"), ("user_2", "Lil Pump")], "id string, name string")
    codes = codes_with_unknown(fit, "name")
    test = spark.createDataFrame([("Igor Nikolaev",), ("Poshlaya Molly",)], "name string")
    out = {r["name"]: r["code"] for r in encode_unknown(test, "name", codes).collect()}
    unk = codes.where("name = 'unknown'").first()["code"]
    assert out["Poshlaya Molly"] == unk and out["Igor Nikolaev"] != unk


def test_quantile_vote_single_class_fits(spark):
    from trafficlens.plans.quantile_vote import QuantileVoteClassifier
    lg = si.logins(spark, SMOKE).where("isBot = 0")
    m = QuantileVoteClassifier(parts=2, shortParts=3).fit(lg)
    assert m.transform(lg).count() == lg.select("USER_ID").distinct().count()


def test_rows_to_df(spark):
    from trafficlens.sources.files import rows_to_df
    df = rows_to_df(spark, [(0, "a b c d e spark", 1.0), (1, "b d", 0.0)], "id long, text string, label double")
    assert df.count() == 2 and df.schema["label"].dataType.simpleString() == "double"


def test_word_vectors_match_count_vectorizer(spark):
    """The sparse vectors hold what CountVectorizer counts, token by token."""
    from pyspark.ml.feature import CountVectorizer, RegexTokenizer
    from trafficlens.operators.encode import sparse, word_tokens, word_vectors
    from trafficlens.sources.tables import read
    docs = read(spark, SMOKE, "documents", ["doc_id", "text"])
    words = RegexTokenizer(inputCol="text", outputCol="w", pattern=r"(?U)\b\w\w+\b", gaps=False, toLowercase=True).transform(docs)
    cv = CountVectorizer(inputCol="w", outputCol="v", vocabSize=1 << 20).fit(words)
    want = cv.transform(words).select("doc_id", sparse("v").alias("v")).select(
        "doc_id", F.aggregate("v.values", F.lit(0.0), lambda a, x: a + x).cast("long").alias("n"), F.size("v.indices").alias("k"))
    got = word_vectors(docs, "text", "doc_id")
    assert got.first()["size"] == len(cv.vocabulary) == word_tokens(docs, "text", "doc_id").select("token").distinct().count()
    sums = got.select("doc_id", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.size("indices").alias("k"))
    assert sums.exceptAll(want).count() == 0 and want.exceptAll(sums).count() == 0


def test_vocabulary_has_no_limit(spark):
    """More distinct values than 2 ** 18: every one has its slot."""
    from trafficlens.operators.encode import prefixed_one_hot, word_vectors
    n = 300_000
    rows = spark.range(n).selectExpr("id div 1000 AS doc", "concat('w', id) AS w")
    docs = rows.groupBy("doc").agg(F.concat_ws(" ", F.collect_list("w")).alias("text"))
    got = word_vectors(docs, "text", "doc")
    assert got.agg(F.max("size"), F.sum(F.size("indices")), F.count_distinct("doc")).first() == (n, n, n // 1000)
    hot = prefixed_one_hot(spark.range(n).selectExpr("id", "concat('v', id) AS v"), "id", ["v"])
    assert hot.agg(F.max("size"), F.sum(F.size("indices")), F.count_distinct(F.col("indices")[0])).first() == (n, n, n)


def test_auc_with_many_distinct_scores_agrees_with_the_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    df = spark.range(1_000_000).selectExpr("pmod(xxhash64(id), 100000007) / 100000007.0D AS p", "cast(pmod(xxhash64(id, 1), 10) < 1 + 2 * (id % 2) AS double) AS y")
    df = df.withColumn("p", F.col("p") + F.col("y") * 0.05)
    want = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(df)
    got = [ev.roc_auc(df, "y", "p").first()[0] for _ in range(3)]
    assert len(set(got)) == 1 and abs(got[0] - want) < 1e-9


def test_head_without_the_last_rows(spark):
    from trafficlens.operators.rows import take_head
    lg = si.logins(spark, SF).select("ROW_ID", "TIMESTAMP")
    n = lg.count()
    order = ["TIMESTAMP", "ROW_ID"]
    rest = take_head(lg, -7, order)
    last = [tuple(r) for r in lg.orderBy(F.desc("TIMESTAMP"), F.desc("ROW_ID")).limit(7).select(*order).collect()]
    assert rest.count() == n - 7 and not set(last) & {tuple(r) for r in rest.select(*order).collect()}


def test_split_with_ties_nulls_and_hot_values(spark, monkeypatch):
    """The cut by keys alone is the cut by position, also where most rows share a key."""
    from trafficlens.operators import ordering
    monkeypatch.setattr(ordering, "LISTED_ROWS", 5)
    df = spark.range(2000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 3 = 0 THEN 7 ELSE cast(id * 37 % 500 AS double) END AS t")
    rows = sorted(((r.t is not None, r.t or 0, r.id) for r in df.collect()))
    for frac in (0.0, 0.05, 0.1, 0.35, 0.5, 0.999, 1.0):
        got = {r.id for r in ordering.ordered_split(df, frac, ["t", "id"]).where("split = 'train'").collect()}
        assert got == {i for _, _, i in rows[:int(2000 * frac)]}
    for listed in (5, 50, 10_000):
        monkeypatch.setattr(ordering, "LISTED_ROWS", listed)
        ks = [0, 1, 150, 200, 201, 700, 1100, 1998, 1999]
        keys = ordering.keys_at(df, ["t", "id"], ks, 2000)
        assert [(k[0] is not None, k[0] or 0, k[1]) for k in keys] == [rows[k] for k in ks]


def test_slot_names_cover_the_vector(spark):
    from trafficlens.operators.encode import one_hot_fit, slot_names, to_array
    h = si.http(spark, SMOKE).select("operation", "method", "requestType")
    cols = h.columns
    v = one_hot_fit(h, cols).transform(h)
    names = {r.slot: (r.column, r.value) for r in slot_names(v, cols).collect()}
    for r in v.select(*cols, to_array("features").alias("a")).distinct().collect():
        assert len(r.a) == len(names)
        assert {names[i] for i, x in enumerate(r.a) if x} == {(c, r[c]) for c in cols}


def test_summary_keeps_a_column_of_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", None)], "x string, y string")
    got = {r["column"]: tuple(r)[1:] for r in ag.text_summary(df, ["x", "y"]).collect()}
    assert got == {"x": (3, 2, "a", 2), "y": (0, 0, None, None)}


def test_ui_log_keeps_fractions_and_flat_records(spark):
    from trafficlens.sources.uilog import corrupt_lines, parse_lines
    lines = ['INFO [2024-01-01 00:00:00,001] {"stat_type": "click", "mouse_position_x": 10.5, "element_oktarget": "t", "client_timestamp": 1234.56}',
             'INFO [2024-01-01 00:00:00,002] {"stat_type": "mouse_move", "window_width": 800, "mouse_position_y": 3.25}', "INFO [x] nope", "no line"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r.stat_type: r for r in parse_lines(df).collect()}
    assert got["click"].mouse_position_x == 10.5 and got["click"].client_timestamp == 1234.56 and got["click"].element_oktarget == "t"
    assert got["mouse_move"].window_width == 800 and got["mouse_move"].mouse_position_y == 3.25 and got["click"].asctime == "2024-01-01 00:00:00,001"
    assert sorted(r.line for r in corrupt_lines(df).collect()) == sorted(lines[2:])


def test_a_skewed_agent_joins_whole(spark):
    """P21/J1 with one agent on nearly every row."""
    from trafficlens.functions.useragent import enrich
    df = spark.range(20_000).selectExpr("id", "CASE WHEN id % 50 = 0 THEN concat('curl/', id % 7) ELSE 'Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0' END AS userAgent")
    out = enrich(df, "userAgent", 22)
    assert out.count() == 20_000 and out.where("AgentName = 'Firefox'").count() == 19_600


def test_first_browser_with_a_hot_user(spark):
    """O3 where nine rows of ten are of the user 'null'."""
    from trafficlens.operators.ordering import keep_first_browser
    df = spark.range(30_000).selectExpr("id AS ROW_ID", "CASE WHEN id % 10 > 0 THEN 'null' ELSE concat('u', id % 50) END AS userId", "id % 7 AS browserId")
    got = keep_first_browser(df, "userId", "browserId", "ROW_ID")
    first = {}
    rows = [tuple(r) for r in df.orderBy("ROW_ID").collect()]
    want = [r for r in rows if first.setdefault(r[1], r[2]) == r[2]]
    assert sorted((r.ROW_ID, r.userId, r.browserId) for r in got.collect()) == sorted(want)


def test_quantile_vote_save_load_and_search(spark, tmp_path):
    from trafficlens.operators.rows import hash_fraction
    from trafficlens.plans.quantile_vote import QuantileVoteClassifier, QuantileVoteModel, grid_scores, search_grid
    from trafficlens.sources.files import fresh
    lg = si.logins(spark, SMOKE)
    m = QuantileVoteClassifier(parts=3, shortParts=2, quantile=0.3).fit(lg)
    back = QuantileVoteModel.load(m.save(fresh(spark, "qv")))
    assert sorted(map(tuple, back.transform(lg).collect())) == sorted(map(tuple, m.transform(lg).collect()))
    # The one-plan grid gives what fitting and scoring fold by fold gives.
    fold = F.floor(hash_fraction(["ROW_ID"], 17) * 2).cast("int")
    grid = {"parts": [1, 3], "short_parts": [1, 4], "quantiles": [0.2, 0.5]}
    got = {(r.parts, r.short_parts, r["quantile"]): r.f1 for r in grid_scores(lg, fold, 2, **grid).collect()}
    for (p, s, q), f1 in got.items():
        one = [QuantileVoteClassifier(parts=p, shortParts=s, quantile=q).fit(lg.where(fold != i)).score(lg.where(fold == i)).first()[0] for i in range(2)]
        assert abs(f1 - sum(one) / 2) < 1e-9
    best, model, holdout = search_grid(lg, lg, fold, 2, **grid)
    assert abs(best["f1"] - max(got.values())) < 1e-12 and model.getOrDefault("parts") == best["parts"] and 0 <= holdout.first()[0] <= 1


def test_bucket_logit_save_load_and_search(spark):
    from trafficlens.plans.bucket_logit import BucketLogit, BucketLogitModel, search_grid
    from trafficlens.sources.files import fresh
    lg = si.logins(spark, SMOKE)
    m = BucketLogit(parts=2, shortParts=3, credentialTypes=["click", "view"], shares=True, maxIter=5).fit(lg)
    back = BucketLogitModel.load(m.save(fresh(spark, "bl")))
    key = lambda df: sorted((r.USER_ID, r.prediction, r.features.size) for r in df.collect())
    assert key(back.transform(lg)) == key(m.transform(lg)) and key(m.transform(lg))[0][2] == 7
    scored, best = search_grid(lg, lg, [1, 2], [3], [[], ["click"]], maxIter=5)
    assert len(scored) == 4 and best.score(lg).first()[0] == max(f for _, f in scored)


def test_random_maps_differ(spark):
    from trafficlens.plans import models as md, tuning as tn
    svm = md.linear_svm()
    maps = tn.random_maps(svm, {"regParam": [1e-4, 1e-3], "maxIter": [5, 10, 20]}, draws=6)
    assert len({tuple(sorted((p.name, v) for p, v in m.items())) for m in maps}) == 6
    with pytest.raises(ValueError):
        tn.random_maps(svm, {"maxIter": [5]}, draws=2)


def test_unset_checkpoint_folder_is_an_error_on_a_cluster():
    from trafficlens.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_single_class_input_fits(spark):
    """M7 edge case: a training set holding users only still fits and scores."""
    from trafficlens.operators.encode import one_hot_stages
    from trafficlens.plans.models import fit_materialised, logistic, p_bot
    from trafficlens.operators.encode import assemble
    h = si.http(spark, SMOKE).where("isBot = 0").select("operation", "method", F.col("isBot").cast("double").alias("label"))
    stages = one_hot_stages(["operation", "method"]) + [assemble(["operation_vec", "method_vec"]), logistic(max_iter=5)]
    scored = p_bot(fit_materialised(stages, h).transform(h))
    assert scored.where(F.col("predict_proba") > 0.5).count() == 0


def test_scratch_tables_are_released():
    """A job's written tables go at its end, and only its own."""
    import os
    import subprocess
    import sys
    code = """
import os, sys
from trafficlens.session import get_session, release_scratch, scratch_path
s = get_session("local[1]", shuffle_partitions=1, extra={"spark.checkpoint.dir": sys.argv[1]})
path = scratch_path(s, "t")
s.range(3).write.parquet(path)
other = os.path.join(os.path.dirname(os.path.dirname(path)), "another-application")
os.makedirs(other.removeprefix("file:"))
assert s.read.parquet(path).count() == 3 and release_scratch(s)
assert not os.path.exists(path.removeprefix("file:")) and os.path.exists(other.removeprefix("file:"))
"""
    import tempfile
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code, tempfile.mkdtemp()], check=True, cwd=root, env={**os.environ, "PYTHONPATH": root}, timeout=120)
