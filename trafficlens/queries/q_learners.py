"""Learned models, tuning and model flows.

A learner's query gives what it finds (classes, probabilities, scores,
importances) and has no twin; beside it a query named ``..._keys`` reads the
result of that same fit and has one: every row of the holdout is scored, and the
score holds together (``models.checked_score``).  Searches and curves give
their table; what is deterministic in them (fold sizes, which maps are tried,
the rule that picks the best) has a twin too.
"""

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from trafficlens.functions.scalars import hash_bucket, none_text
from trafficlens.functions.timebuckets import half_day_bounds
from trafficlens.operators import encode as en
from trafficlens.operators.aggregates import activity_counts, user_rollup
from trafficlens.operators.evaluate import class_report, f1_positive
from trafficlens.operators.windows import sliding_counts
from trafficlens.plans import bucket_grid as bg
from trafficlens.plans import depths as dp
from trafficlens.plans import forests as fo
from trafficlens.plans import linear_curves as lc
from trafficlens.plans import models as md
from trafficlens.plans import sgd
from trafficlens.plans import tuning as tn
from trafficlens.plans.bucket_logit import BucketLogit
from trafficlens.session import stored
from trafficlens.sources import files as fs
from trafficlens.sources import standins as si
from trafficlens.sources.tables import read
from trafficlens.sqltwins import AUTH, HTTP, LOGINS, TEXT, with_

from . import register
from .results import made, scored_rows, write_result, written_by

W6, S1 = 6 * 3600 * 1000, 3600 * 1000
ACT_COLS = ["COUNT_ACT_WEEK"] + [f"COUNT_ACT_{i}" for i in range(1, 7)]


def _part_sql(key, share):
    """M11's split of a key (text) in SQL."""
    return (f"CASE WHEN CAST(('0x' || substring(md5('17|' || {key}), 1, 8)) AS BIGINT) / 4294967296.0 < {1.0 - share} "
            "THEN 'train' ELSE 'test' END")


_WINDOWS = with_(LOGINS, "mn AS (SELECT min(TIMESTAMP) AS m FROM logins)",
                 f"w AS (SELECT CAST(((TIMESTAMP - m + i * {S1}) // {W6}) * 6 + i AS BIGINT) AS TS_PART, USER_ID, "
                 "CAST(isBot AS DOUBLE) AS label FROM logins, mn, range(0, 6) t(i) GROUP BY 1, 2, 3)")
_WINDOW_KEY = "CAST(TS_PART AS VARCHAR) || '|' || CAST(USER_ID AS VARCHAR)"
_WINDOW_TEST = _WINDOWS + f"SELECT TS_PART, USER_ID, label, TRUE AS scored FROM w WHERE {_part_sql(_WINDOW_KEY, 0.3)} = 'test'"
_HTTP_TEST = with_(HTTP) + f"SELECT ROW_ID, CAST(isBot AS DOUBLE) AS label, TRUE AS scored FROM http WHERE {_part_sql('CAST(ROW_ID AS VARCHAR)', 0.3)} = 'test'"


def _windows(spark, d):
    """A6 counts per (window, user), label = isBot (the 3.4 flow): written once as a compressed table, which learners and folds read."""
    wc = sliding_counts(si.logins(spark, d), W6, S1, si.EVENT_TYPES)
    return stored(wc.withColumn("label", F.col("isBot").cast("double")), "login-windows")


def login_window_features(spark, d):
    """The login windows with their counts as a vector."""
    return en.assemble(si.EVENT_TYPES).transform(_windows(spark, d))


def http_features(spark, d):
    """Hash + one-hot features of the http stand-in (the 3.3 flow)."""
    h = si.http(spark, d).select("ROW_ID", "userId", "operation", "method", "requestType",
                                 hash_bucket(none_text("userAgent"), 100).cast("string").alias("ua_bucket"),
                                 F.col("isBot").cast("double").alias("label"))
    return h


HTTP_CATS = ["operation", "method", "requestType", "ua_bucket"]


@scored_rows("q_m1_decision_tree", "q_m1_keys", with_(AUTH, "a AS (SELECT IP, arg_min(BOT_OR_HUMAN, TIMESTAMP) AS label FROM auth GROUP BY IP)") +
             f"SELECT IP, label, TRUE AS known_label FROM a WHERE {_part_sql('CAST(IP AS VARCHAR)', 0.3)} = 'test'", ["IP", "label"], "known_label")
def q_m1(spark, d):
    """Class and probability of the second label (of the rarer class) for each holdout address."""
    a = activity_counts(si.auth(spark, d), half_day_bounds(si.AUTH_WEEK_START))
    a = md.hash_split(en.assemble(ACT_COLS).transform(a), ["IP"], 0.3)
    train, test = a.where("part = 'train'"), a.where("part = 'test'")
    lab = en.label_index("label", "indexedLabel").fit(train)
    # A category that the training part lacks is one of its own.
    vi = VectorIndexer(inputCol="features", outputCol="indexedFeatures", maxCategories=4, handleInvalid="keep")
    tree = md.decision_tree("indexedLabel", "indexedFeatures", depth=5)
    back = en.label_back(lab, "prediction", "predictedLabel")
    model = Pipeline(stages=[lab.setHandleInvalid("keep"), vi, tree, back]).fit(train)
    return md.p_bot(model.transform(test)).select("IP", "label", "predictedLabel", "predict_proba",
                                                  F.col("predictedLabel").isin(*lab.labels).alias("known_label"))


@register("q_m18_tree_nodes")
def q_m18(spark, d):
    f = login_window_features(spark, d)
    return md.tree_nodes(md.decision_tree(depth=3, impurity="entropy").fit(f), si.EVENT_TYPES)


@register("q_m18_tree_counts", _WINDOWS + "SELECT count(*) AS root_rows, count(*) FILTER (label = 0) AS root_users, "
          "count(*) FILTER (label = 1) AS root_bots, 0 AS uneven_nodes FROM w")
def q_m18c(spark, d):
    """The tree's node table adds up: the root holds every row, an inner node what its two children hold."""
    t = q_m18(spark, d)
    rows = t.select(F.col("node").alias("child"), F.col("rows").alias("child_rows"))
    below = t.where("left is not null").select("node", "rows", F.explode(F.array("left", "right")).alias("child")).join(rows, "child")
    uneven = below.groupBy("node", "rows").agg(F.sum("child_rows").alias("below")).where("rows <> below")
    root = t.where("node = 0")
    return root.select(F.col("rows").alias("root_rows"), F.col("class_counts")[0].cast("long").alias("root_users"),
                       F.col("class_counts")[1].cast("long").alias("root_bots"), uneven.select(F.count(F.lit(1))).scalar().cast("int").alias("uneven_nodes"))


def _importances(spark, d):
    f = md.hash_split(_windows(spark, d), ["TS_PART", "USER_ID"], 0.3)
    forest = fo.fit(_copies(f.where("part = 'train'")), si.EVENT_TYPES, [-1], trees=100, depth=5)
    return spark.createDataFrame(list(zip(si.EVENT_TYPES, fo.importances(forest), strict=True)), "feature string, importance double")


@register("q_m2_forest_importances")
def q_m2(spark, d):
    return write_result(spark, d, "importances", _importances(spark, d))


@register("q_m2_forest_sum", "SELECT 5 AS features, TRUE AS sums_to_one")
def q_m2s(spark, d):
    """The importances that q_m2_forest_importances found add up."""
    return written_by(spark, d, "importances", _importances).agg(F.count("feature").cast("int").alias("features"),
                                                                 (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"))


@scored_rows("q_m4_linear_svm", "q_m4_keys", _WINDOW_TEST, ["TS_PART", "USER_ID", "label"])
def q_m4(spark, d):
    """Class and raw score of class 1 on the holdout."""
    f = md.hash_split(login_window_features(spark, d), ["TS_PART", "USER_ID"], 0.3)
    model = md.linear_svm(alpha=1e-4, max_iter=20).fit(f.where("part = 'train'"))
    return model.transform(f.where("part = 'test'")).select("TS_PART", "USER_ID", "label", "prediction", md.raw_score().alias("score"),
                                                            md.checked_score(probability=None).alias("scored"))


def _http_lr(spark, d, C=0.1):
    """(all rows, training part, holdout part, logistic model fitted on the training part)."""
    h = md.hash_split(http_features(spark, d), ["ROW_ID"], 0.3)
    train, test = h.where("part = 'train'"), h.where("part = 'test'")
    stages = en.one_hot_stages(HTTP_CATS) + [en.assemble([f"{c}_vec" for c in HTTP_CATS]),
                                              md.logistic(C=C, n=train.count(), max_iter=50)]
    return h, train, test, md.fit_materialised(stages, train)


@scored_rows("q_m5_logistic", "q_m5_logistic_checked", _HTTP_TEST, ["ROW_ID", "label"])
def q_m5(spark, d):
    _, _, test, model = _http_lr(spark, d)
    return md.p_bot(model.transform(test)).select("ROW_ID", "label", "prediction", "predict_proba", md.checked_score().alias("scored"))


@register("q_m5_validation_curve")
def q_m5v(spark, d):
    """Holdout F1 for C = 0.1 .. 0.9."""
    h = _copies(md.hash_split(_windows(spark, d), ["TS_PART", "USER_ID"], 0.3), "part")
    train, test = h.where("part = 'train'"), h.where("part = 'test'")
    n, ev = train.agg(F.sum("copies")).first()[0] or 0, tn.f1_evaluator(copies="copies")
    rows = [(c / 10, float(ev.evaluate(md.logistic(C=c / 10, n=n).setWeightCol("copies").fit(train).transform(test)))) for c in range(1, 10)]
    return spark.createDataFrame(rows, "C double, holdout_f1 double")


@scored_rows("q_m6_param_maps", "q_m6_keys", _WINDOW_TEST, ["TS_PART", "USER_ID", "label"])
def q_m6(spark, d):
    """Fitted under a parameter map that overrides the learner's own; class and probability on the holdout."""
    f = md.hash_split(login_window_features(spark, d), ["TS_PART", "USER_ID"], 0.3)
    lr = md.logistic(max_iter=10)
    lr.setMaxIter(20)
    params = {lr.maxIter: 30, lr.regParam: 0.01, lr.threshold: 0.45, lr.probabilityCol: "myProbability"}
    scored = lr.fit(f.where("part = 'train'"), params).transform(f.where("part = 'test'"))
    return md.p_bot(scored, "myProbability").select("TS_PART", "USER_ID", "label", "prediction", "predict_proba",
                                                    md.checked_score(probability="myProbability", threshold=0.45).alias("scored"))


@scored_rows("q_m7_distributed_fit", "q_m7_keys", _HTTP_TEST, ["ROW_ID", "label"])
def q_m7(spark, d):
    """All batches in one distributed fit; class and raw score on the holdout."""
    h = md.hash_split(http_features(spark, d), ["ROW_ID"], 0.3)
    stages = en.one_hot_stages(HTTP_CATS) + [en.assemble([f"{c}_vec" for c in HTTP_CATS]),
                                              md.linear_svm(alpha=1e-4, max_iter=30)]
    model = md.one_distributed_fit(stages, h.where("part = 'train'"))
    return model.transform(h.where("part = 'test'")).select("ROW_ID", "label", "prediction", md.raw_score().alias("score"),
                                                            md.checked_score(probability=None).alias("scored"))


BATCH_MS, SLOT_BUCKETS = 3 * 24 * 3600 * 1000, 100  # a batch is three days of requests


def _request_slots(spark, d):
    """Requests with time, label, part and the hashed one-hot slots of the four fields."""
    h = http_features(spark, d).join(si.http(spark, d).select("ROW_ID", "timestamp"), "ROW_ID")
    slots, values = sgd.one_hot_slots(HTTP_CATS, SLOT_BUCKETS)
    return md.hash_split(h.select("ROW_ID", "timestamp", "label", slots.alias("slots"), values.alias("values")), ["ROW_ID"], 0.3)


def _learned_requests(spark, d, fresh):
    """The folder of states of a log-loss learner that went through the training requests, batch by batch in order of time."""
    def make():
        rows = _request_slots(spark, d).where("part = 'train'")
        lo, hi = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
        layout = fs.write_by_slice(rows, fs.fresh(spark, "request-batches"), "timestamp", lo, BATCH_MS)
        batches = [fs.read_between(spark, layout, "timestamp", lo, BATCH_MS, at, at + BATCH_MS) for at in range(lo, hi + 1, BATCH_MS)]
        folder = fs.fresh(spark, "request-learner")
        return folder, sgd.learn_batches(batches, sgd.Learner(SLOT_BUCKETS * len(HTTP_CATS), sgd.LOG, eta=10.0), folder, spark)
    return made(spark, d, "request-learner", make, fresh)


@scored_rows("q_m7_batches", "q_m7_batches_keys", _HTTP_TEST, ["ROW_ID", "label"])
def q_m7b(spark, d):
    """Learned batch by batch, each from the weights that the last one left; class and margin on the holdout."""
    folder, n = _learned_requests(spark, d, fresh=True)
    test = _request_slots(spark, d).where("part = 'test'")
    return sgd.scored(test, sgd.read_state(spark, folder, n - 1)) \
        .select("ROW_ID", "label", "prediction", "score", (F.col("prediction") == (F.col("score") > 0).cast("double")).alias("scored"))


@register("q_m7_batch_curve")
def q_m7c(spark, d):
    """F1 on the holdout after each batch."""
    return sgd.curve(_request_slots(spark, d).where("part = 'test'"), _learned_requests(spark, d, fresh=False)[0])


_STEP_SLOTS = 3 * SLOT_BUCKETS
_STEP_WEIGHTS = [(i * i % 7 - 3) / 8 for i in range(_STEP_SLOTS)]
_STEP = sgd.Learner(_STEP_SLOTS, alpha=0.125, eta=0.5, steps=1)


def _slot_sql(i, column):
    return f"CAST(('0x' || substring(md5({column}), 1, 8)) AS BIGINT) % {SLOT_BUCKETS} + {i * SLOT_BUCKETS}"


@register("q_m7_update_step", with_(HTTP, "r AS (SELECT ROW_ID, isBot * 2 - 1 AS y, unnest([" + ", ".join(
    _slot_sql(i, c) for i, c in enumerate(("operation", "method", "requestType"))) + "]) AS slot FROM http)",
    "s AS (SELECT ROW_ID, y, sum((slot * slot % 7 - 3) / 8) + 0.25 AS margin FROM r GROUP BY 1, 2)",
    "g AS (SELECT slot, -sum(y) AS g FROM r JOIN s USING (ROW_ID, y) WHERE y * margin < 1 GROUP BY 1 "
    f"UNION ALL SELECT {_STEP_SLOTS}, -sum(y) FROM s WHERE y * margin < 1)",
    f"w AS (SELECT i AS slot, CASE WHEN i < {_STEP_SLOTS} THEN (i * i % 7 - 3) / 8 * (1 - 0.5 * 0.125) ELSE 0.25 END AS w FROM range(0, {_STEP_SLOTS + 1}) t(i))") +
    "SELECT CAST(slot AS INTEGER) AS slot, w - coalesce(g, 0) * 0.5 / (SELECT count(*) FROM http) AS weight FROM w LEFT JOIN g USING (slot)")
def q_m7u(spark, d):
    """One hinge step over all requests from weights that are given by slot (the bias is the last)."""
    slots, values = sgd.one_hot_slots(["operation", "method", "requestType"], SLOT_BUCKETS)
    rows = si.http(spark, d).select(slots.alias("slots"), values.alias("values"), F.col("isBot").cast("double").alias("label"))
    state = sgd.learn(rows, _STEP, sgd.State(_STEP_WEIGHTS, 0.25, 0))
    return spark.createDataFrame(list(enumerate([*state.weights, state.bias])), "slot int, weight double")


_ERROR_USERS = with_(LOGINS, "u AS (SELECT USER_ID, arg_min(isBot, ROW_ID) AS isBot FROM logins WHERE LOGIN_CREDENTIAL_TYPE = 'error' "
                     f"AND {_part_sql('CAST(USER_ID AS VARCHAR)', 0.33)} = 'test' GROUP BY 1)")


@scored_rows("q_m9_bucket_logit", "q_m9_keys", _ERROR_USERS + "SELECT USER_ID, isBot, TRUE AS scored FROM u", ["USER_ID", "isBot"])
def q_m9(spark, d):
    """Fitted on two thirds of the users by their errors over time; class and probability of every other user that has one."""
    lg = md.hash_split(si.logins(spark, d), ["USER_ID"], 0.33)
    lo, hi = lg.agg(F.min("TIMESTAMP"), F.max("TIMESTAMP")).first()
    # One shift before the first login, so that no login is in the bucket that is left out.
    model = BucketLogit(parts=4, shortParts=10, credentialTypes=["error"], minTs=float(lo) - (hi - lo) / 20, maxTs=float(hi) + 1) \
        .fit(lg.where("part = 'train'"))
    return md.p_bot(model.transform(lg.where("part = 'test'"))).select("USER_ID", "isBot", "prediction", "predict_proba",
                                                                       md.checked_score().alias("scored"))


_GRID_TYPES = [[], ["error"], ["click"], ["view"]]


def _grid(spark, d, fresh=False):
    """(scores of the full grid, class report of the best map): fitted on 60 % of the users, scored on 20 %, reported on 20 %."""
    def make():
        grid = bg.Grid(bg.GRID_PARTS, bg.GRID_SHORT_PARTS, _GRID_TYPES)
        lg = md.hash_split(md.hash_split(si.logins(spark, d), ["USER_ID"], 0.2), ["USER_ID"], 0.25, seed=5, col="inner")
        train, valid = (lg.where(f"part = 'train' AND inner = '{p}'") for p in ("train", "test"))
        scores, best = bg.search(train, valid, grid)
        scored = bg.refitted(best, train).transform(lg.where("part = 'test'"))
        return scores, class_report(scored.select(F.col("isBot").alias("y"), F.col("prediction").cast("int").alias("pred")), "y", "pred")
    return made(spark, d, "bucket-grid", make, fresh)


@register("q_m9_grid")
def q_m9g(spark, d):
    """F1 of all 352 maps, fitted together."""
    return _grid(spark, d, fresh=True)[0]


@register("q_m9_grid_report")
def q_m9gr(spark, d):
    """The best map refitted by itself: its class report on users that the search did not see."""
    return _grid(spark, d)[1]


@register("q_m9_grid_maps", "SELECT '{\"parts\": ' || p || ', \"shortParts\": ' || s || ', \"credentialTypes\": ' || t || '}' AS params, TRUE AS scored "
          f"FROM (SELECT unnest({bg.GRID_PARTS}) AS p) a, (SELECT unnest({bg.GRID_SHORT_PARTS}) AS s) b, "
          "(SELECT unnest(['[]', '[\"error\"]', '[\"click\"]', '[\"view\"]']) AS t) c")
def q_m9gm(spark, d):
    """Every map of the grid has a score."""
    return _grid(spark, d)[0].select("params", F.col("f1").between(0.0, 1.0).alias("scored"))


@scored_rows("q_m10_text_pipeline", "q_m10_keys", with_(TEXT) + "SELECT doc_id, label, TRUE AS scored FROM text "
             f"WHERE {_part_sql('CAST(doc_id AS VARCHAR)', 0.3)} = 'test'", ["doc_id", "label"])
def q_m10(spark, d):
    """Words -> hashed counts -> logistic regression, fitted on the training part; class and probability of the rest."""
    t = md.hash_split(si.text(spark, d), ["doc_id"], 0.3)
    stages = [en.tokenizers("text")[0], en.hashed_tf("words", 1000, "features"), md.logistic(max_iter=10)]
    model = Pipeline(stages=stages).fit(t.where("part = 'train'"))
    return md.p_bot(model.transform(t.where("part = 'test'"))).select("doc_id", "label", "prediction", F.col("predict_proba").alias("p_good"),
                                                                     md.checked_score().alias("scored"))


@register("q_m11_hash_split", "SELECT event_id, CASE WHEN CAST(('0x' || substring(md5('17|' || CAST(event_id AS VARCHAR)), "
          "1, 8)) AS BIGINT) / 4294967296.0 < 0.7 THEN 'train' ELSE 'test' END AS part FROM events")
def q_m11(spark, d):
    return md.hash_split(read(spark, d, "events", ["event_id"]), ["event_id"], 0.3)


DEPTHS = list(range(1, 20, 2))
# The ranges of the random search.
ALPHAS = [1e-15 * 10 ** i for i in range(15)]
ITERATIONS = [10 * (i + 1) for i in range(20)]


def _folded(spark, d, k=5):
    """Training part with folds, and the holdout part, of the login windows."""
    f = md.hash_split(_windows(spark, d), ["TS_PART", "USER_ID"], 0.3)
    train = tn.stratified_folds(f.where("part = 'train'").drop("isBot", "part"), "label", ["TS_PART", "USER_ID"], k)
    return train, f.where("part = 'test'")


def _copies(rows, *by):
    """How many ``copies`` each different row of counts, label and ``by`` has, with the counts as a vector: what a learner
    with weights fits on as on the rows themselves. Written once."""
    counted = rows.groupBy(*si.EVENT_TYPES, "label", *by).agg(F.count(F.lit(1)).cast("double").alias("copies"))
    return en.assemble(si.EVENT_TYPES).transform(stored(counted, "window-copies"))


def _folded_copies(spark, d):
    """``_folded`` with a row for all equal rows of a fold."""
    train, holdout = _folded(spark, d)
    return _copies(train, "fold"), _copies(holdout)


def _depths(spark, d, fresh=False):
    """(scores by depth, the deepest tree, the holdout part): one tree a fold and one of all training rows, for every depth."""
    def make():
        train, holdout = _folded(spark, d)
        return *dp.depth_scores(md.decision_tree(), DEPTHS, _copies(train, "fold"), _copies(holdout), copies="copies"), en.assemble(si.EVENT_TYPES).transform(holdout)
    return made(spark, d, "depths", make, fresh)


@register("q_m12_grid_search")
def q_m12(spark, d):
    return dp.search_results(_depths(spark, d, fresh=True)[0])


@register("q_m12_holdout_report")
def q_m12r(spark, d):
    """The best depth on the training part: its class report on the holdout."""
    scores, model, holdout = _depths(spark, d)
    best = max(scores.collect(), key=lambda r: (r.cv_f1, -r.depth)).depth
    scored = dp.classes_at(model, holdout, best).select(F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"))
    return class_report(scored, "y", "pred")


@register("q_m12_maps", "SELECT '{\"maxDepth\": ' || unnest(range(1, 20, 2)) || '}' AS params, TRUE AS scored, 1::BIGINT AS best_maps")
def q_m12m(spark, d):
    """Every depth is tried, has a score, and the marked one is the first of the best."""
    from pyspark.sql import Window
    rows, every = dp.search_results(_depths(spark, d)[0]), Window.partitionBy()  # as many rows as the grid has maps
    depth = F.get_json_object("params", "$.maxDepth").cast("int")
    top = F.max(F.struct("cv_metric", (-depth).alias("d"))).over(every)["d"]
    return rows.select("params", F.col("cv_metric").between(0.0, 1.0).alias("scored"),
                       F.sum(F.when(F.col("best") & (depth == -top), 1).otherwise(0)).over(every).alias("best_maps"))


@register("q_m12_stratified_folds", _WINDOWS + "SELECT CAST(rn % 5 AS INTEGER) AS fold, label, count(*) AS n FROM (SELECT label, "
          "row_number() OVER (PARTITION BY label ORDER BY USER_ID) - 1 AS rn FROM w) t GROUP BY 1, 2")
def q_m12f(spark, d):
    f = tn.stratified_folds(login_window_features(spark, d), "label", ["TS_PART", "USER_ID"], 5)
    return f.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


_SVM_SPACE = {"regParam": ALPHAS, "maxIter": ITERATIONS}


def _random_search(spark, d):
    train = _copies(_folded(spark, d)[0], "fold")
    slots, values = sgd.count_slots(si.EVENT_TYPES)
    rows = train.select(slots.alias("slots"), values.alias("values"), "label", "fold", "copies")
    return lc.map_scores(rows, len(si.EVENT_TYPES), tn.drawn(_SVM_SPACE, 10))


@register("q_m13_random_search")
def q_m13(spark, d):
    return write_result(spark, d, "random-search", _random_search(spark, d))


@register("q_m13_maps", "SELECT CAST(m.regParam AS DOUBLE) AS regParam, m.maxIter, TRUE AS scored, 1::BIGINT AS best_maps FROM (SELECT unnest([" +
          ", ".join(f"{{'regParam': {a!r}::DOUBLE, 'maxIter': {i}}}" for a, i in tn.drawn(_SVM_SPACE, 10)) + "]) AS m) t")
def q_m13m(spark, d):
    """The ten drawn maps have a score, and one of them, with the highest, is marked."""
    from pyspark.sql import Window
    every = Window.partitionBy()  # as many rows as maps are drawn
    rows = written_by(spark, d, "random-search", _random_search)
    top = F.col("best") & (F.col("cv_metric") == F.max("cv_metric").over(every))
    return rows.select(F.get_json_object("params", "$.regParam").cast("double").alias("regParam"), F.get_json_object("params", "$.maxIter").cast("int").alias("maxIter"),
                       F.col("cv_metric").between(0.0, 1.0).alias("scored"), F.sum(F.when(top, 1).otherwise(0)).over(every).alias("best_maps"))


def _fold_scores(spark, d):
    f = tn.stratified_folds(_windows(spark, d), "label", ["TS_PART", "USER_ID"], 5)
    return tn.fold_scores(md.decision_tree(depth=7, impurity="entropy"), _copies(f, "fold"), copies="copies")


@register("q_m14_cv_score")
def q_m14(spark, d):
    return write_result(spark, d, "fold-scores", _fold_scores(spark, d)).agg(F.avg("f1").alias("cv_f1"))


@register("q_m14_folds", _WINDOWS + "SELECT CAST(rn % 5 AS INTEGER) AS fold, count(*) AS rows, count(*) FILTER (label = 1) AS positives, TRUE AS scored "
          "FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY USER_ID) - 1 AS rn FROM w) t GROUP BY 1")
def q_m14f(spark, d):
    """Rows and bots of each fold, and that it has a score."""
    return written_by(spark, d, "fold-scores", _fold_scores).select("fold", "rows", "positives", F.col("f1").between(0.0, 1.0).alias("scored"))


@register("q_m15_validation_curve")
def q_m15(spark, d):
    return _depths(spark, d)[0].select(F.col("depth").cast("double").alias("param"), "cv_f1", "holdout_f1")


def _in_range(curve):
    """The curve's points, and whether both of their scores are scores."""
    return curve.select("param", (F.col("cv_f1").between(0.0, 1.0) & F.col("holdout_f1").between(0.0, 1.0)).alias("scored"))


def _forest_features(spark, d):
    train, test = _folded_copies(spark, d)
    rows = fo.features_curve(train, test, si.EVENT_TYPES, [str(n) for n in range(1, 6)], trees=100, depth=5)
    return spark.createDataFrame(rows, "param double, cv_f1 double, holdout_f1 double")


@register("q_m15_forest_features_curve")
def q_m15f(spark, d):
    """The number of features that a split of the forest looks at."""
    return write_result(spark, d, "forest-features", _forest_features(spark, d))


@register("q_m15_forest_features_range", "SELECT CAST(unnest(range(1, 6)) AS DOUBLE) AS param, TRUE AS scored")
def q_m15r(spark, d):
    return _in_range(written_by(spark, d, "forest-features", _forest_features))


def _slot_parts(spark, d):
    """Training part with folds, and the holdout, of the requests' hashed one-hot slots: one row with its ``copies`` for all equal ones."""
    rows = _request_slots(spark, d)
    train = tn.stratified_folds(rows.where("part = 'train'").select("ROW_ID", "slots", "values", "label"), "label", ["ROW_ID"], 5)
    held = lambda r, *by: stored(r.groupBy("slots", "values", "label", *by).agg(F.count(F.lit(1)).alias("copies")), "request-copies")
    return held(train, "fold"), held(rows.where("part = 'test'"))


_SIZE, CS, MOST_ITERATIONS = SLOT_BUCKETS * len(HTTP_CATS), [i / 10 for i in range(1, 10)], [1, 2, 3, 5, 8, 10, 20, 40]


def _c_curve(spark, d):
    return lc.penalty_curve(*_slot_parts(spark, d), _SIZE, CS, lambda c: 1 / c, per_row=True)


@register("q_m15_c_curve")
def q_m15c(spark, d):
    """The logistic learner's C on the requests, cross-validated and on the holdout."""
    return write_result(spark, d, "c-curve", _c_curve(spark, d))


@register("q_m15_c_values", f"SELECT unnest({CS})::DOUBLE AS param, TRUE AS scored")
def q_m15cv(spark, d):
    return _in_range(written_by(spark, d, "c-curve", _c_curve))


def _alpha_curve(spark, d):
    return lc.penalty_curve(*_slot_parts(spark, d), _SIZE, [10.0 ** -i for i in range(15)], lambda a: a)


@register("q_m15_alpha_curve")
def q_m15a(spark, d):
    """The penalty alpha = 1 to 1e-14."""
    return write_result(spark, d, "alpha-curve", _alpha_curve(spark, d))


@register("q_m15_alpha_values", "SELECT 10.0::DOUBLE ** -i AS param, TRUE AS scored FROM range(0, 15) t(i)")
def q_m15av(spark, d):
    return _in_range(written_by(spark, d, "alpha-curve", _alpha_curve))


def _iteration_curve(spark, d):
    return lc.iteration_curve(*_slot_parts(spark, d), _SIZE, MOST_ITERATIONS)


@register("q_m15_iteration_curve")
def q_m15i(spark, d):
    """The greatest number of iterations."""
    return write_result(spark, d, "iteration-curve", _iteration_curve(spark, d))


@register("q_m15_iteration_values", f"SELECT unnest({MOST_ITERATIONS})::DOUBLE AS param, TRUE AS scored")
def q_m15iv(spark, d):
    return _in_range(written_by(spark, d, "iteration-curve", _iteration_curve))


SHARES = [i / 10 for i in range(1, 8)]


def _split_sizes(spark, d):
    return tn.split_size_curve(md.decision_tree(depth=7), _windows(spark, d), SHARES, "label", ["TS_PART", "USER_ID"], merged=_copies)


@register("q_m16_split_size_curve")
def q_m16(spark, d):
    return write_result(spark, d, "split-sizes", _split_sizes(spark, d))


@register("q_m16_sizes", _WINDOWS + "SELECT share AS test_share, count(*) FILTER (u < 1 - share) AS train_rows, count(*) FILTER (u >= 1 - share) AS test_rows, "
          f"TRUE AS scored FROM (SELECT CAST(('0x' || substring(md5('17|' || {_WINDOW_KEY}), 1, 8)) AS BIGINT) / 4294967296.0 AS u, "
          f"unnest({SHARES})::DOUBLE AS share FROM w) t GROUP BY share")
def q_m16s(spark, d):
    """The rows on both sides of each split, and that it has its scores."""
    return written_by(spark, d, "split-sizes", _split_sizes) \
        .select("test_share", "train_rows", "test_rows", (F.col("cv_f1").between(0.0, 1.0) & F.col("holdout_f1").between(0.0, 1.0)).alias("scored"))


@register("q_m17_feature_selection")
def q_m17(spark, d):
    _, train, _, model = _http_lr(spark, d)
    names = en.slot_names(model.transform(train), HTTP_CATS)
    return md.selected_features(md.named_weights(model.stages[-1].coefficients.toArray().tolist(), names))


_SLOTS = with_(HTTP, """s AS (SELECT CAST(row_number() OVER (ORDER BY c, value) - 1 AS INTEGER) AS slot, name, value FROM (
  SELECT DISTINCT 0 AS c, 'operation' AS name, operation AS value FROM http UNION SELECT DISTINCT 1, 'method', method FROM http
  UNION SELECT DISTINCT 2, 'requestType', requestType FROM http) t)""")


def _slots(spark, d):
    """Names of the stacked one-hot slots of three columns."""
    h = si.http(spark, d).select("operation", "method", "requestType")
    cats = h.columns
    return en.slot_names(en.one_hot_fit(h, cats).transform(h), cats)


@register("q_m17_selection_rule", _SLOTS + """, w AS (SELECT name || '=' || value AS feature, CAST(slot * slot % 7 - 3 AS DOUBLE) AS weight FROM s)
SELECT feature, weight FROM w WHERE abs(weight) >= (SELECT avg(abs(weight)) FROM w)""")
def q_m17r(spark, d):
    """The selection on weights that are given by slot, so that names and rule can be checked."""
    names = _slots(spark, d)
    return md.selected_features(md.named_weights([i * i % 7 - 3 for i in range(names.count())], names))


@scored_rows("q_m19_example_predictions", "q_m19_keys", _WINDOW_TEST + " ORDER BY TS_PART, USER_ID LIMIT 5", ["TS_PART", "USER_ID", "label"])
def q_m19(spark, d):
    """The first five rows of the holdout with class and probability."""
    f = md.hash_split(login_window_features(spark, d), ["TS_PART", "USER_ID"], 0.3)
    model = md.decision_tree(depth=7).fit(f.where("part = 'train'"))
    top = model.transform(f.where("part = 'test'")).orderBy("TS_PART", "USER_ID").limit(5)
    return md.p_bot(top).select("TS_PART", "USER_ID", "label", "prediction", "predict_proba", md.checked_score().alias("scored"))


@scored_rows("q_m20_batch_scoring", "q_m20_batch_checked", with_(HTTP) + "SELECT ROW_ID, userId, TRUE AS scored FROM http", ["ROW_ID", "userId"])
def q_m20(spark, d):
    """Every request scored by a model of the training part."""
    h, _, _, model = _http_lr(spark, d)
    scored = md.p_bot(model.transform(h))
    return scored.select("ROW_ID", "userId", "predict_proba", (md.checked_score() & F.col("predict_proba").between(0.0, 1.0)).alias("scored"))


@register("q_flow_http_user_report")
def q_flow_http(spark, d):
    """3.3: scan -> hash -> one-hot -> split -> logistic -> per-user max on the holdout -> class report."""
    _, _, test, model = _http_lr(spark, d, C=0.1)
    scored = md.p_bot(model.transform(test)).select("userId", "predict_proba", F.col("label").cast("int").alias("y"))
    users = user_rollup(scored, "userId", "predict_proba", "y", 0.5)
    return class_report(users, "y", "pred")


@register("q_a24_pca_loadings")
def q_a24(spark, d):
    h = http_features(spark, d)
    cats = ["operation", "method", "requestType"]
    v = en.one_hot_fit(h, cats).transform(h)
    model, _ = en.pca_2d(v, "features")
    return md.loadings_by_source(md.loadings_of(model), en.slot_names(v, cats))


@register("q_a24_loadings_rule", _SLOTS + 'SELECT name AS "column", sum(CAST(slot + 1 AS DOUBLE) / 64) AS loading FROM s GROUP BY 1')
def q_a24r(spark, d):
    """The sums on loadings that are given by slot."""
    slots = _slots(spark, d)
    return md.loadings_by_source(slots.select("slot", ((F.col("slot") + 1) / 64.0).alias("sq")), slots)


@register("q_flow_login_window_forest")
def q_flow_login(spark, d):
    """3.4: logins -> labelled stack -> sliding counts -> listed columns -> split -> forest -> F1."""
    f = md.hash_split(login_window_features(spark, d), ["TS_PART", "USER_ID"], 0.3)
    model = md.random_forest(trees=5, depth=19, subset="all").fit(f.where("part = 'train'"))
    pred = model.transform(f.where("part = 'test'")).withColumn("pred", F.col("prediction").cast("int"))
    return f1_positive(pred, "isBot", "pred")


@register("q_flow_live_demo", with_(HTTP) + "SELECT timestamp // 1000 AS window_start, count(*) AS requests FROM http GROUP BY 1")
def q_flow_live(spark, d):
    """3.5: requests scored by the served model (T2), then verdicts per second (T3): each request is in one."""
    from pyspark.sql.types import StringType, StructField, StructType

    from trafficlens.streaming import streams as st
    h, _, _, model = _http_lr(spark, d)
    served = md.save_load(model, fs.fresh(spark, "served-model"))
    folder = fs.fresh(spark, "timed-requests")
    h.join(si.http(spark, d).select("ROW_ID", "timestamp"), "ROW_ID") \
        .select(F.col("ROW_ID").cast("string").alias("ROW_ID"), F.col("timestamp").cast("string").alias("timestamp"),
                *[F.col(c).cast("string") for c in HTTP_CATS]).write.json(folder)
    fields = ["ROW_ID", "timestamp", *HTTP_CATS]
    schema = StructType([StructField(c, StringType()) for c in fields])
    scored = st.score_requests(spark, folder, schema, served, fields) \
        .select(F.timestamp_millis(F.col("timestamp").cast("long")).alias("ts"), "predict_proba")
    log = st.run_upsert_log(st.verdict_counts(scored, "ts", "predict_proba"), fs.fresh(spark, "live-verdicts"))
    return st.latest_per_key(spark, log, ["window_start"]).select("window_start", (F.col("users") + F.col("bots")).alias("requests"))
