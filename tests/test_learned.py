"""Learners find something, and what stands in for many fits equals the single ones."""

import json

import numpy as np
import pytest
from pyspark.ml.feature import VectorIndexer
from pyspark.sql import functions as F

from tests.conftest import SF, SMOKE
from trafficlens.functions.timebuckets import ts_buckets, ts_group
from trafficlens.operators import encode as en
from trafficlens.plans import bucket_grid as bg
from trafficlens.plans import bucket_logit as bl
from trafficlens.plans import depths as dp
from trafficlens.plans import linear_curves as lc
from trafficlens.plans import models as md
from trafficlens.plans import neighbours as nb
from trafficlens.plans import sgd
from trafficlens.plans import tree_columns as tc
from trafficlens.plans import tuning as tn
from trafficlens.plans import wide_pca as wp
from trafficlens.plans.many import minimise
from trafficlens.queries import q_learners, q_neighbours, q_wide
from trafficlens.session import scratch_path
from trafficlens.sources import files as fs
from trafficlens.sources import standins as si


def f1(rows, label, said="prediction"):
    hits = sum(r[label] == 1 and r[said] == 1 for r in rows)
    wrong = sum((r[label] == 1) != (r[said] == 1) for r in rows)
    return 2 * hits / max(1, 2 * hits + wrong)


@pytest.mark.parametrize("name, label", [("q_m4_linear_svm", "label"), ("q_m5_logistic", "label"), ("q_m6_param_maps", "label"), ("q_m7_distributed_fit", "label"),
                                         ("q_m7_batches", "label"), ("q_m9_bucket_logit", "isBot"), ("q_m10_text_pipeline", "label"), ("q_t5_train_by_slices", "isBot")])
def test_no_constant_classifier(spark, name, label):
    """Both classes are predicted on the holdout, and class 1 well above chance: a constant has an F1 of 0, or of the class's share."""
    import __spark_entry__ as ent
    rows = ent.queries()[name](spark, SF).collect()
    share = sum(r[label] == 1 for r in rows) / len(rows)
    assert {r["prediction"] for r in rows} == {0.0, 1.0}
    assert f1(rows, label) > (max(0.2, 2 * share / (1 + share) + 0.02) if share < 0.5 else 2 * share / (1 + share) + 0.02)


def test_tree_over_addresses_finds_bots(spark):
    import __spark_entry__ as ent
    rows = ent.queries()["q_m1_decision_tree"](spark, "/root/testdata/sf0.1").collect()
    assert {r.predictedLabel for r in rows} == {"bot", "human"}
    hits, wrong = sum(r.label == r.predictedLabel == "bot" for r in rows), sum(r.label != r.predictedLabel for r in rows)
    assert 2 * hits / (2 * hits + wrong) > 0.3


def test_online_scores_tell_bots_apart(spark):
    import __spark_entry__ as ent
    scores = ent.queries()["q_t2_online_scoring"](spark, SF)
    bots = si.http(spark, SF).select(F.col("ROW_ID").cast("string").alias("ROW_ID"), "isBot")
    rows = scores.join(bots, "ROW_ID").collect()
    assert {r.prediction for r in rows} == {0.0, 1.0} and f1(rows, "isBot") > 0.4


@pytest.mark.parametrize("name, column", [("q_m15_validation_curve", "holdout_f1"), ("q_m7_batch_curve", "f1"), ("q_t5_slice_curve", "f1"), ("q_m9_grid", "f1")])
def test_curves_are_not_flat(spark, name, column):
    import __spark_entry__ as ent
    values = [r[column] for r in ent.queries()[name](spark, SF).collect()]
    assert max(values) > 0.2 and min(values) < max(values) - 0.1


# --- M12, M15: one tree, every depth ---------------------------------------------------

def test_a_cut_tree_is_the_shallower_tree(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (3000, 4))
    y = ((x[:, 0] > 5) ^ (x[:, 1] % 3 == 0) | (x[:, 2] * x[:, 3] > 70) ^ (rng.random(3000) < 0.1)).astype(float)
    rows = spark.createDataFrame([(*map(int, a), float(b), i % 5) for i, (a, b) in enumerate(zip(x, y, strict=True))], "a int, b int, c int, d int, label double, fold int")
    data = en.assemble(["a", "b", "c", "d"]).transform(rows)
    train, holdout = data.where("fold < 4"), data.where("fold = 4")
    depths = [1, 2, 3, 5, 8, 12]
    scores, model = dp.depth_scores(md.decision_tree(), depths, train, holdout, folds=4)
    assert model.depth > 8
    scores = {r.depth: r for r in scores.collect()}
    for d in depths:
        single = md.decision_tree(depth=d).fit(train).transform(holdout)
        cut = dp.classes_at(model, holdout, d)
        keys = ["a", "b", "c", "d", "label", "prediction"]
        assert cut.select(keys).exceptAll(single.select(keys)).count() == 0
        assert scores[d].holdout_f1 == pytest.approx(tn.f1_evaluator().evaluate(single))
    by_cv = tn.grid_search(md.decision_tree(), [{md.decision_tree().maxDepth: 5}], train, folds=4).avgMetrics[0]
    assert scores[5].cv_f1 == pytest.approx(by_cv)


# --- M7, T5: batch by batch --------------------------------------------------------------

def _rows(spark, n, seed, one_class=False):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        y = 0.0 if one_class else float(rng.random() < 0.3)
        slots = sorted({int(s) for s in rng.integers(0, 6, 3)} | ({7} if (rng.random() < 0.9) == bool(y) else {6}))
        out.append((slots, [1.0] * len(slots), y))
    return spark.createDataFrame(out, "slots array<int>, values array<double>, label double").repartition(3)


@pytest.mark.parametrize("loss", [sgd.HINGE, sgd.LOG])
def test_steps_are_the_plain_ones(spark, loss):
    """Against the same steps in numpy, batch after batch."""
    learner, batches = sgd.Learner(8, loss, alpha=0.01, eta=2.0, steps=3), [_rows(spark, 60, s) for s in range(3)]
    folder = scratch_path(spark, "sgd")
    assert sgd.learn_batches(batches, learner, folder, spark) == 3
    w, b, done = np.zeros(8), 0.0, 0
    for batch in batches:
        rows = batch.collect()
        x, sign = np.zeros((len(rows), 8)), np.array([2 * r.label - 1 for r in rows])
        for i, r in enumerate(rows):
            x[i, r.slots] = r.values
        for _ in range(3):
            z = sign * (x @ w + b)
            pull = np.where(z < 1, -sign, 0) if loss == sgd.HINGE else -sign / (1 + np.exp(z))
            eta = 2.0 / np.sqrt(1 + done)
            w, b, done = w * (1 - eta * 0.01) - eta * x.T @ pull / len(rows), b - eta * pull.mean(), done + 1
    state = sgd.read_state(spark, folder, 2)
    assert np.allclose(state.weights, w, atol=1e-9) and state.bias == pytest.approx(b) and state.done == 9
    found = sgd.scored(_rows(spark, 200, 9), state).collect()
    assert f1(found, "label") > 0.7 and [r.batch for r in sgd.curve(_rows(spark, 200, 9), folder).orderBy("batch").collect()] == [0, 1, 2]


def test_a_retried_batch_ends_in_the_same_weights(spark):
    learner, folder = sgd.Learner(8, eta=2.0), scratch_path(spark, "sgd")
    batches = [_rows(spark, 50, s) for s in range(3)]
    sgd.learn_batches(batches, learner, folder, spark)
    before = [sgd.read_state(spark, folder, b) for b in range(3)]
    again = sgd.learn_batch(batches[1], 1, learner, folder)  # over what the first try left
    assert np.allclose(again.weights, before[1].weights, atol=1e-12) and again.done == before[1].done
    sgd.write_state(spark, folder, 9, again)
    assert sgd.learn_batches(batches, learner, folder, spark) == 3  # nothing is learned twice
    assert sgd.read_state(spark, folder, 2) == before[2]


def test_batches_of_one_class_or_none(spark):
    learner, folder = sgd.Learner(8), scratch_path(spark, "sgd")
    users = sgd.learn_batch(_rows(spark, 30, 1, one_class=True), 0, learner, folder)
    assert users.bias < 0
    assert sgd.learn_batch(_rows(spark, 30, 1).where("false"), 1, learner, folder) == users


def test_a_stream_learns_as_batches_do(spark):
    learner, source = sgd.Learner(8, eta=2.0), scratch_path(spark, "files")
    batches = [_rows(spark, 40, s).coalesce(1) for s in range(2)]
    by_hand, by_stream = scratch_path(spark, "sgd"), scratch_path(spark, "sgd")
    for b, batch in enumerate(batches):
        batch.write.mode("append").parquet(source)
        sgd.learn_batch(batch, b, learner, by_hand)
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
        sgd.learn_stream(stream, learner, by_stream)  # started again, it goes on with the new file
    assert sgd.states(spark, by_stream).count() == 2
    assert np.allclose(sgd.read_state(spark, by_stream, 1).weights, sgd.read_state(spark, by_hand, 1).weights, atol=1e-12)


# --- M3 ----------------------------------------------------------------------------------

def _exact(asked, known, k):
    """{query: [(distance, key)]} by brute force."""
    x, ids = np.array([v for _, v, _ in known]), [i for i, _, _ in known]
    return {q: sorted(zip(((x - np.array(v)) ** 2).sum(1).round(9), ids, strict=True))[:k] for q, v, _ in asked}


def test_recall_on_random_directions(spark):
    """The hardest vectors there are: unit length, no structure."""
    v = si.vectors(spark, "/root/testdata/sf0.1")
    rows = [(r.vec_id, list(map(float, r.embedding)), r.label) for r in v.collect()]
    asked, known = [r for r in rows if r[0] % 50 == 0], [r for r in rows if r[0] % 50]
    found = {}
    for r in q_neighbours._found(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query, {})[r.rank] = r.key
    exact = _exact(asked, known, 19)
    for k in range(1, 20):
        hits = sum(len({found[q][r] for r in range(1, k + 1)} & {i for _, i in exact[q][:k]}) for q in exact)
        assert hits / (k * len(exact)) >= 0.9, k


def test_few_different_rows_are_found_whole(spark):
    """Counts: ties by key, a hot group of equal rows, equal queries; votes as the exact neighbours give them."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.poisson(0.7, 4)], int(i % 3 == 0)) for i in range(600)] + [(600 + i, [1.0, 0.0, 2.0, 0.0], 1) for i in range(300)]
    rows += [(None, [0.0] * 4, 1), (2000, None, 1), (2001, [float("nan"), 0.0, 0.0, 0.0], 1), (2002, [None, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int").withColumn("distance", F.lit("clash"))
    asked = df.where("id % 50 = 0 OR id > 1999 OR id IS NULL")
    found = {}
    for r in nb.nearest(asked, df.where("id % 50 <> 0 OR id IS NULL"), 7, 4, tables=8).collect():
        found.setdefault(r.query, []).append((r.rank, r.key, r.distance))
    usable = [r for r in rows if r[0] is not None and r[0] < 2000]
    exact = _exact([r for r in usable if r[0] % 50 == 0], [r for r in usable if r[0] % 50], 7)
    assert set(found) == set(exact)
    hits = sum([k for _, k, _ in sorted(found[q])] == [i for _, i in exact[q]] for q in exact)
    assert hits >= 0.9 * len(exact)
    assert nb.nearest(asked.where("false"), df, 3, 4).count() == 0 and nb.nearest(asked, df.where("false"), 3, 4).count() == 0


def test_votes(spark):
    rows = [(1, 1, 5, 0), (1, 2, 6, 1), (1, 3, 7, 1), (2, 1, 5, 1)]
    got = {(r.query, r.k): r.vote for r in nb.votes(spark.createDataFrame(rows, "query long, rank int, key long, label int"), 3).collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (1, 3): 1, (2, 1): 1, (2, 2): 1, (2, 3): 1}


# --- M9's grid ------------------------------------------------------------------------------

def test_grid_scores_are_the_single_fits(spark):
    lg = md.hash_split(si.logins(spark, SF), ["USER_ID"], 0.33)
    train, valid = lg.where("part = 'train'"), lg.where("part = 'test'")
    scores, best = bg.search(train, valid, bg.Grid([2, 3], [1, 20], [[], ["error"], ["click", "error"]]))
    rows = scores.collect()
    for r in rows:
        single = bl.BucketLogit(**json.loads(r.params)).fit(train).score(valid).first()[0]
        assert r.f1 == pytest.approx(single, abs=0.05)
    assert [json.loads(r.params) for r in rows if r.best] == [best] and best["credentialTypes"]


def test_grid_weights_are_the_single_fit(spark):
    lg = si.logins(spark, SMOKE)
    grid = bg.Grid([2], [3], [["error"]])
    lo, hi = lg.agg(F.min("TIMESTAMP"), F.max("TIMESTAMP")).first()
    weights = bg.fit_all(bg.shared_counts(lg, grid, float(lo), float(hi)), grid, iterations=200, tolerance=1e-9)
    single = bl.BucketLogit(parts=2, shortParts=3, credentialTypes=["error"]).fit(lg).logit
    assert np.allclose(weights[1:], single.coefficients.toArray()[1:], atol=1e-2) and weights[0] == pytest.approx(single.intercept, abs=1e-2)


def test_lengths_tried_together_are_those_tried_one_by_one():
    """A curved valley, where most steps are halved, beside a bowl."""
    def losses(x):
        return np.array([100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2, (x[2] - 3) ** 2])

    def at(x, _):
        calls.append(1)
        return losses(x), np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2), 2 * (x[2] - 3)])
    calls = []
    one_by_one = minimise(at, [0, 2, 3], 12, 1e-9)[0]
    single, calls = len(calls), []
    together = minimise(at, [0, 2, 3], 12, 1e-9, along=lambda x, q, lengths, _: np.stack([losses(x - n * q) for n in lengths]))[0]
    assert np.allclose(one_by_one, together) and len(calls) <= 1 + 2 * 12 and len(calls) < single


def test_losses_along_a_direction_are_those_at_its_points(spark):
    """What a step's second pass says is what a pass a length says, for the asked maps."""
    rows = [(u, u % 2, [1, 2], [1, u % 3], [float(u % 7), float(u % 5)], float(u % 7 < 3)) for u in range(60)]
    counts = spark.createDataFrame(rows, "USER_ID long, pair int, buckets array<int>, kinds array<int>, counts array<double>, label double")
    grid = bg.Grid([1, 2], [2], [["error"], ["click"], []])
    size, lengths, asked = grid.starts()[-1], [0.5, 0.25], np.array([True, False, True, False, False, False])
    x, q = np.linspace(-1, 1, size), np.linspace(2, -3, size)
    found = bg._losses_along(counts, grid, x, q, lengths, asked)
    for n, losses in zip(lengths, found, strict=True):
        single = bg._sums(counts, grid, x - n * q, np.ones(6, bool))[0]
        assert np.allclose(losses[asked], single[asked]) and single.all() and not losses[~asked].any()


def _odd_logins(spark):
    """Few users and one with most logins; some logins are twice, some have no user, time or type."""
    rng, rows = np.random.default_rng(7), []
    for i in range(900):
        user = 5 if i % 3 else int(rng.integers(0, 40))
        rows.append((user, int(rng.integers(0, 3) * 500 if i % 7 == 0 else rng.integers(0, 1001)), ["error", "click", "view", None][int(rng.integers(0, 4))], user % 2, i))
    rows += [(*r[:4], 900 + i) for i, r in enumerate(rows[:50])] + [(None, 3, "error", 1, 1000), (3, None, "error", 1, 1001), (77, -20, "error", 1, 1002), (78, 1300, "click", 0, 1003)]
    return spark.createDataFrame(rows, "USER_ID long, TIMESTAMP long, LOGIN_CREDENTIAL_TYPE string, isBot int, ROW_ID long").repartition(4)


@pytest.fixture
def small_batches(spark):
    """Arrow batches of 50 rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, 50)
    yield
    spark.conf.set(name, was)


def test_chunks_give_the_sums_of_each_map(spark, monkeypatch, small_batches):
    """Loss, users and gradient of every map from packed logins, against its users' counts by time group; a user with most
    logins is bounded by the grid, and nothing is written a user and pair."""
    monkeypatch.setattr(bg, "CHUNK_LOGINS", 64)
    monkeypatch.setattr(bg, "PIECE", 50)
    lg, grid, lo, hi = _odd_logins(spark), bg.Grid([1, 2, 3], [1, 4, 7], [[], ["error"], ["click", "error"]]), 0.0, 1000.0
    counts = bg.shared_counts(lg, grid, lo, hi, slices=2)
    chunks = counts.collect()
    assert 2 < len(chunks) < lg.select("USER_ID").distinct().count()
    entries = [n for c in chunks for n in np.frombuffer(c.entries, "int32")]
    assert 100 < max(entries) < 64 + 50 + 3 * sum(p * s + 1 for p, s in grid.pairs()) < lg.where("USER_ID = 5").count()
    rng, asked = np.random.default_rng(2), np.ones(len(grid.maps()), bool)
    asked[4] = False
    x = rng.normal(size=grid.starts()[-1]) / 5
    losses, users, g = bg._sums(counts, grid, x, asked)
    for m, fixed in enumerate(grid.maps()):
        a, b = grid.starts()[m:m + 2]
        if not asked[m]:
            assert not losses[m] and not users[m] and not g[a:b].any()
            continue
        types, size = fixed["credentialTypes"], b - a
        rows = lg.withColumn("g", ts_group("TIMESTAMP", lo, hi, fixed["parts"], fixed["shortParts"])).where(f"USER_ID IS NOT NULL AND g BETWEEN 1 AND {size - 1}").collect()
        vectors = {}
        for r in rows:
            if not types or r.LOGIN_CREDENTIAL_TYPE in types:
                vectors.setdefault(r.USER_ID, np.zeros(size))[r.g] += 1
        loss, pull = 0.0, np.zeros(size)
        for u, v in vectors.items():
            v[0], sign = 1, 2 * (u % 2) - 1
            loss += np.log1p(np.exp(-sign * (v @ x[a:b])))
            pull -= v * sign / (1 + np.exp(sign * (v @ x[a:b])))
        assert users[m] == len(vectors) and losses[m] == pytest.approx(loss) and np.allclose(g[a:b], pull)


def test_buckets_of_numbers_are_the_time_groups(spark):
    lo, hi, pairs = 1704067211172.0, 1706659165261.0, [(1, 1), (1, 1500), (3, 7), (3, 200), (7, 30), (8, 1500)]
    rng = np.random.default_rng(1)
    edges = [lo + (hi - lo) * k / n for n in (1, 2, 3, 7, 21, 30, 210, 600, 1500, 12000) for k in range(min(n, 40) + 1)]
    times = sorted({int(t) + d for t in [*edges, *rng.uniform(lo - 1e8, hi + 1e8, 2000)] for d in (-1, 0, 1)})
    rows = spark.createDataFrame([(t,) for t in times], "t long").select(*[ts_group("t", lo, hi, p, s) for p, s in pairs]).collect()
    for i, found in ts_buckets()(np.array(times, float) - lo, hi - lo, pairs):
        assert [r[i] for r in rows] == found.tolist()


# --- M15 over a linear learner's parameters ---------------------------------------------------

def test_penalty_curve_is_the_single_fits(spark):
    """Against pyspark.ml's logistic regression, fold by fold."""
    rng, size = np.random.default_rng(12), 8
    rows = []
    for i in range(800):
        y, slots = float(rng.random() < 0.3), sorted({int(x) for x in rng.integers(0, 6, 3)})
        rows.append(([*slots, 7 if (rng.random() < 0.8) == bool(y) else 6], [1.0] * (len(slots) + 1), y, i % 3, i % 4 == 0))
    df = spark.createDataFrame(rows, "slots array<int>, values array<double>, label double, fold int, held boolean").repartition(3)
    train, holdout = df.where("not held"), df.where("held")
    curve = {r.param: r for r in lc.penalty_curve(train, holdout, size, [0.001, 0.1, 1.0], lambda c: 1 / c, per_row=True, folds=3).collect()}
    assert sorted(curve) == [0.001, 0.1, 1.0] and curve[0.001].cv_f1 < curve[1.0].cv_f1

    def dense(part):
        v = F.map_from_arrays("slots", "values")
        cols = part.select("label", *[F.coalesce(v[i], F.lit(0.0)).alias(f"x{i}") for i in range(size)])
        return en.assemble([f"x{i}" for i in range(size)]).transform(cols)
    for c in (0.1, 1.0):
        def single(known, asked, c=c):
            return tn.f1_evaluator().evaluate(md.logistic(C=c, n=known.count()).fit(dense(known)).transform(dense(asked)))
        folds = [single(train.where(F.col("fold") != k), train.where(F.col("fold") == k)) for k in range(3)]
        assert curve[c].cv_f1 == pytest.approx(sum(folds) / 3, abs=0.02) and curve[c].holdout_f1 == pytest.approx(single(train, holdout), abs=0.02)


def test_squared_hinge_ends_where_its_gradient_is_zero(spark):
    rng = np.random.default_rng(2)
    x, y = rng.poisson(1.0, (300, 4)).astype(float), (rng.random(300) < 0.4).astype(float)
    rows = spark.createDataFrame([([0, 1, 2, 3], [float(v) for v in a], float(b), int(i % 2)) for i, (a, b) in enumerate(zip(x, y, strict=True))],
                                 "slots array<int>, values array<double>, label double, fold int")
    w, taken = lc.fit(lc._ready(rows), 4, [0.1, 1e-3], [-1, 1], False, 200, 1e-9, (3, 200), lc.SQUARED_HINGE)
    for m, (penalty, known) in enumerate([(0.1, np.ones(300, bool)), (1e-3, np.arange(300) % 2 == 0)]):
        sign = 2 * y[known] - 1
        pull = -2 * sign * np.maximum(1 - sign * (x[known] @ w[m, :4] + w[m, 4]), 0)
        assert np.abs(x[known].T @ pull / known.sum() + penalty * w[m, :4]).max() < 1e-4 and abs(pull.mean()) < 1e-4
    assert np.array_equal(taken[200], w) and not np.allclose(taken[3], w)
    found = lc.map_scores(rows, 4, [(0.1, 50), (10.0, 50), (0.1, 1)], folds=2).collect()
    assert [r.best for r in found].count(True) == 1 and json.loads(found[2].params) == {"maxIter": 1, "regParam": 0.1}


def test_iteration_curve_rises(spark):
    import __spark_entry__ as ent
    rows = sorted(ent.queries()["q_m15_iteration_curve"](spark, SF).collect())
    assert rows[0].holdout_f1 < 0.1 and rows[-1].holdout_f1 > 0.5 and rows[-1].cv_f1 > 0.5


# --- F17, A24 ----------------------------------------------------------------------------------

def test_wide_components_are_the_exact_ones(spark):
    v = si.vectors(spark, SF).select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in v], float) * np.linspace(3, 1, 64)
    x[:, 5] += 4 * x[:, 1]
    rows = spark.createDataFrame([(i, s, float(c)) for i, r in enumerate(x) for s, c in enumerate(r)], "row long, slot long, value double")
    found = wp.principal_components(rows, len(x), 3, passes=6)
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(found.variances, s[:3] ** 2 / (len(x) - 1), rtol=1e-2) and found.total == pytest.approx((s ** 2).sum() / (len(x) - 1))
    c = {r.slot: r for r in found.components.collect()}
    for i in range(2):
        mine = np.array([c[j][f"c{i + 1}"] for j in range(64)])
        assert abs(mine @ vt[i]) > 0.99 and np.linalg.norm(mine) == pytest.approx(1, abs=1e-6)
    p = {r.row: r.p1 for r in found.projections.collect()}
    assert abs(np.corrcoef([p[i] for i in range(len(x))], centred @ vt[0])[0, 1]) > 0.99


def test_wide_components_at_ten_million_buckets(spark):
    h = si.http(spark, SMOKE).select("ROW_ID", "operation", "userAgent")
    found = wp.principal_components(wp.hashed_entries(h, "ROW_ID", ["operation", "userAgent"], 10_000_000), h.count(), 2)
    assert len(found.variances) == 2 and found.total > sum(found.variances) > 0
    assert found.components.agg(F.max("slot")).first()[0] > 10_000_000 and found.projections.count() == h.count()
    none = wp.principal_components(spark.createDataFrame([], "row long, slot long, value double"), 0, 2)
    assert none.variances == [] and none.total == 0.0


# --- M1, M20 as columns ---------------------------------------------------------------------------

def test_columns_are_the_models_scores(spark):
    """Depth-19 forest and a tree with categorical splits, against transform on all rows; the tree as SQL in DuckDB."""
    import duckdb
    rng = np.random.default_rng(4)
    rows = [(int(a), float(b), int(c), float((a in (1, 4)) ^ (b > 0.3) ^ (rng.random() < 0.15))) for a, b, c in zip(rng.integers(0, 6, 1500), rng.normal(size=1500), rng.integers(0, 50, 1500), strict=True)]
    df = en.assemble(["a", "b", "c"]).transform(spark.createDataFrame(rows, "a int, b double, c int, label double"))
    df = VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=6).fit(df).transform(df)
    forest = md.random_forest(features="indexed", trees=7, depth=19).fit(df)
    tree = md.decision_tree(features="indexed", depth=6).fit(df)
    columns = [F.col("a"), F.col("b"), F.col("c")]
    for model in (forest, tree):
        shares = tc.probabilities(tc.trees_of(model), columns)
        both = model.transform(df).select("prediction", en.to_array("probability").alias("p"), shares.alias("s"), tc.prediction(shares).alias("mine")).collect()
        assert all(r.prediction == r.mine and np.allclose(r.p, r.s, atol=1e-12) for r in both)
    nodes = tc.trees_of(tree)[0]
    assert any(n.categories for n in nodes.values())
    frame = df.select("a", "b", "c", tc.probabilities([nodes], columns)[1].alias("p")).toPandas()  # noqa: F841 - DuckDB reads it by name
    assert duckdb.sql(f"SELECT count(*) FROM frame WHERE abs(p - {tc.sql(nodes, ['a', 'b', 'c'], lambda s: repr(s[1]))}) > 1e-12").fetchall() == [(0,)]
    assert q_wide.STORED_TREE[0].left == 1


# --- P7, S8 ------------------------------------------------------------------------------------------

def test_slices_read_only_their_folders(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("ts"), F.col("id").alias("slice_id"))
    path = fs.write_by_slice(rows, scratch_path(spark, "slices"), "ts", 0, 100)
    for closed in ("left", "both"):
        got = fs.read_between(spark, path, "ts", 0, 100, 250, 500, closed)
        assert sorted(r.ts for r in got.collect()) == list(range(250, 501 if closed == "both" else 500)) and "slice" not in got.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "slice" in plan.split("PartitionFilters")[1].split("]")[0]
    wanted = spark.createDataFrame([(3,), (3,), (7,)], "slice int")
    assert fs.read_listed(spark, path, wanted).count() == 200
    assert q_learners.BATCH_MS > 0


def test_buckets_meet_without_a_shuffle(spark):
    left = spark.range(500).selectExpr("id % 90 AS k", "id AS a")
    right = spark.range(300).selectExpr("id % 120 AS k", "id AS b")
    joined = fs.join_colocated(spark, fs.write_bucketed(left, "k", 4, "left"), fs.write_bucketed(right, "k", 4, "right"), "k")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
