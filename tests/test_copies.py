"""Searches and learners whose work grows with the different rows, not with their copies or with what meets what."""

import numpy as np
from pyspark.sql import functions as F

from trafficlens.operators import encode as en
from trafficlens.plans import depths as dp
from trafficlens.plans import forests as fo
from trafficlens.plans import linear_curves as lc
from trafficlens.plans import models as md
from trafficlens.plans import neighbours as nb
from trafficlens.plans import quantile_vote as qv
from trafficlens.plans import tuning as tn


def test_a_wide_probe_lists_no_cells(monkeypatch, spark):
    """22 planes a table: 2 ** 16 cells a query and table. Who meets whom is as by the codes, with keys that come twice and ties."""
    rng, tables, n = np.random.default_rng(5), 2, 22
    x = rng.integers(-4, 5, (900, 6)).astype(float)
    rows = [(i if i != 77 else 78, [float(c) for c in v], int(i % 4)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    monkeypatch.setattr(nb, "plane_count", lambda rows: n)
    monkeypatch.setattr(nb, "KNOWN_BLOCK", 200)
    monkeypatch.setattr(nb, "ASKED_BLOCK", 100)
    found = {}
    for r in nb.nearest(df.where("id % 2 = 0 AND id <> 78"), df.where("id % 2 = 1 OR id = 78"), 5, 6, tables=tables).collect():
        found.setdefault(r.query, []).append((r.rank, r.key, r.distance))
    at = np.array(nb.planes(6, n, tables=tables), float)
    side = np.einsum("tpd,rd->rtp", at, x)
    probed = nb.probe_count(n)
    known = [i for i, r in enumerate(rows) if r[0] % 2 or r[0] == 78]
    for q, v, _ in rows:
        if q % 2 or q == 78:
            continue
        near = np.argsort(np.abs(side[q]), axis=1, kind="stable")[:, :probed]
        fixed = np.ones((tables, n), bool)
        np.put_along_axis(fixed, near, False, axis=1)
        met = {rows[i][0] for i in known if (((side[i] > 0) == (side[q] > 0)) | ~fixed).all(1).any()}
        best = sorted((((x[i] - np.array(v)) ** 2).sum(), rows[i][0]) for i in known if rows[i][0] in met)[:5]
        assert [(k, d) for _, k, d in sorted(found.get(q, []))] == [(k, d) for d, k in best]


def test_a_curve_asks_each_different_row_once(monkeypatch, spark):
    """3,000 rows of 12 kinds: as many rows as the kinds have neighbours are voted on, and the scores are those of all rows."""
    rows = [(i, float(i % 4), float(i % 3), int((i * i % 7 + i % 4) % 3 == 0), i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int, fold int")
    train, holdout, k, seen = df.where("id % 5 > 0"), df.where("id % 5 = 0"), 3, []
    votes = nb.votes
    monkeypatch.setattr(nb, "votes", lambda found, k: seen.append(found.count()) or votes(found, k))
    curve = {r.param: r for r in nb.neighbour_curve(train, holdout, ["a", "b"], k, folds=2).collect()}
    assert seen and max(seen) <= 12 * k
    for part, known, asked in (("holdout_f1", [r for r in rows if r[0] % 5], [r for r in rows if not r[0] % 5]),):
        for j in range(1, k + 1):
            hits = wrong = 0
            for _, a, b, label, _ in asked:
                said = sorted(r[0] for r in known if r[1:3] == (a, b))[:j]
                ones = sum(rows[i][3] for i in said)
                vote = int(ones > j - ones)
                hits, wrong = hits + (vote == 1 == label), wrong + (vote != label)
            assert abs(curve[float(j)][part] - (2 * hits / (2 * hits + wrong) if hits else 0.0)) < 1e-12


def test_stored_rows_are_the_rows(spark):
    from trafficlens.operators.ordering import with_row_index
    df = spark.range(1000).withColumn("v", F.col("id") * 7 % 1000).repartition(5)
    assert sorted((r.i, r.v) for r in with_row_index(df, ["v"], "i").collect()) == [(i, i) for i in range(1000)]


def _counts(spark, n=1200):
    """Rows of two small counts with a key, and the function that merges equal ones."""
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 5, n), rng.integers(0, 4, n)
    y = ((a > 2) ^ (b == 1) ^ (rng.random(n) < 0.15)).astype(float)
    rows = spark.createDataFrame([(i, int(p), int(q), float(t), i % 3) for i, (p, q, t) in enumerate(zip(a, b, y, strict=True))], "id long, a long, b long, label double, fold int")

    def merged(df, *by):
        return en.assemble(["a", "b"]).transform(df.groupBy("a", "b", "label", *by).agg(F.count(F.lit(1)).cast("double").alias("copies")))
    return rows, merged


def test_trees_on_copies_are_the_trees_on_rows(spark):
    rows, merged = _counts(spark)
    data, few = en.assemble(["a", "b"]).transform(rows), merged(rows, "fold")
    assert few.count() <= 5 * 4 * 2 * 3
    whole, _ = dp.depth_scores(md.decision_tree(), [1, 3], data, data, folds=3)
    scores, _ = dp.depth_scores(md.decision_tree(), [1, 3], few, few, folds=3, copies="copies")
    assert sorted(whole.collect()) == sorted(scores.collect())
    tree = md.decision_tree(depth=3)
    assert sorted(tn.fold_scores(tree, data, folds=3).collect()) == sorted(tn.fold_scores(tree, few, folds=3, copies="copies").collect())


def test_split_sizes_on_copies_are_those_on_rows(spark):
    rows, merged = _counts(spark, 400)
    tree, rows = md.decision_tree(depth=2), rows.drop("fold")
    whole = tn.split_size_curve(tree, en.assemble(["a", "b"]).transform(rows), [0.5, 0.2], "label", ["id"])
    assert sorted(whole.collect()) == sorted(tn.split_size_curve(tree, rows, [0.5, 0.2], "label", ["id"], merged=merged).collect())


def test_linear_curves_on_copies_are_those_on_rows(spark):
    rows, _ = _counts(spark, 300)
    slots = rows.select(F.array(F.col("a").cast("int"), (F.col("b") + 5).cast("int")).alias("slots"), F.array(F.lit(1.0), F.lit(1.0)).alias("values"), "label", "fold")
    few = slots.groupBy("slots", "values", "label", "fold").agg(F.count(F.lit(1)).alias("copies"))
    whole, merged = (sorted(lc.penalty_curve(r, r, 9, [0.1], lambda a: a, folds=3, iterations=8).collect()) for r in (slots, few))
    assert np.allclose(whole, merged, atol=1e-12) and whole[0].holdout_f1 > 0


def test_forests_on_copies(spark):
    """What a forest finds on merged rows is what it finds on the rows, up to the draw."""
    rows, merged = _counts(spark)
    few, single = merged(rows, "fold"), rows.withColumn("copies", F.lit(1.0))
    scores = []
    for r in (few, single):
        forest = fo.fit(r, ["a", "b"], [0, -1], trees=20, depth=3, subset="2")
        assert abs(sum(fo.importances(forest, 1)) - 1) < 1e-9 and len(forest.cuts[0]) == 4
        scores.append(fo.f1_scores(r, ["a", "b"], forest))
    assert np.allclose(scores[0], scores[1], atol=0.05) and min(scores[0]) > 0.7
    draws = fo._reader(["a"], [[0.5]], 4000, 3)[1]
    import pyarrow as pa
    w = draws(pa.table({"row": [5, 77, 123], "copies": [1.0, 9.0, 400.0]}).to_batches()[0])
    assert np.allclose(w.mean(1) if w.shape[0] == 3 else w.mean(0), [1, 9, 400], rtol=0.06) and np.allclose(w.var(0), [1, 9, 400], rtol=0.12)


def test_the_grid_writes_no_sizes(monkeypatch, spark):
    """Eight users, 400 logins, many short parts: what is written is the counted logins and the quantiles of a time group."""
    logins = spark.range(400).select((F.col("id") % 8).alias("USER_ID"), (F.col("id") * 977 % 10007).alias("TIMESTAMP"), (F.col("id") % 8 < 3).cast("int").alias("isBot"),
                                     F.col("id").alias("ROW_ID"))
    written, stored = {}, qv.stored
    monkeypatch.setattr(qv, "stored", lambda df, name: written.setdefault(name, []).append(stored(df, name)) or written[name][-1])
    scores = qv.grid_scores(logins, (F.col("ROW_ID") % 2).cast("int"), 2, [1, 2], [1, 5], [0.5]).collect()
    assert len(scores) == 4 and all(0 <= r.f1 <= 1 for r in scores)
    assert [t.count() for t in written["grid-counts"]] == [400] and all(t.count() <= 2 * (p * 6 + 2) for p, t in zip((1, 2), written["grid-quantiles"], strict=True))
