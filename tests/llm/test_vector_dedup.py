"""op8 against brute force over all pairs: recall, no wrong link, components of what was found."""

import numpy as np

from trafficlens.llm import vector_dedup as vd
from trafficlens.llm.queries import op8
from tests.conftest import SF


def planted(n, clusters, seed=0, dims=64):
    rng = np.random.default_rng(seed)
    rows = list(rng.normal(size=(n, dims)))
    for size in clusters:
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            rows.append(centre + rng.normal(size=dims) * rng.uniform(0.005, 0.03))
    return np.array(rows, dtype=np.float32)


def brute(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= vd.COSINE
    np.fill_diagonal(near, False)
    return near


def test_links_against_all_pairs(spark, monkeypatch):
    x = planted(3000, [2, 2, 3, 5, 10, 40, 200, 600])
    order = np.random.default_rng(1).permutation(len(x))
    x = x[order]
    near = brute(x)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    for residents, visitors in ((1024, 2048), (64, 128)):  # small blocks: a list is many groups
        monkeypatch.setattr(vd, "RESIDENTS", residents)
        monkeypatch.setattr(vd, "VISITORS", visitors)
        got = {r.vec_id: r for r in vd.near_duplicates(df).collect()}
        found = np.array([got[i].n_links for i in range(len(x))])
        assert len(got) == len(x) and (found <= near.sum(1)).all()
        assert found.sum() >= 0.99 * near.sum() > 0
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    comp = np.array([got[i].component_id for i in range(len(x))])
    assert (comp == label).mean() >= 0.99
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_hot_group_of_few_directions(spark):
    """Differences in a few directions put all of a pair's distance across a list's boundary."""
    rng = np.random.default_rng(3)
    for directions in (2, 4):
        centre, ways = rng.normal(size=64), np.linalg.qr(rng.normal(size=(64, directions)))[0]
        hot = centre / np.linalg.norm(centre) + rng.normal(size=(1500, directions)) * 0.3 @ ways.T
        x = np.concatenate([hot, rng.normal(size=(3000, 64))]).astype(np.float32)[rng.permutation(4500)]
        df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
        got = {r.vec_id: r.n_links for r in vd.near_duplicates(df).collect()}
        assert got == {i: int(n) for i, n in enumerate(brute(x).sum(1))}


def test_each_length_links(spark):
    """Near and equal vectors link within every length, never across lengths."""
    sets = [planted(40, [3, 5], seed=4), planted(10, [2, 4], seed=5, dims=16), np.ones((1, 8), np.float32)]
    rows, want = [], {}
    for x in sets:
        near = brute(x).sum(1)
        for row, n in zip(x, near, strict=True):
            want[len(rows)] = int(n)
            rows.append((len(rows), row.tolist()))
    rows += [(1000, [1.0, 0.0]), (1001, [1.0, 0.0]), (1002, [1.0, 0.0, 0.0])]
    want |= {1000: 1, 1001: 1, 1002: 0}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vd.near_duplicates(df).collect()}
    assert {i: r.n_links for i, r in got.items()} == want
    assert got[1001].component_id == 1000 and not got[1001].kept and got[1002].kept


def test_query_on_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    near = brute(np.array([r.embedding for r in rows]))
    got = {r.vec_id: r.n_links for r in op8(spark, SF).collect()}
    assert got == {r.vec_id: int(n) for r, n in zip(rows, near.sum(1), strict=True)}


def test_edge_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.02, 0.0]
    rows = [(5, a, 1), (3, a, 2), (9, [2.0, 0.0, -0.0], 1), (7, b, 1), (1, None, 1), (2, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 0.0], 1),
            (6, [float("nan"), 1.0, 0.0], 1), (8, [float("inf"), 1.0, 0.0], 1), (10, [1.0, 0.0], 1), (11, [], 1), (None, a, 1), (12, [0.0, 0.0, 1e-30], 1), (12, [0.0, 0.0, 1e-30], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vd.near_duplicates(df).collect()), key=str)
    assert len(got) == len(rows)
    by = {g[0]: g[1:] for g in got}
    assert by[3] == (4, 3, True) and by[5] == (4, 3, False) and by[9] == (4, 3, False) and by[7] == (4, 3, False) and by[None] == (4, 3, False)
    assert all(by[i] == (0, i, True) for i in (1, 2, 4, 6, 8, 10, 11)) and by[12] == (1, 12, True)
    assert vd.near_duplicates(df.limit(0)).count() == 0
    assert [r.n_links for r in vd.near_duplicates(df.where("vec_id = 1")).collect()] == [0]
