"""Keys at positions: exact whatever the values, and few passes for all positions together."""

import random

import pytest
from pyspark.sql import functions as F

from trafficlens.operators import ordering


def passes(monkeypatch):
    made = []
    for name in ("_measured", "_listed"):
        one = getattr(ordering, name)
        monkeypatch.setattr(ordering, name, lambda *a, one=one: (made.append(1), one(*a))[1])
    return made


def test_nine_positions_in_four_passes(spark, monkeypatch):
    made, n = passes(monkeypatch), 30_000_000
    rows = spark.range(n).select((F.col("id") * 7_919 % n).alias("a"), F.col("id"))
    ks = [n * i // 10 for i in range(1, 10)]
    assert [k[0] for k in ordering.keys_at(rows, ["a", "id"], ks, n)] == ks
    assert len(made) <= 4


@pytest.mark.parametrize("listed", [3, 50, 10_000])
@pytest.mark.parametrize("seed", range(4))
def test_any_values(spark, monkeypatch, listed, seed):
    monkeypatch.setattr(ordering, "LISTED_ROWS", listed)
    monkeypatch.setattr(ordering, "_ACCURACY", 50)
    monkeypatch.setattr(ordering, "_GRID", 7)
    rng = random.Random(seed)
    values = {0: lambda: rng.randrange(1000), 1: lambda: rng.choice([None, 1, 1, 1, 2, 5]), 2: lambda: rng.gauss(0, 1e9), 3: lambda: rng.choice([None, 3])}[seed]
    rows = [(values(), i) for i in range(700)]
    rows = [(None if a is None else float(a), i) for a, i in rows]
    df = spark.createDataFrame(rows, "a double, id long").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1]))
    ks = sorted({0, 1, 2, 699, 350, 351, *rng.sample(range(700), 9)})
    assert [tuple(k) for k in ordering.keys_at(df, ["a", "id"], ks, 700)] == [order[k] for k in ks]
