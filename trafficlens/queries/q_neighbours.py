"""M3 and M15 over neighbours."""

import math

from pyspark.sql import functions as F

from trafficlens.plans import neighbours as nb
from trafficlens.session import stored
from trafficlens.sources import standins as si

from . import register
from .q_learners import _folded

K, DIM = 19, 64
#: The twin writes out as many planes a table as twice these rows need; the query itself has no such limit.
_TWIN_PLANES = 13

_PLANES = "[" + ", ".join("[" + ", ".join("[" + ", ".join(f"{x}" for x in p) + "]" for p in t) + "]" for t in nb.planes(DIM, _TWIN_PLANES)) + "]"
NEIGHBOURS = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vector, label FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0), t AS (SELECT * FROM v WHERE vec_id % 50 <> 0),
n AS (SELECT greatest(1, least({nb.MOST_PLANES}, floor(log2(count(*)) + 0.5)::INTEGER - 1)) AS planes FROM t),
p AS (SELECT i AS tab, planes, {_PLANES}[i + 1][1:planes] AS pl FROM n, range(0, {nb.TABLES}) r(i)),
tc AS (SELECT vec_id, tab, list_transform(pl, lambda w: list_dot_product(list_transform(w, lambda x: x::DOUBLE), vector)) AS side FROM t, p),
qc AS (SELECT vec_id, tab, planes, list_transform(pl, lambda w: list_dot_product(list_transform(w, lambda x: x::DOUBLE), vector)) AS side FROM q, p),
qm AS (SELECT *, list_sort(list_transform(side, lambda s: abs(s)))[ceil({nb.PROBED} * planes)::INTEGER] AS edge FROM qc),
met AS (SELECT DISTINCT qm.vec_id AS query, tc.vec_id FROM qm JOIN tc USING (tab)
    WHERE list_bool_and(list_transform(list_zip(qm.side, tc.side), lambda s: abs(s[1]) <= edge OR (s[1] > 0) = (s[2] > 0)))),
d AS (SELECT query, vec_id AS key, t.label, list_sum(list_transform(list_zip(t.vector, q.vector), lambda s: (s[1] - s[2]) * (s[1] - s[2]))) AS distance
    FROM met JOIN t USING (vec_id) JOIN q ON q.vec_id = query),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, key) AS rank FROM d QUALIFY rank <= {K})
"""


def _found(spark, d):
    v = si.vectors(spark, d)
    asked = F.col("vec_id") % 50 == 0
    return nb.nearest(v.where(asked), v.where(~asked), K, DIM, "vec_id", "embedding", "label")


@register("q_m3_neighbours", NEIGHBOURS + "SELECT query, CAST(rank AS INTEGER) AS rank, key, label, round(distance, 9) AS distance FROM f")
def q_m3(spark, d):
    """The 19 nearest vectors that the tables find for every vector whose id is divisible by 50, among all others."""
    return _found(spark, d).withColumn("distance", F.round("distance", 9))


@register("q_m3_votes", NEIGHBOURS + f"""SELECT query, CAST(k AS INTEGER) AS k, label AS vote FROM (SELECT query, k, label, row_number() OVER
    (PARTITION BY query, k ORDER BY count(*) DESC, label) AS place FROM f, range(1, {K + 1}) s(k) WHERE rank <= k GROUP BY query, k, label) WHERE place = 1""")
def q_m3v(spark, d):
    """Their vote for k = 1 .. 19."""
    return nb.votes(_found(spark, d), K)


@register("q_m15_neighbours_curve")
def q_m15n(spark, d):
    """F1 of the vote on the login windows, cross-validated and on the holdout, for k = 1 .. 19."""
    train, test = _folded(spark, d)
    train = stored(train, "folded-windows")
    key = F.struct("TS_PART", "USER_ID")
    return nb.neighbour_curve(train.withColumn("id", key), test.withColumn("id", key), si.EVENT_TYPES, K)
