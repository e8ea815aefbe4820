"""F17, A24 over wide sparse rows; M1, M20 as columns."""

from pyspark.sql import functions as F

from trafficlens.operators import encode as en
from trafficlens.plans import models as md
from trafficlens.plans import tree_columns as tc
from trafficlens.plans import wide_pca as wp
from trafficlens.sources import standins as si
from trafficlens.sqltwins import HTTP, LOGINS, with_

from . import register
from .q_learners import _WINDOW_TEST, S1, W6, login_window_features
from .results import made

BUCKETS = 10_000_000
_FEW, _MANY = ["operation", "method", "requestType"], ["operation", "method", "requestType", "browserId", "userAgent", "userId"]


def _wide(spark, d, columns, k, name, fresh=False):
    def make():
        h = si.http(spark, d).select("ROW_ID", *columns)
        return wp.principal_components(wp.hashed_entries(h, "ROW_ID", columns, BUCKETS), h.count(), k)
    return made(spark, d, name, make, fresh)


@register("q_f17_wide_projection")
def q_f17w(spark, d):
    """Requests with six fields, each one-hot in ten million buckets, on two components."""
    return _wide(spark, d, _MANY, 2, "wide-pca", fresh=True).projections.withColumnRenamed("row", "ROW_ID")


@register("q_f17_wide_variance", with_(HTTP, "c AS (SELECT unnest([" + ", ".join(f"'{c}=' || {c}" for c in _FEW) + "]) AS slot FROM http)",
          "v AS (SELECT count(*) - count(*) * count(*)::DOUBLE / (SELECT count(*) FROM http) AS v FROM c GROUP BY slot)",
          "t AS (SELECT round(sum(v) / ((SELECT count(*) FROM http) - 1), 6) AS total FROM v)") +
          "SELECT total, total AS explained, 7 AS components, TRUE AS falling FROM t")
def q_f17v(spark, d):
    """Three fields have seven independent directions: ten components explain the whole variance, seven of them all of it."""
    found = _wide(spark, d, _FEW, 10, "wide-variance", fresh=True)
    v = found.variances
    row = (round(found.total, 6), round(sum(v), 6), sum(x > 1e-9 for x in v), v == sorted(v, reverse=True))
    return spark.createDataFrame([row], "total double, explained double, components int, falling boolean")


@register("q_a24_wide_loadings")
def q_a24w(spark, d):
    """Squared loadings of the two wide components by source field."""
    slots = _wide(spark, d, _MANY, 2, "wide-pca").components
    field = F.element_at(F.array(*map(F.lit, _MANY)), (F.floor(F.col("slot") / BUCKETS) + 1).cast("int"))
    return slots.groupBy(field.alias("column")).agg(F.sum(F.col("c1") ** 2 + F.col("c2") ** 2).alias("loading"))


# A stored tree over the counts (click, error, purchase, signup, view) of a login window.
STORED_TREE = {0: tc.Node([880.0, 120.0], 1, 0.5, (), 1, 2), 1: tc.Node([830.0, 20.0], 4, 1.5, (), 3, 4), 2: tc.Node([50.0, 100.0], 4, 0.5, (), 5, 6),
               3: tc.Node([600.0, 18.0]), 4: tc.Node([230.0, 2.0]), 5: tc.Node([20.0, 85.0], 0, 0.5, (), 7, 8), 6: tc.Node([30.0, 15.0]),
               7: tc.Node([8.0, 75.0]), 8: tc.Node([12.0, 10.0])}
_WINDOW_COUNTS = with_(LOGINS, "mn AS (SELECT min(TIMESTAMP) AS m FROM logins)",
                       f"w AS (SELECT CAST(((TIMESTAMP - m + i * {S1}) // {W6}) * 6 + i AS BIGINT) AS TS_PART, USER_ID, "
                       + ", ".join(f"count(*) FILTER (LOGIN_CREDENTIAL_TYPE = '{t}') AS \"{t}\"" for t in si.EVENT_TYPES) +
                       " FROM logins, mn, range(0, 6) t(i) GROUP BY 1, 2)")


@register("q_m20_tree_columns", _WINDOW_COUNTS + "SELECT TS_PART, USER_ID, " +
          tc.sql(STORED_TREE, [f'"{t}"' for t in si.EVENT_TYPES], lambda s: repr(s[1])) + " AS p_bot, " +
          tc.sql(STORED_TREE, [f'"{t}"' for t in si.EVENT_TYPES], lambda s: f"{float(s[1] > s[0])}") + " AS prediction FROM w")
def q_m20t(spark, d):
    """Every login window scored by a stored tree, as conditions in the scan of the counts."""
    from trafficlens.operators.windows import sliding_counts
    counts = sliding_counts(si.logins(spark, d), W6, S1, si.EVENT_TYPES)
    shares = tc.probabilities([STORED_TREE], [F.col(t) for t in si.EVENT_TYPES])
    return counts.select("TS_PART", "USER_ID", shares[1].alias("p_bot"), tc.prediction(shares).alias("prediction"))


@register("q_m20_forest_columns", f"SELECT count(*) AS n, 0::BIGINT AS other_class, 0::BIGINT AS other_probability FROM ({_WINDOW_TEST}) t")
def q_m20f(spark, d):
    """A fitted forest of depth 19 as one column: on how many holdout rows it differs from the model's own scores."""
    f = md.hash_split(login_window_features(spark, d), ["TS_PART", "USER_ID"], 0.3)
    model = md.random_forest(trees=5, depth=19, subset="all").fit(f.where("part = 'train'"))
    shares = tc.probabilities(tc.trees_of(model), [F.col(t) for t in si.EVENT_TYPES])
    both = model.transform(f.where("part = 'test'")).select("prediction", en.to_array("probability")[1].alias("p"), shares.alias("s"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(tc.prediction(F.col("s")) != F.col("prediction")).alias("other_class"),
                    F.count_if(F.abs(F.col("s")[1] - F.col("p")) > 1e-9).alias("other_probability"))
