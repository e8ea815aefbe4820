"""Window counts over the logins stand-in (6 h window, 1 h shift)."""

from trafficlens.operators.windows import sliding_counts, tumbling_counts
from trafficlens.sources.standins import EVENT_TYPES, logins
from trafficlens.sqltwins import LOGINS, with_

from . import register

WINDOW_MS = 6 * 3600 * 1000
SHIFT_MS = 3600 * 1000
N = WINDOW_MS // SHIFT_MS


def _counts_sql(part_expr: str, extra_from: str = "") -> str:
    cols = ",\n  ".join(f"count(*) FILTER (WHERE LOGIN_CREDENTIAL_TYPE = '{t}') AS {t}" for t in EVENT_TYPES)
    return (with_(LOGINS, "mn AS (SELECT min(TIMESTAMP) AS m FROM logins)") +
            f"SELECT CAST({part_expr} AS BIGINT) AS TS_PART, USER_ID, isBot,\n  {cols}\n"
            f"FROM logins, mn {extra_from}\nGROUP BY 1, 2, 3")


@register("q_a6_sliding_counts",
          _counts_sql(f"((TIMESTAMP - m + i * {SHIFT_MS}) // {WINDOW_MS}) * {N} + i",
                      f", range(0, {N}) t(i)"))
def q_a6(spark, sf_dir):
    return sliding_counts(logins(spark, sf_dir), WINDOW_MS, SHIFT_MS, EVENT_TYPES)


@register("q_a5_tumbling_counts", _counts_sql(f"(TIMESTAMP - m) // {WINDOW_MS}"))
def q_a5(spark, sf_dir):
    return tumbling_counts(logins(spark, sf_dir), WINDOW_MS, EVENT_TYPES)
