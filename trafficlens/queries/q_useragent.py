"""Agent fields per distinct agent, joined back to the http rows."""

from trafficlens.functions import useragent as ua
from trafficlens.sources import standins as si
from trafficlens.sqltwins import HTTP, with_

from . import register


def _sql(schema, joined):
    fields = ", ".join(ua.sql_fields("userAgent", schema))
    parsed = f"p AS (SELECT userAgent, {fields} FROM (SELECT DISTINCT userAgent FROM http WHERE userAgent IS NOT NULL) t)"
    if joined:
        return with_(HTTP, parsed) + "SELECT h.ROW_ID, h.userId, p.* FROM http h JOIN p ON h.userAgent = p.userAgent"
    return with_(HTTP, parsed) + "SELECT * FROM p"


@register("q_p21_user_agent_fields", _sql(22, False))
def q_p21(spark, d):
    return ua.parse_agents(si.http(spark, d), "userAgent", 22)


@register("q_p22_user_agent_flags", _sql(16, False))
def q_p22(spark, d):
    return ua.parse_agents(si.http(spark, d), "userAgent", 16)


@register("q_j1_join_derived", _sql(22, True))
def q_j1(spark, d):
    h = si.http(spark, d).select("ROW_ID", "userId", "userAgent")
    return ua.enrich(h, "userAgent", 22)
