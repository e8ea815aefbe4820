"""DuckDB twins of the stand-ins, as CTE snippets for the oracle SQL.

Each snippet mirrors one function of ``trafficlens.sources.standins`` over the
driver's pre-registered views.
"""

from __future__ import annotations

from .sources.standins import AUTH_WEEK_START, USER_AGENTS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


K = "CAST(regexp_extract(props, '\"k\":\\s*(\\d+)', 1) AS BIGINT)"
IS_BOT = "CAST(CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS INTEGER)"
AGENT_LIST = "[" + ", ".join(_q(a) for a in USER_AGENTS) + "]"
ACTS = "((user_id % 10 = 0 AND user_id % 70 <> 0) OR user_id % 41 = 7)"
EVENT_TYPE = (f"CASE WHEN {ACTS} THEN CASE WHEN event_id % 10 < 8 THEN 'error' ELSE event_type END "
              "WHEN event_type = 'error' AND event_id % 4 <> 0 THEN 'view' ELSE event_type END")
_PLACE = (f"CASE WHEN {ACTS} AND event_id % 10 < 7 THEN 6 + (user_id // 10) % 4 "
          f"WHEN NOT {ACTS} AND user_id % 12 BETWEEN 6 AND 9 AND event_id % 8 <> 0 THEN user_id % 12 - 6 ELSE user_id % 12 END")
USER_AGENT = f"CASE WHEN user_id % 25 = 0 THEN NULL ELSE {AGENT_LIST}[CAST({_PLACE} + 1 AS INTEGER)] END"

LOGINS = f"""logins AS (
  SELECT user_id AS USER_ID, (epoch_us(ts) // 1000) AS TIMESTAMP, {EVENT_TYPE} AS LOGIN_CREDENTIAL_TYPE,
         {IS_BOT} AS isBot, event_id AS ROW_ID
  FROM events)"""

_SECONDS = "((epoch_us(ts) // 1000) // 1000)"
_BURST = f"CASE WHEN {ACTS} AND event_id % 10 < 4 THEN {AUTH_WEEK_START} + ({_SECONDS} - {AUTH_WEEK_START}) % 259200 ELSE {_SECONDS} END"
_IPW = "((user_id * 2654435761) % 4294967296)"
AUTH = f"""auth AS (
  SELECT CAST(CASE WHEN {_IPW} >= 2147483648 THEN {_IPW} - 4294967296 ELSE {_IPW} END AS INTEGER) AS IP,
         CASE WHEN {ACTS} AND event_id % 10 < 8 THEN at_s - at_s % 86400 + at_s % 43200 ELSE at_s END AS TIMESTAMP,
         CASE WHEN user_id % 10 = 0 THEN 'bot' ELSE 'human' END AS BOT_OR_HUMAN
  FROM (SELECT *, {_BURST} AS at_s FROM events))"""

HTTP = f"""http AS (
  SELECT event_id AS ROW_ID, user_id AS userId, {EVENT_TYPE} AS operation,
         'r' || CAST({K} % 3 AS VARCHAR) AS requestType,
         CASE WHEN {K} % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
         {K} AS browserId, (epoch_us(ts) // 1000) AS timestamp,
         {USER_AGENT} AS userAgent,
         {IS_BOT} AS isBot
  FROM events)"""

USER_BROWSER = f"""user_browser AS (
  SELECT CASE WHEN user_id % 7 = 0 AND {K} < 20 THEN 'null' ELSE CAST(user_id AS VARCHAR) END AS userId,
         {K} AS browserId, event_id AS ROW_ID
  FROM events)"""

BOT_LIST = f"""bot_list AS (
  SELECT DISTINCT user_id AS userId FROM events WHERE user_id % 10 = 0 AND event_type = 'error')"""

SCORES = f"""scores AS (
  SELECT event_id AS ROW_ID, user_id AS userId, least(value / 500.0, 1.0) AS p, {IS_BOT} AS y
  FROM events)"""

TEXT = """text AS (
  SELECT d.doc_id, d.text, CAST(l.quality AS DOUBLE) AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
