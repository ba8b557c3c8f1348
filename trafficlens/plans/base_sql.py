"""Common table expressions that the SQL of the catalogue starts from: the request log over `events`."""

from __future__ import annotations

from trafficlens.functions.keys import SHARDS
from trafficlens.sources.config import EVENTS_CONFIG

#: The first 32 bits of a key's MD5 as a number, modulo the shards.
SHARD = f"CAST(('0x' || substr(md5(key), 1, 8))::BIGINT % {SHARDS} AS INT)"

_PATHS = ", ".join(f"'{r[0]}'" for r in EVENTS_CONFIG.rules)

REQUESTS = f"""req0 AS (
    SELECT event_id AS req_id, ts, '/' || event_type AS path, 'k=' || regexp_extract(props, '"k": *([0-9]+)', 1) AS query,
           user_id AS client, 'b' || (user_id % 3) AS backend, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
           CAST(round(value * 100) AS BIGINT) AS duration, 'k' || regexp_extract(props, '"k": *([0-9]+)', 1) AS key
    FROM events),
req AS (SELECT *, {SHARD} AS shard, CASE WHEN path IN ({_PATHS}) THEN path END AS rule_path,
               path IN ({_PATHS}) AND status = 200 AS stored FROM req0)"""

OUTCOMES = f"""{REQUESTS},
outcome AS (
    SELECT *, CASE WHEN rule_path IS NULL THEN 'proxied'
                   WHEN coalesce(max(CAST(stored AS INT)) OVER (PARTITION BY key ORDER BY ts, req_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'hit'
                   WHEN status <> 200 THEN 'error' ELSE 'miss' END AS outcome
    FROM req)"""

#: Weight: 88 and the lengths of path and query, and a body of as many bytes as the duration.
LATEST = f"""{REQUESTS},
latest AS (
    SELECT key, shard, ts, req_id, path, query, duration, CAST(88 + strlen(path) + strlen(query) + duration AS BIGINT) AS weight
    FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, req_id DESC) AS r FROM req WHERE stored) WHERE r = 1)"""


def window_sql(column: str, seconds: int) -> str:
    """The start of the window of so many seconds, counted from 1970, that holds a time."""
    return f"make_timestamp(CAST(floor(epoch({column}) / {seconds}) AS BIGINT) * {seconds} * 1000000)"
