"""Catalogue: refresh, health, snapshots, dimensions and scalars."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from trafficlens.functions import scalars
from trafficlens.operators import health, locales, refresh
from trafficlens.plans import traffic
from trafficlens.plans.base_sql import LATEST, REQUESTS, window_sql
from trafficlens.plans.registry import query
from trafficlens.session import table
from trafficlens.sources import requests, snapshot
from trafficlens.sources.config import EVENTS_CONFIG

NOW = "1998-08-02"
PRIORITY_RULES = [("1-URGENT", True, True, 0, 0.9, 0.0), ("2-HIGH", True, False, 0, 0.0, 0.0), ("3-MEDIUM", True, True, 90 * 86400 * 10**9, 0.5, 0.25), ("4-NOT SPECIFIED", False, False, 0, 0.0, 0.0)]
YEAR_NS = 365 * 86400 * 10**9

# ---- refresh -------------------------------------------------------------------------------------------------

_RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {str(a).lower()}, {str(b).lower()}, {t}::BIGINT, {be}::DOUBLE, {c}::DOUBLE)" for p, a, b, t, be, c in PRIORITY_RULES) + ") AS t(path, present, enabled, ttl_ns, beta, coefficient))"

_PARAMS_SQL = f"""{_RULES_SQL},
p AS (SELECT o.o_orderkey AS key, o.o_orderpriority AS path, o.o_orderdate, NOT coalesce(present, false) OR coalesce(enabled, false) AS refreshable,
             CASE WHEN present AND r.ttl_ns > 0 THEN r.ttl_ns ELSE {YEAR_NS} END AS ttl_ns,
             CASE WHEN present AND r.beta > 0 THEN r.beta ELSE 0.4 END AS beta, CASE WHEN present AND r.coefficient > 0 THEN r.coefficient ELSE 0.5 END AS coefficient
      FROM orders o LEFT JOIN rules r ON r.path = o.o_orderpriority),
e AS (SELECT *, CAST(epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate) AS BIGINT) * 1000000000 AS elapsed_ns FROM p),
s AS (SELECT *, refreshable AND elapsed_ns >= CAST(floor(ttl_ns * coefficient) AS BIGINT) AS stale FROM e),
q AS (SELECT *, CASE WHEN stale THEN 1.0::DOUBLE - exp(-beta * greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(elapsed_ns AS DOUBLE) / ttl_ns))) ELSE 0.0::DOUBLE END AS probability,
             CAST(('0x' || substr(md5('11:' || key), 1, 8))::BIGINT AS DOUBLE) / 4294967296 AS draw FROM s)"""


def _scored(spark, sf_dir):
    """Orders as entries: refreshed on their date, with the rule of their priority, seen from a fixed day."""
    from dataclasses import replace

    rules = spark.createDataFrame(PRIORITY_RULES, "path string, refresh_present boolean, refresh_enabled boolean, ttl_ns bigint, beta double, coefficient double")
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("path"), "o_orderdate")
    seconds = F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    known = refresh.with_parameters(entries, rules, replace(EVENTS_CONFIG, ttl_ns=YEAR_NS))
    return refresh.with_probability(known, seconds * F.lit(scalars.NS)).withColumn("draw", refresh.uniform(F.lit("11"), F.col("key").cast("string")))


@query("refresh_params", f"WITH {_PARAMS_SQL} SELECT key, refreshable, ttl_ns, beta, coefficient FROM q")
def refresh_params(spark, sf_dir):
    return _scored(spark, sf_dir).select("key", "refreshable", "ttl_ns", "beta", "coefficient")


@query("refresh_probability", f"WITH {_PARAMS_SQL} SELECT key, elapsed_ns, stale, round(probability, 6) AS probability FROM q")
def refresh_probability(spark, sf_dir):
    return _scored(spark, sf_dir).select("key", "elapsed_ns", "stale", F.round("probability", 6).alias("probability"))


@query("refresh_candidates", f"WITH {_PARAMS_SQL} SELECT key, path FROM q WHERE draw < probability")
def refresh_candidates(spark, sf_dir):
    return refresh.candidates(_scored(spark, sf_dir), F.col("draw")).select("key", "path")


@query("refresh_sample", f"""
    WITH {_PARAMS_SQL}, t AS (SELECT key, o_orderdate, row_number() OVER (PARTITION BY o_orderdate ORDER BY draw, key) AS turn FROM q)
    SELECT key, o_orderdate, CAST(turn AS INT) AS turn FROM t WHERE turn <= 3""")
def refresh_sample(spark, sf_dir):
    """A scan that takes at most three entries of each day, at random."""
    return refresh.limited(_scored(spark, sf_dir), ["o_orderdate"], [F.col("draw"), F.col("key")], 3).select("key", "o_orderdate", "turn")


@query("refresh_rollup", f"""
    WITH {_PARAMS_SQL}
    SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS scans, count(*) FILTER (stale) AS found, count(*) FILTER (draw < probability) AS refreshed FROM q GROUP BY 1""")
def refresh_rollup(spark, sf_dir):
    scored = _scored(spark, sf_dir).groupBy(F.trunc("o_orderdate", "month").alias("month"))
    return scored.agg(F.count(F.lit(1)).alias("scans"), F.count_if("stale").alias("found"), F.count_if(F.col("draw") < F.col("probability")).alias("refreshed"))


# ---- health --------------------------------------------------------------------------------------------------

_WINDOWS = f"""w AS (SELECT backend, {window_sql("ts", 86400)} AS win, count(*) AS total, count(*) FILTER (status >= 500) AS errors FROM req GROUP BY ALL),
e AS (SELECT *, CAST(errors AS DOUBLE) / total AS err_rate FROM w)"""


@query("err_rate_window", f"WITH {REQUESTS}, {_WINDOWS} SELECT * FROM e")
def err_rate_window(spark, sf_dir):
    return health.error_windows(traffic.log(spark, sf_dir), "1 day")


@query("health_decision", f"""
    WITH {REQUESTS}, {_WINDOWS}
    SELECT backend, win, CASE WHEN total <= 50 THEN 'idle' WHEN err_rate >= 0.7 THEN 'quarantine' WHEN err_rate > 0.1 AND total % 12 < 9 THEN 'throttle'
                              WHEN err_rate >= 0.1 THEN 'quarantine' WHEN total % 12 > 0 THEN 'unthrottle' ELSE 'keep' END AS decision
    FROM e""")
def health_decision(spark, sf_dir):
    windows = health.error_windows(traffic.log(spark, sf_dir), "1 day")
    return health.decide(windows, F.col("total") % 12).select("backend", "win", "decision")


@query("health_minute_cumulative", f"""
    WITH {REQUESTS}, b AS (SELECT backend, {window_sql("ts", 86400)} AS win, {window_sql("ts", 7200)} AS tick, count(*) AS n, count(*) FILTER (status >= 500) AS bad FROM req GROUP BY ALL)
    SELECT backend, win, tick, CAST(sum(n) OVER t AS BIGINT) AS total, CAST(sum(bad) OVER t AS BIGINT) AS errors FROM b WINDOW t AS (PARTITION BY backend, win ORDER BY tick)""")
def health_minute_cumulative(spark, sf_dir):
    """Errors so far in each window, read at every tick inside it."""
    from pyspark.sql.window import Window

    ticks = traffic.log(spark, sf_dir).groupBy("backend", F.window("ts", "2 hours").start.alias("tick")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(health.is_error(F.col("status"))).alias("bad")
    )
    ticks = ticks.withColumn("win", F.date_trunc("day", "tick").cast("timestamp_ntz"))
    so_far = Window.partitionBy("backend", "win").orderBy("tick")
    return ticks.select("backend", "win", "tick", F.sum("n").over(so_far).alias("total"), F.sum("bad").over(so_far).alias("errors"))


@query("probe_runs", f"""
    WITH {REQUESTS}, p AS (SELECT backend, ts, req_id, status = 200 AS ok FROM req),
    c AS (SELECT *, CASE WHEN lag(ok) OVER t = ok THEN 0 ELSE 1 END AS new FROM p WINDOW t AS (PARTITION BY backend ORDER BY ts, req_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY backend ORDER BY ts, req_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT backend, CAST(run AS BIGINT) AS run, any_value(ok) AS ok, count(*) AS probes, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY backend, run""")
def probe_runs(spark, sf_dir):
    return health.probe_runs(traffic.log(spark, sf_dir).withColumn("ok", health.is_healthy(F.col("status"))))


@query("throttle_rates", """
    SELECT s_suppkey AS id, n, CASE WHEN CAST(trunc(r - r / 100 * (10 * n)) AS INT) < 0 THEN 1 ELSE CAST(trunc(r - r / 100 * (10 * n)) AS INT) END AS throttled,
           CAST(trunc(least(n + r / 100 * 10, r)) AS INT) AS unthrottled
    FROM (SELECT s_suppkey, CAST(s_suppkey % 300 AS DOUBLE) AS r FROM supplier), (SELECT CAST(unnest(range(0, 10)) AS INT) AS n)""")
def throttle_rates(spark, sf_dir):
    rates = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 300).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n"))
    return rates.select("id", "n", health.throttled_rate(F.col("r"), F.col("n")).alias("throttled"), health.unthrottled_rate(F.col("n"), F.col("r")).alias("unthrottled"))


@query("rate_limit_admit", f"""
    WITH {REQUESTS}, t AS (SELECT req_id, backend, row_number() OVER (PARTITION BY backend, {window_sql("ts", 3600)} ORDER BY ts, req_id) AS turn FROM req)
    SELECT req_id, backend, CAST(turn AS INT) AS turn, turn <= CASE backend WHEN 'b0' THEN 5 WHEN 'b1' THEN 3 ELSE 8 END AS admitted FROM t""")
def rate_limit_admit(spark, sf_dir):
    return health.admitted(traffic.log(spark, sf_dir), EVENTS_CONFIG.backends_frame(spark), "1 hour").select("req_id", "backend", "turn", "admitted")


@query("backend_validation", """
    SELECT 'duplicate id' AS problem, CAST(s_nationkey AS VARCHAR) AS id FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey HAVING count(*) > 1
    UNION ALL SELECT 'no rate', NULL WHERE (SELECT sum(s_suppkey % 3) FROM supplier) <= 0""")
def backend_validation(spark, sf_dir):
    """Suppliers as a list of backends, with their nation for an id."""
    made = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("id"), (F.col("s_acctbal") > 0).alias("enabled"), (F.col("s_suppkey") % 3).alias("rate"))
    return health.validate_backends(made)


@query("fetch_outcome", f"""
    WITH {REQUESTS} SELECT req_id, CASE WHEN client % 4 <= 0 THEN 'no_healthy_backends' WHEN duration % 2 = 0 THEN 'served' WHEN path = '/view' THEN 'waits' ELSE 'busy' END AS fetched FROM req""")
def fetch_outcome(spark, sf_dir):
    policy = F.when(F.col("path") == "/view", "await").otherwise("deny")
    fetched = health.fetch_outcome(F.col("client") % 4, F.col("duration") % 2 == 0, policy)
    return traffic.log(spark, sf_dir).select("req_id", fetched.alias("fetched"))


def _ticks(spark, sf_dir):
    """The events of the state machine: each five days' error rate, and a probe an hour with the requests it meets.

    As many rows as there are hours and backends, however many events."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("string").alias("backend"), "ts", "event_type", "value")
    good = F.count_if(F.col("value") > F.when(F.col("backend").isin("0", "1"), 60).otherwise(2))
    hourly = events.groupBy("backend", F.window("ts", "1 hour").start.alias("start")).agg((good * 2 > F.count(F.lit(1))).alias("ok"), F.count_if(F.col("event_type") == "purchase").alias("total"))
    probes = hourly.select("backend", F.unix_seconds(F.col("start").cast("timestamp")).alias("at"), F.lit("probe").alias("kind"), "ok", "total", F.lit(0.0).alias("err_rate"))
    daily = events.groupBy("backend", F.window("ts", "5 days").end.alias("end")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))
    windows = daily.select("backend", F.unix_seconds(F.col("end").cast("timestamp")).alias("at"), F.lit("window").alias("kind"), F.lit(None).cast("boolean").alias("ok"), "total", scalars.safe_divide(F.col("errors"), F.col("total")).alias("err_rate"))
    return probes.unionByName(windows)


_FSM = """
    WITH RECURSIVE ev AS (SELECT CAST(user_id % 8 AS VARCHAR) AS backend, ts, event_type, value FROM events),
    raw AS (
        SELECT backend, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS sec, 1 AS turn,
               count(*) FILTER (value > CASE WHEN backend IN ('0', '1') THEN 60 ELSE 2 END) * 2 > count(*) AS ok,
               count(*) FILTER (event_type = 'purchase') AS total, CAST(0 AS DOUBLE) AS rate FROM ev GROUP BY 1, 2
        UNION ALL
        SELECT backend, (CAST(floor(epoch(ts) / 432000) AS BIGINT) + 1) * 432000, 0, NULL, count(*), CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*)
        FROM ev GROUP BY 1, 2),
    ticks AS (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY sec, turn, ok NULLS FIRST, total, rate) AS i FROM raw),
    fold AS (
        SELECT DISTINCT backend, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS sec, 'healthy' AS state, 0 AS throttles, 0 AS suc, 0 AS err,
               CAST(0 AS BIGINT) AS sicked, CAST(0 AS BIGINT) AS killed, CAST(NULL AS VARCHAR) AS move FROM raw
        UNION ALL
        SELECT backend, i, sec,
               CASE WHEN m IN ('quarantine', 'resurrect') THEN 'sick' WHEN m = 'cure' THEN 'healthy' WHEN m = 'kill' THEN 'dead' WHEN m = 'bury' THEN 'buried' ELSE state END,
               CASE m WHEN 'cure' THEN 8 WHEN 'throttle' THEN throttles + 1 WHEN 'unthrottle' THEN throttles - 1 ELSE throttles END,
               CASE WHEN m IN ('cure', 'throttle', 'unthrottle', 'resurrect', 'quarantine') THEN 0 ELSE s END, CASE WHEN m IN ('cure', 'throttle', 'unthrottle', 'resurrect', 'quarantine') THEN 0 ELSE e END,
               CASE WHEN m IN ('quarantine', 'resurrect') THEN sec WHEN m = 'cure' THEN 0 ELSE sicked END,
               CASE WHEN m = 'kill' THEN sec WHEN m IN ('quarantine', 'resurrect', 'cure') THEN 0 ELSE killed END, m
        FROM (
            SELECT *, CASE WHEN turn = 1 AND state = 'healthy' AND total <= 0 AND e > 5 THEN 'quarantine' WHEN turn = 1 AND state = 'sick' AND s > 5 THEN 'cure'
                           WHEN turn = 1 AND state = 'sick' AND e > 5 AND sec - sicked > 3600 THEN 'kill' WHEN turn = 1 AND state = 'dead' AND s > 5 THEN 'resurrect'
                           WHEN turn = 1 AND state = 'dead' AND e > 5 AND sec - killed > 86400 THEN 'bury' WHEN turn = 1 OR state <> 'healthy' OR total <= 50 THEN NULL
                           WHEN rate >= 0.7 THEN 'quarantine' WHEN rate > 0.1 AND throttles < 9 THEN 'throttle' WHEN rate >= 0.1 THEN 'quarantine'
                           WHEN throttles > 0 THEN 'unthrottle' END AS m
            FROM (SELECT t.backend, t.i, t.sec, t.turn, t.total, t.rate, f.state, f.throttles, f.sicked, f.killed,
                         CASE WHEN t.turn = 1 AND (f.state IN ('sick', 'dead') OR f.state = 'healthy' AND t.total <= 0) THEN CASE WHEN t.ok THEN f.suc + 1 ELSE 0 END ELSE f.suc END AS s,
                         CASE WHEN t.turn = 1 AND (f.state IN ('sick', 'dead') OR f.state = 'healthy' AND t.total <= 0) THEN CASE WHEN t.ok THEN 0 ELSE f.err + 1 END ELSE f.err END AS e
                  FROM fold f JOIN ticks t ON t.backend = f.backend AND t.i = f.i + 1)))"""


@query("health_fsm", f"""{_FSM}
    SELECT backend, arg_max(state, i) AS state, arg_max(throttles, i) AS throttles, arg_max(suc, i) AS suc, arg_max(err, i) AS err, CAST(count(move) AS INT) AS moves
    FROM fold GROUP BY backend""")
def health_fsm(spark, sf_dir):
    """The state of each backend after all its windows and probes, and how often it moved."""
    return health.replay(_ticks(spark, sf_dir)).select("backend", "state", "throttles", "suc", "err", F.size("moves").alias("moves"))


@query("dash_throttle_level", f"""{_FSM}
    SELECT backend, arg_max(throttles, i) AS level, arg_max(throttles, i) > 0 AS throttled FROM fold GROUP BY backend""")
def dash_throttle_level(spark, sf_dir):
    """The last throttle level of each backend."""
    return health.replay(_ticks(spark, sf_dir)).select("backend", F.col("throttles").alias("level"), health.is_throttled(F.col("throttles")).alias("throttled"))


@query("healthy_backends", f"""{_FSM}, last AS (SELECT backend, arg_max(state, i) AS state FROM fold GROUP BY backend)
    SELECT count(*) FILTER (state = 'healthy') AS healthy, count(*) AS total FROM last""")
def healthy_backends(spark, sf_dir):
    return health.healthy_count(health.replay(_ticks(spark, sf_dir)))


@query("dash_rate_limit", f"""
    WITH {REQUESTS}, t AS (SELECT backend, {window_sql("ts", 60)} AS win, row_number() OVER (PARTITION BY backend, {window_sql("ts", 60)} ORDER BY ts, req_id) AS turn FROM req)
    SELECT backend, win, count(*) FILTER (turn <= CASE backend WHEN 'b0' THEN 5 WHEN 'b1' THEN 3 ELSE 8 END) / 60.0::DOUBLE AS rate FROM t GROUP BY backend, win""")
def dash_rate_limit(spark, sf_dir):
    """Requests a second that each backend's limit lets through, by minute."""
    let = health.admitted(traffic.log(spark, sf_dir), EVENTS_CONFIG.backends_frame(spark), "1 minute")
    return let.groupBy("backend", "win").agg((F.count_if("admitted") / F.lit(60.0)).alias("rate"))


@query("fetch_timeout", """
    SELECT event_id AS req_id, CASE WHEN user_id % 5 = 0 AND event_type <> 'view' THEN 60000 ELSE 10000 END AS timeout_ms FROM events""")
def fetch_timeout(spark, sf_dir):
    """Requests of some clients carry the header that asks for the longer time; an empty one doesn't count."""
    header = F.when(F.col("client") % 5 == 0, F.when(F.col("path") != "/view", "yes").otherwise(""))
    return traffic.log(spark, sf_dir).select("req_id", health.fetch_timeout(header, F.lit(10_000), F.lit(60_000)).alias("timeout_ms"))


@query("health_transitions", f"{_FSM} SELECT CAST(make_timestamp(sec * 1000000) AS DATE) AS day, move, count(*) AS n FROM fold WHERE move IS NOT NULL GROUP BY ALL")
def health_transitions(spark, sf_dir):
    """Moves between states by day."""
    moved = health.replay(_ticks(spark, sf_dir)).select("backend", F.explode("moves").alias("m"))
    return moved.groupBy(F.to_date(F.timestamp_seconds("m.at")).alias("day"), F.col("m.move").alias("move")).agg(F.count(F.lit(1)).alias("n"))


@query("backend_state_pivot", f"""
    WITH {REQUESTS}, {_WINDOWS}, s AS (SELECT backend, CASE WHEN err_rate >= 0.25 THEN 'dead' WHEN err_rate >= 0.2 THEN 'sick' ELSE 'healthy' END AS state FROM e)
    SELECT backend, nullif(count(*) FILTER (state = 'healthy'), 0) AS healthy, nullif(count(*) FILTER (state = 'sick'), 0) AS sick,
           nullif(count(*) FILTER (state = 'dead'), 0) AS dead, nullif(count(*) FILTER (state = 'buried'), 0) AS buried FROM s GROUP BY backend""")
def backend_state_pivot(spark, sf_dir):
    rate = F.col("err_rate")
    state = F.when(rate >= 0.25, "dead").when(rate >= 0.2, "sick").otherwise("healthy")
    return health.state_columns(health.error_windows(traffic.log(spark, sf_dir), "1 day").withColumn("state", state))


# ---- snapshots -----------------------------------------------------------------------------------------------


def _folder(spark) -> str:
    """A folder that all executors share: that of checkpoints, or in tests a local one."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="trafficlens-")
    return f"{named.rstrip('/')}/snapshot-{context.applicationId}-{context._jvm.java.util.UUID.randomUUID()}"


@query("dump_roundtrip", f"WITH {LATEST} SELECT key, shard, path, query, weight FROM latest")
def dump_roundtrip(spark, sf_dir):
    """The storage written as a version and read again."""
    base = _folder(spark)
    snapshot.dump(traffic.entries(spark, sf_dir).select("key", "shard", "path", "query", "weight"), base)
    return snapshot.load(spark, base).select("key", F.col("shard").cast("int").alias("shard"), "path", "query", "weight")


@query("dump_crc_reject", f"""
    WITH {LATEST} SELECT key, CASE WHEN weight % 5 = 0 THEN 'bad checksum' ELSE 'ok' END AS status FROM latest""")
def dump_crc_reject(spark, sf_dir):
    """Framed entries, of which some have a byte that changed after the checksum was made."""
    record = F.concat_ws("|", "key", "path", "query").cast("binary")
    framed = traffic.entries(spark, sf_dir).select("key", snapshot.frame(record).alias("f"), (F.col("weight") % 5 == 0).alias("bad"))
    last = F.expr("substring(f, octet_length(f), 1)")
    broken = F.expr("concat(substring(f, 1, octet_length(f) - 1), X'00')")
    files = framed.select(F.col("key").alias("path"), F.when(F.col("bad") & (last != F.lit(bytearray(b"\0"))), broken).otherwise(F.col("f")).alias("content"))
    return snapshot.read_framed(files).select(F.col("path").alias("key"), "status")


@query("version_rotate", "SELECT * FROM (VALUES ('v3', 3), ('v4', 4), ('v5', 5)) AS t(version, number)")
def version_rotate(spark, sf_dir):
    """Five versions, of which the last three stay."""
    base = _folder(spark)
    few = traffic.entries(spark, sf_dir).select("key", "weight", F.lit(0).alias("shard"))
    for k in range(5):
        snapshot.dump(few.where(F.col("weight") % 5 <= k), base, keep=3)
    left = snapshot.Versions(spark, base).listed()
    return spark.createDataFrame(sorted((name, number) for _, name, number in left), "version string, number int")


_FILES = """
    WITH f AS (SELECT DISTINCT 'cache-shard-' || (page_id % 4) || '-2024010' || (page_id % 3 + 1) || 'T000000' || CASE page_id % 5 WHEN 0 THEN '.dump' WHEN 1 THEN '.dump.gz' ELSE '.dump.tmp' END AS name FROM pages),"""


def _files(spark, sf_dir):
    p = F.col("page_id")
    end = F.when(p % 5 == 0, ".dump").when(p % 5 == 1, ".dump.gz").otherwise(".dump.tmp")
    name = F.concat(F.lit("cache-shard-"), (p % 4).cast("string"), F.lit("-2024010"), (p % 3 + 1).cast("string"), F.lit("T000000"), end)
    return table(spark, sf_dir, "pages").select(name.alias("name")).distinct()


@query("dump_finished_files", f"""{_FILES}
    s AS (SELECT name, regexp_extract(name, '-([0-9]{{8}}T[0-9]{{6}})\\.dump(?:\\.gz)?$', 1) AS stamp FROM f)
    SELECT name, stamp FROM s WHERE stamp = (SELECT max(stamp) FROM s)""")
def dump_finished_files(spark, sf_dir):
    """The documented variant: files that are still being written don't count."""
    return snapshot.latest_files(_files(spark, sf_dir), leftovers=False).select("name", "stamp")


@query("dump_latest_files", f"""{_FILES}
    s AS (SELECT name, CASE WHEN ends_with(name, '.dump') THEN left(string_split(name, '-')[-1], -5) ELSE string_split(name, '-')[-1] END AS stamp FROM f)
    SELECT name, stamp FROM s WHERE stamp = (SELECT max(stamp) FROM s)""")
def dump_latest_files(spark, sf_dir):
    """The files of the greatest stamp; a leftover .tmp has a stamp of its own, which sorts after the finished one's."""
    return snapshot.latest_files(_files(spark, sf_dir)).select("name", "stamp")


@query("generated_requests", """
    SELECT i AS req_id, '/api/v2/pagedata' AS path, strlen(i::VARCHAR) * 6 + 401 AS query_bytes, 88 + 16 + strlen(i::VARCHAR) * 6 + 401
           + (8 + 4 + 12) + (8 + 15 + 17) + (8 + 15 + 14) + (8 + 12 + 16) + (12 + 12 + 16) + (12 + 4 + 32) AS weight FROM range(0, 1000) t(i)""")
def generated_requests(spark, sf_dir):
    """A thousand synthetic requests and the bytes their entries would take."""
    made = requests.generate(spark, 1000)
    weight = scalars.entry_weight(F.col("path"), F.col("query"), F.lit(0), F.col("req_headers"), F.col("resp_headers"))
    return made.select("req_id", "path", F.octet_length("query").cast("bigint").alias("query_bytes"), weight.alias("weight"))


# ---- dimensions ----------------------------------------------------------------------------------------------

_DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in locales.rows()) + ") AS t(kind, code, target_kind, target))"


@query("locale_map", f"""
    WITH {_DIM}, d AS (SELECT doc_id, lang FROM documents)
    SELECT doc_id, lang, c.target AS locale, i.target AS iso, n.target AS country
    FROM d LEFT JOIN dim c ON c.kind = 'code' AND c.target_kind = 'locale' AND c.code = lang
           LEFT JOIN dim i ON i.kind = 'locale' AND i.target_kind = 'iso' AND i.code = c.target
           LEFT JOIN dim n ON n.kind = 'code' AND n.target_kind = 'country' AND n.code = lang""")
def locale_map(spark, sf_dir):
    dim, docs = locales.dimension(spark), table(spark, sf_dir, "documents").select("doc_id", "lang")
    located = locales.translate(docs, "lang", "code", "locale", "locale", dim)
    return locales.translate(locales.translate(located, "locale", "locale", "iso", "iso", dim), "lang", "code", "country", "country", dim)


@query("locale_lists", f"""
    WITH {_DIM}, d AS (SELECT DISTINCT lang FROM documents)
    SELECT lang, array_to_string(list_sort(list(target)), ',') AS locales, lang IN (SELECT code FROM dim WHERE kind = 'iso') AS valid
    FROM d JOIN dim ON kind = 'iso' AND code = lang GROUP BY lang""")
def locale_lists(spark, sf_dir):
    dim, langs = locales.dimension(spark), table(spark, sf_dir, "documents").select("lang").distinct()
    listed = locales.valid(locales.translate(langs, "lang", "iso", "locale", "locales", dim), "lang", "iso", "valid", dim)
    return listed.withColumn("locales", F.array_join("locales", ","))


@query("locale_roundtrip_gaps", f"""
    WITH {_DIM} SELECT a.code AS locale, a.target_kind AS by, a.target, b.target AS back
    FROM dim a LEFT JOIN dim b ON b.kind = a.target_kind AND b.code = a.target AND b.target_kind = 'locale'
    WHERE a.kind = 'locale' AND a.target_kind IN ('code', 'translators') AND a.code IS DISTINCT FROM b.target""")
def locale_roundtrip_gaps(spark, sf_dir):
    return locales.roundtrip_gaps(locales.dimension(spark))


@query("locale_countries")
def locale_countries(spark, sf_dir):
    return locales.countries(spark)


# ---- scalars -------------------------------------------------------------------------------------------------


@query("fmt_mem", """
    WITH b AS (SELECT o_orderkey AS id, CAST(o_totalprice * 100 AS BIGINT) * (1 + o_orderkey % 7) * (1 + o_custkey % 900) AS n FROM orders)
    SELECT id, n, CASE WHEN n >= 1099511627776 THEN printf('%dTB %dGB', n // 1099511627776, (n % 1099511627776) // 1073741824)
                       WHEN n >= 1073741824 THEN printf('%dGB %dMB', n // 1073741824, (n % 1073741824) // 1048576)
                       WHEN n >= 1048576 THEN printf('%dMB %dKB', n // 1048576, (n % 1048576) // 1024)
                       WHEN n >= 1024 THEN printf('%dKB %dB', n // 1024, n % 1024) ELSE printf('%dB', n) END AS shown FROM b""")
def fmt_mem(spark, sf_dir):
    n = F.round(F.col("o_totalprice") * 100).cast("bigint") * (1 + F.col("o_orderkey") % 7) * (1 + F.col("o_custkey") % 900)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), n.alias("n"), scalars.fmt_mem(n).alias("shown"))


@query("fmt_bytes", """
    WITH b AS (SELECT doc_id AS id, n_chars * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 50 WHEN 2 THEN 125000 ELSE 333333333 END AS n FROM documents)
    SELECT id, n, CASE WHEN n >= 1000000000000 THEN printf('%.1f TB', n / 1e12::DOUBLE) WHEN n >= 1000000000 THEN printf('%.1f GB', n / 1e9::DOUBLE)
                       WHEN n >= 1000000 THEN printf('%.1f MB', n / 1e6::DOUBLE) WHEN n >= 1000 THEN printf('%.1f kB', n / 1e3::DOUBLE) ELSE printf('%d B', n) END AS shown FROM b""")
def fmt_bytes(spark, sf_dir):
    d = F.col("doc_id") % 4
    n = F.col("n_chars") * F.when(d == 0, 1).when(d == 1, 50).when(d == 2, 125000).otherwise(333333333)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), n.alias("n"), scalars.fmt_bytes(n).alias("shown"))


@query("rfc1123_header", """
    SELECT event_id AS id, strftime(ts, '%a, %d %b %Y %H:%M:%S UTC') AS last_updated_at, strftime(ts, '%Y%m%dT%H%M%S') AS stamp FROM events""")
def rfc1123_header(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), scalars.rfc1123(F.col("ts")).alias("last_updated_at"), scalars.dump_stamp(F.col("ts")).alias("stamp"))


@query("names_and_bodies", """
    SELECT s_suppkey AS id, s_name || ' (http://' || s_nationkey || ')' AS name, '{"error":{"status":503,"message":"' || s_name || '"}}' AS body,
           CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 9223372036854775807 END AS version
    FROM supplier""")
def names_and_bodies(spark, sf_dir):
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "v").otherwise("x"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), scalars.backend_name(F.col("s_name"), F.lit("http"), F.col("s_nationkey").cast("string")).alias("name"),
        scalars.error_body(F.lit(503), F.col("s_name")).alias("body"), scalars.version_number(name).alias("version"),
    )
