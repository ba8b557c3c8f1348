"""Health of upstream backends: error rates, probes, rate limits and the state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.scalars import safe_divide
from trafficlens.operators.prefix_sum import as_of, running_sum, time_slice

#: Thresholds of the decisions.
MAX_ERROR_RATE, MIN_ERROR_RATE = 0.7, 0.1
IDLE_REQUESTS = 50
PROBES_IN_ROW = 5
MAX_THROTTLES = 9
THROTTLE_STEP = 10
KILL_SECONDS, BURY_SECONDS = 3600, 24 * 3600


def is_error(status: Column, error: Column | None = None) -> Column:
    """A transport error or a status from 500 on."""
    bad = F.coalesce(status >= 500, F.lit(False))
    return bad if error is None else bad | error.isNotNull()


def is_healthy(status: Column) -> Column:
    """What a probe takes for health: an answer with status 200 and no other."""
    return F.coalesce(status == 200, F.lit(False))


def fetch_timeout(header: Column, timeout: Column, max_timeout: Column) -> Column:
    """The time a fetch may take: the longer one if the request has the header that asks for it, with any value."""
    return F.when(F.length(F.coalesce(header, F.lit(""))) > 0, max_timeout).otherwise(timeout)


def is_throttled(throttles: Column) -> Column:
    return throttles > 0


def healthy_count(states: DataFrame) -> DataFrame:
    """How many backends are healthy, of how many: one row."""
    return states.agg(F.count_if(F.col("state") == "healthy").alias("healthy"), F.count(F.lit(1)).alias("total"))


def error_windows(requests: DataFrame, width: str) -> DataFrame:
    """Requests, errors and the error rate of each backend in each window."""
    out = requests.groupBy("backend", F.window("ts", width).start.alias("win")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(is_error(F.col("status")), 1).otherwise(0)).cast("bigint").alias("errors")
    )
    return out.withColumn("err_rate", safe_divide(F.col("errors"), F.col("total")))


def decide(windows: DataFrame, throttles: Column, idle: int = IDLE_REQUESTS) -> DataFrame:
    """Add decision for a healthy backend: idle, quarantine, throttle, unthrottle or keep.

    At a rate of exactly the minimum, or with all throttles used, the backend is quarantined instead of throttled.
    """
    rate = F.col("err_rate")
    decision = (
        F.when(F.col("total") <= idle, "idle").when(rate >= MAX_ERROR_RATE, "quarantine")
        .when((rate > MIN_ERROR_RATE) & (throttles < MAX_THROTTLES), "throttle").when(rate >= MIN_ERROR_RATE, "quarantine")
        .when(throttles > 0, "unthrottle").otherwise("keep")
    )
    return windows.withColumn("decision", decision)


def probe_runs(probes: DataFrame) -> DataFrame:
    """Runs of equal probes in a row: (backend, run, ok, probes, first, last). Columns: backend, ts, req_id, ok.

    A backend's probes are walked hour by hour, with what the hour before ended on."""
    known = as_of(probes, "backend", F.lit(True), F.struct("ok"), "__last")
    changed = F.when(F.col("__last").isNotNull() & F.col("__last.ok").eqNullSafe(F.col("ok")), 0).otherwise(1)
    numbered = running_sum(known, time_slice(), [F.col("ts"), F.col("req_id")], changed, "run", ["backend"])
    return numbered.groupBy("backend", "run").agg(
        F.min("ok").alias("ok"), F.count(F.lit(1)).alias("probes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def throttled_rate(rate: Column, throttles: Column) -> Column:
    """The rate that is left after so many throttles of a tenth each; below nothing it is 1."""
    left = (rate.cast("double") - rate.cast("double") / F.lit(100.0) * (F.lit(THROTTLE_STEP) * throttles).cast("double")).cast("int")
    return F.when(left < 0, F.lit(1)).otherwise(left)


def unthrottled_rate(limit: Column, rate: Column) -> Column:
    """The rate after one throttle is taken back: a tenth of the original more, at most the original."""
    more = limit.cast("double") + rate.cast("double") / F.lit(100.0) * F.lit(float(THROTTLE_STEP))
    return F.least(more, rate.cast("double")).cast("int")


def admitted(requests: DataFrame, backends: DataFrame, width: str) -> DataFrame:
    """Add admitted: whether a request is within its backend's rate in its window, in order of time."""
    limits = backends.select(F.col("id").alias("backend"), "rate")
    joined = requests.withColumn("win", F.window("ts", width).start).join(F.broadcast(limits), "backend")
    turned = running_sum(joined, time_slice(width="second"), [F.col("ts"), F.col("req_id")], F.lit(1), "turn", ["backend", "win"])
    return turned.withColumn("turn", F.col("turn").cast("int")).withColumn("admitted", F.col("turn") <= F.col("rate"))


def validate_backends(backends: DataFrame) -> DataFrame:
    """What is wrong with a list of backends: ids that are given twice, and a sum of rates that is nothing."""
    twice = backends.where("enabled").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = backends.agg(F.coalesce(F.sum("rate"), F.lit(0)).alias("n")).where("n <= 0")
    return twice.select(F.lit("duplicate id").alias("problem"), "id").unionByName(total.select(F.lit("no rate").alias("problem"), F.lit(None).cast("string").alias("id")))


def fetch_outcome(healthy: Column, slot_free: Column, policy: Column) -> Column:
    """What a request to the cluster meets: no_healthy_backends, served, waits (policy await) or busy (deny)."""
    return F.when(healthy <= 0, "no_healthy_backends").when(slot_free, "served").when(policy == "await", "waits").otherwise("busy")


def state_columns(states: DataFrame) -> DataFrame:
    """One column for each state with how many windows each backend spent in it."""
    return states.groupBy("backend").pivot("state", ["healthy", "sick", "dead", "buried"]).agg(F.count(F.lit(1)))


# ---- the state machine ---------------------------------------------------------------------------------------

_STATE = "struct<state:string,throttles:int,suc:int,err:int,sicked:bigint,killed:bigint,moves:array<struct<at:bigint,move:string>>>"


def start_state() -> Column:
    """Healthy, without throttles, probes or moves."""
    return F.from_json(F.lit('{"state":"healthy","throttles":0,"suc":0,"err":0,"sicked":0,"killed":0,"moves":[]}'), _STATE)


def step(s: Column, e: Column) -> Column:
    """One event: (at: unix seconds, kind: "probe" or "window", ok, total, err_rate).

    total is the number of requests in the window so far. A healthy backend is probed only while it has had none: one
    with traffic is judged by its error rate. Sick and dead backends are always probed, buried ones never. A probe counts successes or failures in a row. Over PROBES_IN_ROW failures quarantine a healthy backend, and kill
    or bury one that has been down for long enough; as many successes cure a sick one (throttled to a fifth of its
    rate) and make a dead one sick. A window decides over a healthy backend as decide() does. Quarantine (which closes the
    backend's rate provider), throttling and resurrection set the probe counts to zero. Nothing happens to a buried backend.
    """
    idle = (s["state"] == "healthy") & (e["total"] <= 0)
    probe = (e["kind"] == "probe") & (idle | s["state"].isin("sick", "dead"))
    suc = F.when(probe, F.when(e["ok"], s["suc"] + 1).otherwise(0)).otherwise(s["suc"])
    err = F.when(probe, F.when(e["ok"], 0).otherwise(s["err"] + 1)).otherwise(s["err"])
    many_suc, many_err = suc > PROBES_IN_ROW, err > PROBES_IN_ROW
    busy, rate, used = e["total"] > IDLE_REQUESTS, e["err_rate"], s["throttles"]
    move = (
        F.when(probe & (s["state"] == "healthy") & many_err, "quarantine")
        .when(probe & (s["state"] == "sick") & many_suc, "cure")
        .when(probe & (s["state"] == "sick") & many_err & (e["at"] - s["sicked"] > KILL_SECONDS), "kill")
        .when(probe & (s["state"] == "dead") & many_suc, "resurrect")
        .when(probe & (s["state"] == "dead") & many_err & (e["at"] - s["killed"] > BURY_SECONDS), "bury")
        .when((e["kind"] == "probe") | (s["state"] != "healthy") | ~busy, F.lit(None).cast("string"))
        .when(rate >= MAX_ERROR_RATE, "quarantine")
        .when((rate > MIN_ERROR_RATE) & (used < MAX_THROTTLES), "throttle")
        .when(rate >= MIN_ERROR_RATE, "quarantine")
        .when(used > 0, "unthrottle")
    )
    is_ = lambda *names: F.coalesce(move.isin(*names), F.lit(False))
    state = (
        F.when(is_("quarantine", "resurrect"), "sick").when(is_("cure"), "healthy").when(is_("kill"), "dead")
        .when(is_("bury"), "buried").otherwise(s["state"])
    )
    throttles = F.when(is_("cure"), MAX_THROTTLES - 1).when(is_("throttle"), used + 1).when(is_("unthrottle"), used - 1).otherwise(used)
    zero = is_("quarantine", "cure", "throttle", "unthrottle", "resurrect")
    sicked = F.when(is_("quarantine", "resurrect"), e["at"]).when(is_("cure"), 0).otherwise(s["sicked"])
    killed = F.when(is_("kill"), e["at"]).when(is_("quarantine", "resurrect", "cure"), 0).otherwise(s["killed"])
    moved = F.when(move.isNull(), s["moves"]).otherwise(F.concat(s["moves"], F.array(F.struct(e["at"].alias("at"), move.alias("move")))))
    return F.struct(
        state.alias("state"), throttles.cast("int").alias("throttles"), F.when(zero, 0).otherwise(suc).cast("int").alias("suc"),
        F.when(zero, 0).otherwise(err).cast("int").alias("err"), sicked.cast("bigint").alias("sicked"), killed.cast("bigint").alias("killed"), moved.alias("moves"),
    )


def replay(events: DataFrame) -> DataFrame:
    """Fold each backend's events (backend, at, kind, ok, total, err_rate) in order of time, windows before probes.

    Returns backend, state, throttles, suc, err and moves. What is gathered per backend are ticks (windows and
    probes), not requests: as many as time is long, however large the log.
    """
    event = F.struct("at", F.when(F.col("kind") == "window", 0).otherwise(1).alias("turn"), "kind", "ok", "total", "err_rate")
    gathered = events.groupBy("backend").agg(F.sort_array(F.collect_list(event)).alias("events"))
    folded = gathered.select("backend", F.aggregate("events", start_state(), step).alias("s"))
    return folded.select("backend", "s.state", "s.throttles", "s.suc", "s.err", "s.moves")
