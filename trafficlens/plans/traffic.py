"""Catalogue: keys, rules, storage, policy and metrics over the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.functions import keys, scalars
from trafficlens.operators import health, metrics, policy, storage
from trafficlens.operators.prefix_sum import as_of, time_slice
from trafficlens.plans.base_sql import LATEST, OUTCOMES, REQUESTS, SHARD, window_sql
from trafficlens.plans.registry import query
from trafficlens.session import table
from trafficlens.sources import requests
from trafficlens.sources.config import EVENTS_CONFIG

PREFIXES = ["ref", "page", "utm"]
SHARDS_REPLAYED = keys.SHARDS


def log(spark, sf_dir):
    return requests.from_events(table(spark, sf_dir, "events"))


def matched(spark, sf_dir):
    return storage.match_rules(log(spark, sf_dir), EVENTS_CONFIG.rules_frame(spark))


def outcomes(spark, sf_dir):
    return storage.outcomes(matched(spark, sf_dir))


def entries(spark, sf_dir):
    """The storage after the whole log: one row per key, with its weight."""
    kept = storage.latest_entries(matched(spark, sf_dir).where("rule_path IS NOT NULL AND status = 200"), ["duration"])
    return storage.weighed(kept, F.col("duration"))


# ---- keys ----------------------------------------------------------------------------------------------------

_PAIRS = """pairs AS (
    SELECT page_id, list_filter(list_transform(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\\?([^#]*)', 1), '&'),
               lambda x, i: {'k': regexp_extract(x, '^([^=]*)', 1), 'at': i, 'v': regexp_extract(x, '^[^=]*=(.*)$', 1)}),
               lambda p: p.k LIKE 'ref%' OR p.k LIKE 'page%' OR p.k LIKE 'utm%') AS kept,
           len(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '')) AS seen
    FROM pages),
canonical AS (
    SELECT page_id, seen, kept, array_to_string(list_transform(list_sort(kept), lambda p: p.k || p.v), '') AS key FROM pairs)"""


def _page_pairs(spark, sf_dir):
    parsed = keys.parse_pairs(keys.query_of(F.col("url")))
    kept = keys.sort_pairs(keys.keep_prefixed(parsed, PREFIXES))
    pages = table(spark, sf_dir, "pages").select("page_id", kept.alias("pairs"), F.size(F.filter(parsed, lambda p: p["k"] != "")).alias("seen"))
    return pages.withColumn("key", keys.canonical(F.col("pairs")))


@query("key_canonical_url", f"WITH {_PAIRS} SELECT page_id, key, md5(key) AS fingerprint, {SHARD} AS shard FROM canonical")
def key_canonical_url(spark, sf_dir):
    return _page_pairs(spark, sf_dir).select("page_id", "key", keys.fingerprint(F.col("key")).alias("fingerprint"), keys.shard_of(F.col("key")).alias("shard"))


@query("key_prefix_filter", f"WITH {_PAIRS} SELECT page_id, CAST(seen AS INT) AS seen, CAST(len(kept) AS INT) AS kept FROM canonical")
def key_prefix_filter(spark, sf_dir):
    return _page_pairs(spark, sf_dir).select("page_id", "seen", F.size("pairs").alias("kept"))


@query("key_header_filter", """
    SELECT event_id AS req_id,
           CASE WHEN user_id % 4 = 0 THEN 'Accept-Encodinggzip' WHEN user_id % 4 = 1 THEN 'Accept-Encodingbr' ELSE '' END
           || CASE WHEN user_id % 4 = 3 THEN '' ELSE 'X-Client' || user_id END AS header_key
    FROM events""")
def key_header_filter(spark, sf_dir):
    """Headers of a request that are listed, not empty, and sorted by name. The second value of a name doesn't count."""
    r = F.col("client") % 4
    header = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    headers = F.array(
        header("X-Client", F.when(r == 3, F.lit("")).otherwise(F.col("client").cast("string"))),
        header("Accept-Encoding", F.when(r == 0, "gzip").when(r == 1, "br").otherwise("")),
        header("Accept-Encoding", F.lit("deflate")), header("X-Other", F.lit("x")),
    )
    picked = keys.key_headers(headers, ["Accept-Encoding", "X-Client"])
    return log(spark, sf_dir).select("req_id", keys.canonical(F.array().cast("array<struct<k:string,v:string>>"), picked).alias("header_key"))


@query("response_header_filter", "SELECT event_id AS req_id, CASE WHEN user_id % 2 = 0 THEN 'Server' ELSE '' END || '|Server,Vary' AS stored FROM events")
def response_header_filter(spark, sf_dir):
    """An allow-list keeps what it names; an empty one keeps all."""
    first = F.when(F.col("client") % 2 == 0, "Server").otherwise("Via")
    headers = lambda *names: F.array(*[F.struct(n.alias("k"), F.lit("x").alias("v")) for n in names])
    named = lambda h: F.array_join(F.transform(h, lambda p: p["k"]), ",")
    some = keys.response_headers(headers(first), ["Server", "Vary"])
    every = keys.response_headers(headers(F.lit("Server"), F.lit("Vary")), [])
    return log(spark, sf_dir).select("req_id", F.concat(named(some), F.lit("|"), named(every)).alias("stored"))


@query("key_shard_histogram", f"""
    WITH k AS (SELECT event_type || props AS key FROM events), s AS (SELECT {SHARD} AS shard FROM k)
    SELECT shard, count(*) AS n FROM s GROUP BY shard""")
def key_shard_histogram(spark, sf_dir):
    both = F.concat("event_type", "props")
    return table(spark, sf_dir, "events").groupBy(keys.shard_of(both).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("key_collisions", """
    SELECT 'k' || regexp_extract(props, '"k": *([0-9]+)', 1) AS key, count(DISTINCT md5('/' || event_type || regexp_extract(props, '"k": *([0-9]+)', 1))) AS fingerprints,
           count(*) AS requests
    FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1""")
def key_collisions(spark, sf_dir):
    """Keys without the path under which requests with different paths share an entry."""
    full = log(spark, sf_dir).withColumn("fp", keys.fingerprint(F.concat("path", F.substring("key", 2, 100))))
    return storage.collisions(full, "key", "fp")


@query("key_xxh3")
def key_xxh3(spark, sf_dir):
    """XXH3 keys and fingerprints of all requests; the shard follows from the 64 bits."""
    hashed = log(spark, sf_dir).select("req_id", "key", keys.xxh3("key").alias("h"))
    return hashed.select("req_id", "key", "h.key64", F.hex("h.fingerprint").alias("fingerprint"), keys.shard_of_hash(F.col("h.key64")).alias("shard"))


# ---- rules ---------------------------------------------------------------------------------------------------


@query("rule_match_outcome", f"WITH {OUTCOMES} SELECT path, outcome, count(*) AS n FROM outcome GROUP BY path, outcome")
def rule_match_outcome(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("path", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("rule_unmatched", f"WITH {REQUESTS} SELECT path, count(*) AS n FROM req WHERE rule_path IS NULL GROUP BY path")
def rule_unmatched(spark, sf_dir):
    return storage.unmatched(log(spark, sf_dir), EVENTS_CONFIG.rules_frame(spark)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


# ---- storage -------------------------------------------------------------------------------------------------


@query("hit_miss_daily", f"""
    WITH {OUTCOMES}, c AS (
        SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses,
               count(*) FILTER (outcome = 'proxied') AS proxied, count(*) FILTER (outcome = 'error') AS errors
        FROM outcome GROUP BY 1)
    SELECT *, 100.0::DOUBLE * hits / greatest(CAST(hits + misses AS DOUBLE), 1e-9) AS hit_rate FROM c""")
def hit_miss_daily(spark, sf_dir):
    daily = metrics.counters(outcomes(spark, sf_dir), "1 day").withColumn("day", F.to_date("win"))
    return metrics.hit_rate(daily).select("day", "total", "hits", "misses", "proxied", "errors", "hit_rate")


@query("set_classify", f"""
    WITH {REQUESTS}, w AS (
        SELECT key, req_id, duration % 4 AS payload, path AS fp,
               lag(req_id) OVER t AS before, lag(duration % 4) OVER t AS old, lag(path) OVER t AS old_fp
        FROM req WHERE stored WINDOW t AS (PARTITION BY key ORDER BY ts, req_id))
    SELECT key, CASE WHEN before IS NULL THEN 'insert' WHEN old_fp <> fp THEN 'collision' WHEN old = payload THEN 'touch' ELSE 'update' END AS kind, count(*) AS n
    FROM w GROUP BY ALL""")
def set_classify(spark, sf_dir):
    writes = matched(spark, sf_dir).where("rule_path IS NOT NULL AND status = 200").withColumn("payload", F.col("duration") % 4)
    kinds = storage.classify_sets(writes, "payload", "path")
    return kinds.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("latest_entry", f"WITH {LATEST} SELECT key, shard, ts, path, query, weight FROM latest")
def latest_entry(spark, sf_dir):
    return entries(spark, sf_dir).select("key", "shard", "ts", "path", "query", "weight")


@query("shard_weight", f"WITH {LATEST} SELECT shard, count(*) AS entries, CAST(sum(weight) AS BIGINT) AS mem FROM latest GROUP BY shard")
def shard_weight(spark, sf_dir):
    return storage.shard_weights(entries(spark, sf_dir))


@query("total_mem_len", f"WITH {LATEST} SELECT count(*) AS length, CAST(sum(weight) AS BIGINT) AS mem, sum(weight) >= 50000 AS over_threshold FROM latest")
def total_mem_len(spark, sf_dir):
    total = storage.shard_weights(entries(spark, sf_dir)).agg(F.sum("entries").alias("length"), F.sum("mem").alias("mem"))
    return total.withColumn("over_threshold", F.col("mem") >= 50000)


@query("removed_entries", f"WITH {LATEST} SELECT key, weight FROM latest WHERE key NOT IN (SELECT key FROM req WHERE path = '/signup' AND client % 10 = 0)")
def removed_entries(spark, sf_dir):
    gone = log(spark, sf_dir).where("path = '/signup' AND client % 10 = 0")
    return storage.removed(entries(spark, sf_dir), gone).select("key", "weight")


@query("shard_weight_deltas", f"""
    WITH {REQUESTS}, d AS (
        SELECT shard, CAST(ts AS DATE) AS day, duration - coalesce(lag(duration) OVER (PARTITION BY key ORDER BY ts, req_id), 0) AS delta FROM req WHERE stored)
    SELECT shard, day, CAST(sum(delta) AS BIGINT) AS delta FROM d GROUP BY shard, day""")
def shard_weight_deltas(spark, sf_dir):
    writes = matched(spark, sf_dir).where("rule_path IS NOT NULL AND status = 200")
    return storage.weight_deltas(writes, "duration").groupBy("shard", F.to_date("ts").alias("day")).agg(F.sum("delta").alias("delta"))


@query("payload_equal_probe", """
    WITH p AS (SELECT doc_id, text AS b, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS a FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, CAST(encode(a) AS BLOB) AS a, CAST(encode(b) AS BLOB) AS b FROM p WHERE a IS NOT NULL),
    h AS (SELECT doc_id, a = b AS exact_equal, octet_length(a) AS n, octet_length(a) = octet_length(b) AS same_length,
                 hex(a) AS ha, hex(b) AS hb FROM s),
    q AS (SELECT *, xor(xor(hash(substr(ha, 1, 16)), hash(substr(ha, (n // 2) * 2 + 1, 16))), hash(substr(ha, 2 * n - 15, 16)))
                  = xor(xor(hash(substr(hb, 1, 16)), hash(substr(hb, (n // 2) * 2 + 1, 16))), hash(substr(hb, 2 * n - 15, 16))) AS probes FROM h)
    SELECT doc_id, exact_equal, same_length AND CASE WHEN n < 32 THEN exact_equal ELSE probes END AS probe_equal FROM q""")
def payload_equal_probe(spark, sf_dir):
    """Each document's text against the one before it in its source, exactly and by probes."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", scalars.signature(F.col("text").cast("binary")).alias("b"))
    pairs = as_of(docs, "source", F.lit(True), F.col("b"), "a", ("doc_id",), F.floor(F.col("doc_id") / F.lit(100_000))).where("a IS NOT NULL")
    return pairs.select("doc_id", (F.col("a.sha") == F.col("b.sha")).alias("exact_equal"), scalars.same_by_probes(F.col("a"), F.col("b")).alias("probe_equal"))


@query("clear_epochs", f"""
    WITH {REQUESTS}, e AS (SELECT *, sum(CASE WHEN path = '/signup' AND client % 50 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY ts, req_id ROWS UNBOUNDED PRECEDING) AS epoch FROM req),
    o AS (SELECT epoch, CASE WHEN rule_path IS NULL THEN 'proxied'
              WHEN coalesce(max(CAST(stored AS INT)) OVER (PARTITION BY key, epoch ORDER BY ts, req_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'hit'
              WHEN status <> 200 THEN 'error' ELSE 'miss' END AS outcome FROM e)
    SELECT CAST(epoch AS BIGINT) AS epoch, outcome, count(*) AS n FROM o GROUP BY epoch, outcome""")
def clear_epochs(spark, sf_dir):
    """Hits and misses with the storage cleared now and then."""
    marked = storage.clear_epochs(matched(spark, sf_dir), (F.col("path") == "/signup") & (F.col("client") % 50 == 0))
    return storage.outcomes(marked, "epoch").groupBy("epoch", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("enabled_periods", f"""
    WITH {REQUESTS}, s AS (SELECT *, CASE WHEN path = '/signup' AND client % 50 = 1 THEN 0 WHEN path = '/signup' AND client % 50 = 2 THEN 1 END AS switch FROM req),
    e AS (SELECT *, coalesce(last_value(switch IGNORE NULLS) OVER (ORDER BY ts, req_id ROWS UNBOUNDED PRECEDING), 1) AS enabled FROM s)
    SELECT CAST(ts AS DATE) AS day, CAST(sum(enabled) AS BIGINT) AS enabled, count(*) AS total FROM e GROUP BY 1""")
def enabled_periods(spark, sf_dir):
    """Requests that came while the cache was switched on. The state at the start of a day is the last switch before."""
    switch = F.when((F.col("path") == "/signup") & (F.col("client") % 50 == 1), 0).when((F.col("path") == "/signup") & (F.col("client") % 50 == 2), 1)
    rows = log(spark, sf_dir).select("ts", "req_id", F.lit(1).alias("all"), switch.alias("switch"))
    known = as_of(rows, "all", F.col("switch").isNotNull(), F.col("switch"), "last", slice_=time_slice(width="minute"))
    state = known.withColumn("enabled", F.coalesce("switch", "last", F.lit(1)))
    return state.groupBy(F.to_date("ts").alias("day")).agg(F.sum("enabled").alias("enabled"), F.count(F.lit(1)).alias("total"))


@query("sample_per_shard", f"""
    WITH {LATEST}, r AS (SELECT shard, key, row_number() OVER (PARTITION BY shard ORDER BY md5('7:' || key)) AS r FROM latest)
    SELECT shard, key FROM r WHERE r = 1""")
def sample_per_shard(spark, sf_dir):
    return storage.one_per_shard(entries(spark, sf_dir), "7")


# ---- policy --------------------------------------------------------------------------------------------------

_SMALL = f"{LATEST}, small AS (SELECT * REPLACE (shard % {SHARDS_REPLAYED} AS shard) FROM latest)"


def _small(spark, sf_dir):
    return entries(spark, sf_dir).withColumn("shard", F.col("shard") % SHARDS_REPLAYED)


@query("lru_rank", f"WITH {_SMALL} SELECT key, shard, row_number() OVER (PARTITION BY shard ORDER BY ts DESC, req_id DESC) - 1 AS recency FROM small")
def lru_rank(spark, sf_dir):
    return policy.lru_ranks(_small(spark, sf_dir)).select("key", "shard", "recency")


@query("lru_victim", f"""
    WITH {_SMALL}, r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ts, req_id) AS r FROM small) SELECT shard, key AS victim, ts FROM r WHERE r = 1""")
def lru_victim(spark, sf_dir):
    return policy.victims(_small(spark, sf_dir))


@query("victim_neighbour", f"""
    WITH {LATEST}, v AS (SELECT shard, arg_min(key, (ts, req_id)) AS victim FROM latest GROUP BY shard),
    o AS (SELECT shard, 0 AS turn, shard AS from_shard, victim FROM v UNION ALL SELECT shard - 1, 1, shard, victim FROM v UNION ALL
          SELECT shard + 1, 2, shard, victim FROM v WHERE shard > 0)
    SELECT shard, arg_min(from_shard, turn) AS from_shard, arg_min(victim, turn) AS victim FROM o WHERE shard BETWEEN 0 AND {keys.SHARDS - 1} GROUP BY shard""")
def victim_neighbour(spark, sf_dir):
    return policy.neighbour_victims(entries(spark, sf_dir), keys.SHARDS)


@query("fat_shards", f"""
    WITH {LATEST}, w AS (SELECT shard, CAST(sum(weight) AS BIGINT) AS mem, count(*) AS entries FROM latest GROUP BY shard),
    r AS (SELECT *, CAST(row_number() OVER (ORDER BY mem DESC, shard) AS INT) AS shard_rank FROM w) SELECT * FROM r WHERE shard_rank <= 20""")
def fat_shards(spark, sf_dir):
    return policy.fat_shards(storage.shard_weights(entries(spark, sf_dir)), 20)


def _evicted_sql(only: str, order: str) -> str:
    return f"""
    WITH {_SMALL}, w AS (SELECT shard, row_number() OVER (ORDER BY sum(weight) DESC, shard) AS shard_rank FROM small GROUP BY shard),
    r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ts DESC, req_id DESC) - 1 AS recency FROM small),
    c AS (SELECT key, shard, recency, weight, sum(weight) OVER (ORDER BY shard_rank, {order} ROWS UNBOUNDED PRECEDING) - weight AS freed_before
          FROM r JOIN w USING (shard) WHERE {only})
    SELECT key, shard, recency, weight, CAST(freed_before AS BIGINT) AS freed_before FROM c WHERE freed_before < 200000"""


@query("evict_lru_budget", _evicted_sql("true", "recency DESC"))
def evict_lru_budget(spark, sf_dir):
    return policy.evict(_small(spark, sf_dir), 200_000, "documented").select("key", "shard", "recency", "weight", "freed_before")


@query("evict_reference_order", _evicted_sql("recency % 2 = 0", "recency"))
def evict_reference_order(spark, sf_dir):
    return policy.evict(_small(spark, sf_dir), 200_000, "reference").select("key", "shard", "recency", "weight", "freed_before")


@query("evict_stats", f"""
    WITH e AS ({_evicted_sql("true", "recency DESC")}), t AS (SELECT e.weight, ts FROM e JOIN (WITH {LATEST} SELECT key, ts FROM latest) USING (key))
    SELECT {window_sql("ts", 86400)} AS win, count(*) AS items, CAST(sum(weight) AS BIGINT) AS mem FROM t GROUP BY 1""")
def evict_stats(spark, sf_dir):
    return policy.eviction_stats(policy.evict(_small(spark, sf_dir), 200_000, "documented"), "1 day")


@query("lru_stack_distance", f"""
    WITH {REQUESTS}, a AS (
        SELECT shard % {SHARDS_REPLAYED} AS shard, req_id, key, row_number() OVER (PARTITION BY shard % {SHARDS_REPLAYED} ORDER BY ts, req_id) AS i FROM req),
    n AS (SELECT *, lag(i) OVER (PARTITION BY shard, key ORDER BY i) AS p, lead(i) OVER (PARTITION BY shard, key ORDER BY i) AS nx FROM a),
    d AS (SELECT x.shard, x.req_id, count(y.i) AS d FROM n x LEFT JOIN n y ON x.shard = y.shard AND y.i > x.p AND y.i < x.i AND (y.nx IS NULL OR y.nx > x.i)
          WHERE x.p IS NOT NULL GROUP BY x.shard, x.req_id)
    SELECT CAST(a.shard AS BIGINT) AS shard, a.req_id, d.d AS distance FROM a LEFT JOIN d USING (req_id)""")
def lru_stack_distance(spark, sf_dir):
    return policy.stack_distances(log(spark, sf_dir).withColumn("shard", F.col("shard") % SHARDS_REPLAYED))


_FREQ = f"""freq AS (SELECT key, {window_sql("ts", 3600)} AS win, count(*) AS freq FROM req WHERE stored GROUP BY ALL),
est AS (SELECT key, win, freq, CASE WHEN lag(win) OVER t = win - INTERVAL 1 HOUR THEN lag(freq) OVER t ELSE 0 END AS prev FROM freq WINDOW t AS (PARTITION BY key ORDER BY win)),
estimate AS (SELECT *, (freq + prev) // 2 AS estimate FROM est)"""


@query("lfu_minute_freq", f"""WITH {REQUESTS} SELECT key, {window_sql("ts", 60)} AS win, count(*) AS freq FROM req WHERE stored GROUP BY ALL""")
def lfu_minute_freq(spark, sf_dir):
    """Frequencies count writes, as the storage does; lookups leave them as they are."""
    return policy.window_frequency(policy.counted(matched(spark, sf_dir)))


@query("lfu_minute_reads", f"""WITH {REQUESTS} SELECT key, {window_sql("ts", 60)} AS win, count(*) AS freq FROM req GROUP BY ALL""")
def lfu_minute_reads(spark, sf_dir):
    """The documented variant: every request counts."""
    return policy.window_frequency(policy.counted(matched(spark, sf_dir), "reads"))


@query("lfu_estimate", f"WITH {REQUESTS}, {_FREQ} SELECT key, win, freq, prev, estimate FROM estimate")
def lfu_estimate(spark, sf_dir):
    return policy.frequency_estimate(policy.window_frequency(policy.counted(matched(spark, sf_dir)), "1 hour"), 3600)


@query("lfu_admit", f"""
    WITH {LATEST}, {_FREQ}, v AS (SELECT shard % {SHARDS_REPLAYED} AS shard, arg_min(key, (ts, req_id)) AS victim FROM latest GROUP BY 1),
    c AS (SELECT DISTINCT key, shard % {SHARDS_REPLAYED} AS shard, {window_sql("ts", 3600)} AS win FROM req WHERE stored)
    SELECT c.key, c.shard, c.win, victim, n.estimate AS new_freq, coalesce(o.estimate, 0) AS old_freq, n.estimate >= coalesce(o.estimate, 0) AS admitted
    FROM c JOIN v USING (shard) JOIN estimate n ON n.key = c.key AND n.win = c.win LEFT JOIN estimate o ON o.key = victim AND o.win = c.win""")
def lfu_admit(spark, sf_dir):
    accesses = policy.counted(matched(spark, sf_dir))
    estimates = policy.frequency_estimate(policy.window_frequency(accesses, "1 hour"), 3600)
    wanted = accesses.select("key", (F.col("shard") % SHARDS_REPLAYED).alias("shard"), F.window("ts", "1 hour").start.alias("win")).distinct()
    return policy.admissions(wanted, policy.victims(_small(spark, sf_dir)), estimates).select("key", "shard", "win", "victim", "new_freq", "old_freq", "admitted")


@query("doorkeeper_first_seen", f"""
    WITH {REQUESTS} SELECT key, {window_sql("ts", 60)} AS win, arg_min(req_id, (ts, req_id)) AS req_id FROM req GROUP BY ALL""")
def doorkeeper_first_seen(spark, sf_dir):
    return policy.first_seen(log(spark, sf_dir))


@query("lfu_cms")
def lfu_cms(spark, sf_dir):
    return policy.sketch(log(spark, sf_dir))


# ---- metrics -------------------------------------------------------------------------------------------------


def _counters_sql(seconds: int, more: str = "") -> str:
    return f"""
    WITH {OUTCOMES}, c AS (
        SELECT {window_sql("ts", seconds)} AS win, count(*) AS total, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses,
               count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'proxied') AS proxied, CAST(sum(duration) AS BIGINT) AS duration
        FROM outcome GROUP BY 1)
    SELECT *{more} FROM c"""


def _rates_sql(seconds: int) -> str:
    return _counters_sql(seconds, f", total / {float(seconds)}::DOUBLE AS rps, CAST(duration AS DOUBLE) / total AS avg_duration")


@query("metrics_1s", _rates_sql(1))
def metrics_1s(spark, sf_dir):
    return metrics.with_rates(metrics.counters(outcomes(spark, sf_dir), "1 second"), 1)


@query("metrics_5s", _rates_sql(5))
def metrics_5s(spark, sf_dir):
    return metrics.with_rates(metrics.counters(outcomes(spark, sf_dir), "5 seconds"), 5)


def _long(hours):
    def run(spark, sf_dir):
        partial = metrics.counters(outcomes(spark, sf_dir), "1 hour")
        wide = partial if hours == 1 else metrics.rolled_up(partial, f"{hours} hours")
        return metrics.with_integer_average(wide, hours)

    return run


for _hours in (1, 12, 24):
    query(f"metrics_{_hours}h", _counters_sql(3600 * _hours, f", total / {3600.0 * _hours}::DOUBLE AS avg_rps, duration // total AS avg_duration"))(_long(_hours))


@query("error_dedup_5s", f"""
    WITH {REQUESTS} SELECT {window_sql("ts", 5)} AS win, 'backend ' || backend || ' answered ' || status AS message, count(*) AS times
    FROM req WHERE status >= 500 GROUP BY ALL""")
def error_dedup_5s(spark, sf_dir):
    failed = log(spark, sf_dir).where("status >= 500")
    message = F.concat(F.lit("backend "), "backend", F.lit(" answered "), F.col("status").cast("string"))
    return metrics.repeated_messages(failed.withColumn("message", message), "message")


@query("dash_hit_rate", _counters_sql(60, ", 100.0::DOUBLE * hits / greatest(CAST(hits + misses AS DOUBLE), 1e-9) AS hit_rate"))
def dash_hit_rate(spark, sf_dir):
    return metrics.hit_rate(metrics.counters(outcomes(spark, sf_dir), "1 minute"))


@query("dash_error_rate", _counters_sql(3600, ", 100.0::DOUBLE * errors / greatest(CAST(proxied AS DOUBLE), 1e-9) AS error_rate"))
def dash_error_rate(spark, sf_dir):
    return metrics.error_rate(metrics.counters(outcomes(spark, sf_dir), "1 hour"))


@query("dash_rps", _counters_sql(60, ", total / 60.0::DOUBLE AS total_rate, errors / 60.0::DOUBLE AS errors_rate, hits / 60.0::DOUBLE AS hits_rate, misses / 60.0::DOUBLE AS misses_rate, coalesce(total / 60.0::DOUBLE, proxied / 60.0::DOUBLE) AS rps"))
def dash_rps(spark, sf_dir):
    rated = metrics.per_second(metrics.counters(outcomes(spark, sf_dir), "1 minute"), ["total", "errors", "hits", "misses"], 60)
    return rated.withColumn("rps", F.coalesce("total_rate", F.col("proxied") / F.lit(60.0)))


@query("dash_backend", f"""
    WITH {REQUESTS}, b AS (SELECT backend, {window_sql("ts", 86400)} AS win, count(*) AS total, count(*) FILTER (status >= 500) AS errors FROM req GROUP BY ALL)
    SELECT *, CAST(errors AS DOUBLE) / total AS err_rate, 100.0::DOUBLE * (CAST(errors AS DOUBLE) / total) AS error_percent, total / 86400.0::DOUBLE AS rps FROM b""")
def dash_backend(spark, sf_dir):
    windows = health.error_windows(log(spark, sf_dir), "1 day")
    return windows.withColumn("error_percent", F.lit(100.0) * F.col("err_rate")).withColumn("rps", F.col("total") / F.lit(86400.0))


@query("dash_gauges", f"""
    WITH {REQUESTS}, b AS (SELECT backend, {window_sql("ts", 86400)} AS win, count(*) AS total FROM req GROUP BY ALL)
    SELECT backend, arg_max(total, win) AS total, max(win) AS win FROM b GROUP BY backend""")
def dash_gauges(spark, sf_dir):
    return metrics.last_values(health.error_windows(log(spark, sf_dir), "1 day"), ["backend"], "total")


@query("exposition", f"""
    WITH {OUTCOMES}, span AS (SELECT CAST(max(floor(epoch(ts))) - min(floor(epoch(ts))) + 1 AS BIGINT) AS secs, count(*) AS n, CAST(sum(duration) AS BIGINT) AS d FROM req),
    last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, req_id DESC) AS r FROM req WHERE stored),
    held AS (SELECT count(*) AS n, coalesce(CAST(sum(88 + strlen(path) + strlen(query) + duration) AS BIGINT), 0) AS mem FROM last WHERE r = 1),
    c AS (SELECT count(*) FILTER (outcome = 'hit') AS h, count(*) FILTER (outcome = 'miss') AS m, count(*) AS t, count(*) FILTER (outcome = 'error') AS e, count(*) FILTER (outcome = 'proxied') AS p FROM outcome)
    SELECT 'cache_hits ' || h AS line FROM c UNION ALL SELECT 'cache_misses ' || m FROM c UNION ALL SELECT 'cache_total ' || t FROM c
    UNION ALL SELECT 'cache_errors ' || e FROM c UNION ALL SELECT 'cache_proxied ' || p FROM c UNION ALL SELECT 'cache_panics 0'
    UNION ALL SELECT 'cache_rps ' || n // secs FROM span UNION ALL SELECT 'cache_cache_length ' || n FROM held
    UNION ALL SELECT 'cache_cache_memory_usage ' || mem FROM held UNION ALL SELECT 'cache_avg_duration ' || d // n FROM span""")
def exposition(spark, sf_dir):
    """Every meter once, over the whole log; rates and averages as whole numbers."""
    known = outcomes(spark, sf_dir)
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    count = lambda o: F.count_if(F.col("outcome") == o)
    n = F.count(F.lit(1))
    every = known.agg(
        count("hit").alias("hits"), count("miss").alias("misses"), n.alias("total"), count("error").alias("errors"), count("proxied").alias("proxied"),
        F.lit(0).alias("panics"), F.floor(n / (F.max(second) - F.min(second) + 1)).alias("rps"), F.floor(F.sum("duration") / n).alias("avg_duration"),
    )
    held = entries(spark, sf_dir).agg(n.alias("cache_length"), F.coalesce(F.sum("weight"), F.lit(0)).alias("cache_memory_usage"))
    named = [x.select(F.stack(F.lit(len(x.columns)), *[y for m in x.columns for y in (F.lit(m), F.col(m).cast("double"))]).alias("name", "value")) for x in (every, held)]
    return metrics.exposition(named[0].unionByName(named[1]))


@query("dash_cache_gauges", f"""WITH {LATEST} SELECT count(*) AS length, CAST(sum(weight) AS BIGINT) AS memory FROM latest""")
def dash_cache_gauges(spark, sf_dir):
    """Entries held and their bytes after the whole log."""
    return entries(spark, sf_dir).agg(F.count(F.lit(1)).alias("length"), F.sum("weight").alias("memory"))


@query("outcome_fingerprint", f"""
    WITH {REQUESTS}, held AS (
        SELECT *, last_value(CASE WHEN stored THEN path END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, req_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS there FROM req)
    SELECT req_id, CASE WHEN rule_path IS NULL THEN 'proxied' WHEN there = path THEN 'hit' WHEN status <> 200 THEN 'error' ELSE 'miss' END AS outcome FROM held""")
def outcome_fingerprint(spark, sf_dir):
    """Outcomes where an entry counts only if its fingerprint is the request's: paths share keys here, and replace each other."""
    print_of = keys.fingerprint(F.concat_ws("\n", "path", "key"))
    return storage.outcomes_by_fingerprint(matched(spark, sf_dir).withColumn("fp", print_of), "fp").select("req_id", "outcome")


@query("refresh_elapsed", f"""
    WITH {REQUESTS}
    SELECT req_id, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(max(CASE WHEN stored THEN ts END) OVER (PARTITION BY key ORDER BY ts, req_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) AS BIGINT) AS elapsed FROM req""")
def refresh_elapsed(spark, sf_dir):
    """Seconds since the entry of each request's key was last written, as of that request; null before the first write."""
    known = matched(spark, sf_dir)
    stored = F.col("rule_path").isNotNull() & (F.col("status") == 200)
    at = as_of(known, "key", stored, F.col("ts"), "refreshed")
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return at.select("req_id", (seconds("ts") - seconds("refreshed")).alias("elapsed"))


@query("shard_walk", f"""
    WITH {LATEST}, stop AS (SELECT shard, min(key) AS stop FROM latest WHERE weight % 3 = 0 GROUP BY shard)
    SELECT shard, key, weight FROM latest LEFT JOIN stop USING (shard) WHERE stop IS NULL OR key <= stop""")
def shard_walk(spark, sf_dir):
    """Each shard's entries in order of their keys, up to the first at which the walk is told to stop."""
    return storage.walk(entries(spark, sf_dir), F.col("weight") % 3 == 0).select("shard", "key", "weight")


@query("shards_by_weight_asc", f"""
    WITH {LATEST}, w AS (SELECT shard, CAST(sum(weight) AS BIGINT) AS mem FROM latest GROUP BY shard)
    SELECT shard, mem, CAST(row_number() OVER (ORDER BY mem, shard) AS INT) AS shard_rank FROM w QUALIFY shard_rank <= 20""")
def shards_by_weight_asc(spark, sf_dir):
    return policy.fat_shards(storage.shard_weights(entries(spark, sf_dir)), 20, ascending=True).select("shard", "mem", "shard_rank")


@query("balancer_overhead", f"""
    WITH {LATEST} SELECT CAST(40 + {keys.SHARDS} * (2 * 8 + 40) + count(DISTINCT shard) * 8 AS BIGINT) AS mem FROM latest""")
def balancer_overhead(spark, sf_dir):
    return policy.balancer_overhead(storage.shard_weights(entries(spark, sf_dir)), keys.SHARDS)


@query("hex_token", "SELECT event_id AS req_id, md5('seed:' || event_id) AS token FROM events")
def hex_token(spark, sf_dir):
    return log(spark, sf_dir).select("req_id", scalars.hex_token("seed", F.col("req_id")).alias("token"))
