"""Catalogue: control events, replay, gauges and what loads and refreshes the storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.functions import keys
from trafficlens.operators import control, health, policy, storage
from trafficlens.operators.prefix_sum import running_sum
from trafficlens.plans import traffic
from trafficlens.plans.base_sql import LATEST, REQUESTS, window_sql
from trafficlens.plans.registry import ORACLE_SQL, query
from trafficlens.plans.traffic import SHARDS_REPLAYED
from trafficlens.session import table
from trafficlens.sources import requests

CAPACITIES = (1, 2, 4, 8, 16)


@query("clear_token", f"""
    WITH RECURSIVE {REQUESTS},
    ev AS (SELECT client % 10 AS instance, req_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
                  CASE duration % 3 WHEN 1 THEN 't' || (req_id - duration % 7) WHEN 2 THEN 'wrong' END AS asked FROM req WHERE path = '/signup'),
    o AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY sec, req_id) AS i FROM ev),
    fold AS (
        SELECT DISTINCT instance, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS req_id, '' AS token, CAST(0 AS BIGINT) AS expires, '' AS answer, '' AS shown FROM ev
        UNION ALL
        SELECT o.instance, o.i, o.req_id,
               CASE WHEN asked IS NOT NULL THEN '' WHEN token <> '' AND sec < expires THEN token ELSE 't' || o.req_id END,
               CASE WHEN asked IS NOT NULL THEN 0 WHEN token <> '' AND sec < expires THEN expires ELSE sec + 300 END,
               CASE WHEN asked IS NULL THEN CASE WHEN token <> '' AND sec < expires THEN 'reused' ELSE 'issued' END
                    WHEN token <> '' AND sec < expires AND asked = token THEN 'cleared' ELSE 'refused' END,
               coalesce(asked, CASE WHEN token <> '' AND sec < expires THEN token ELSE 't' || o.req_id END)
        FROM fold f JOIN o ON o.instance = f.instance AND o.i = f.i + 1)
    SELECT instance, req_id, answer, shown AS token FROM fold WHERE i > 0""")
def clear_token(spark, sf_dir):
    """Requests to clear the storage: clients of one instance ask for tokens, use them, and use wrong ones."""
    log = traffic.log(spark, sf_dir).where("path = '/signup'")
    r = F.col("duration") % 3
    token = F.when(r == 1, F.concat(F.lit("t"), (F.col("req_id") - F.col("duration") % 7).cast("string"))).when(r == 2, F.lit("wrong"))
    events = log.select((F.col("client") % 10).alias("instance"), "req_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), token.alias("token"))
    return control.clear_requests(events)


@query("policy_replay")
def policy_replay(spark, sf_dir):
    """Storage, recency and admission of each shard replayed with a budget of 60 kB each."""
    weighed = traffic.matched(spark, sf_dir).where("rule_path IS NOT NULL").withColumn("weight", F.col("duration") + 88).withColumn("stored", F.col("status") == 200)
    return control.replay_shards(weighed.withColumn("shard", F.col("shard") % SHARDS_REPLAYED), 60_000, 86_400)


@query("lru_hit_ratio", f"""
    WITH d AS ({ORACLE_SQL["lru_stack_distance"]})
    SELECT c AS entries, count(*) FILTER (distance < c) AS hits, count(*) AS accesses FROM d, (VALUES {", ".join(f"({c})" for c in CAPACITIES)}) AS t(c) GROUP BY c""")
def lru_hit_ratio(spark, sf_dir):
    """Hits of an LRU list per shard, for several lengths at once."""
    distances = policy.stack_distances(traffic.log(spark, sf_dir).withColumn("shard", F.col("shard") % SHARDS_REPLAYED))
    sizes = distances.select("distance", F.explode(F.array(*[F.lit(c) for c in CAPACITIES])).alias("entries"))
    return sizes.groupBy("entries").agg(F.count_if(F.col("distance") < F.col("entries")).alias("hits"), F.count(F.lit(1)).alias("accesses"))


@query("mem_snapshots", f"""
    WITH {REQUESTS}, d AS (SELECT {window_sql("ts", 3600)} AS win, duration - coalesce(lag(duration) OVER (PARTITION BY key ORDER BY ts, req_id), 0) AS delta,
                                  CASE WHEN lag(req_id) OVER (PARTITION BY key ORDER BY ts, req_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM req WHERE stored),
    h AS (SELECT win, sum(delta) AS delta, sum(fresh) AS fresh FROM d GROUP BY win)
    SELECT win, CAST(sum(delta) OVER (ORDER BY win) AS BIGINT) AS mem, CAST(sum(fresh) OVER (ORDER BY win) AS BIGINT) AS length FROM h""")
def mem_snapshots(spark, sf_dir):
    """Bytes and entries held at the end of each hour."""
    from pyspark.sql.window import Window

    writes = storage.weight_deltas(traffic.matched(spark, sf_dir).where("rule_path IS NOT NULL AND status = 200"), "duration")
    fresh = F.lag("req_id").over(Window.partitionBy("key").orderBy("ts", "req_id")).isNull()
    hourly = writes.withColumn("fresh", F.when(fresh, 1).otherwise(0)).groupBy(F.window("ts", "1 hour").start.alias("win")).agg(F.sum("delta").alias("delta"), F.sum("fresh").alias("fresh"))
    summed = running_sum(hourly, F.to_date("win"), [F.col("win")], F.col("delta"), "mem")
    return running_sum(summed, F.to_date("win"), [F.col("win")], F.col("fresh"), "length").select("win", "mem", "length")


@query("shards_by_weight", f"""
    WITH {LATEST}, w AS (SELECT shard, CAST(sum(weight) AS BIGINT) AS mem FROM latest GROUP BY shard)
    SELECT shard, mem, CAST(row_number() OVER (ORDER BY mem DESC, shard) AS INT) AS place FROM w QUALIFY place = 6""")
def shards_by_weight(spark, sf_dir):
    """The shard at an offset of the list of shards by weight."""
    ordered = policy.fat_shards(storage.shard_weights(traffic.entries(spark, sf_dir)), keys.SHARDS)
    return ordered.where("shard_rank = 6").select("shard", "mem", F.col("shard_rank").alias("place"))


@query("refresh_applied", f"""
    WITH {LATEST}, f AS (SELECT key, arg_max(duration, (ts, req_id)) AS payload FROM req WHERE path = '/purchase' AND client % 5 > 0 GROUP BY key)
    SELECT key, coalesce(payload, duration) AS payload, payload IS NOT NULL AS refreshed FROM latest LEFT JOIN f USING (key)""")
def refresh_applied(spark, sf_dir):
    """Entries refreshed by the fetches of another path, of which some fail."""
    fetches = traffic.log(spark, sf_dir).where("path = '/purchase'").withColumn("status", F.when(F.col("client") % 5 > 0, 200).otherwise(500)).withColumn("payload", F.col("duration"))
    held = traffic.entries(spark, sf_dir).select("key", F.col("duration").alias("payload"))
    return control.refreshed(held, fetches.select("key", "ts", "req_id", "status", "payload"))


@query("unique_names", f"""
    WITH {REQUESTS}, o AS (SELECT backend, path, min(req_id) AS first FROM req GROUP BY backend, path)
    SELECT backend, string_agg(path, ',' ORDER BY first) AS names FROM o GROUP BY backend""")
def unique_names(spark, sf_dir):
    """The different paths of each backend in the order they first came, from two lists put together."""
    first = traffic.log(spark, sf_dir).groupBy("backend", "path").agg(F.min("req_id").alias("first"))
    halves = first.where("first % 2 = 0").unionByName(first.where("first % 2 = 1"))
    listed = halves.groupBy("backend").agg(F.sort_array(F.collect_list(F.struct("first", "path"))).alias("l"))
    return listed.select("backend", F.array_join(F.array_distinct(F.transform("l", lambda x: x["path"])), ",").alias("names"))


@query("backend_gauges", f"""
    WITH {REQUESTS}, w AS (SELECT backend, {window_sql("ts", 86400)} AS win, CAST(count(*) FILTER (status >= 500) AS DOUBLE) / count(*) AS err_rate FROM req GROUP BY ALL),
    l AS (SELECT backend, arg_max(err_rate, win) AS r FROM w GROUP BY backend)
    SELECT backend, CAST(r < 0.2 AS INT) AS healthy, CAST(r >= 0.2 AND r < 0.3 AS INT) AS sick, CAST(r >= 0.3 AS INT) AS dead FROM l""")
def backend_gauges(spark, sf_dir):
    """The state of each backend in its last window, one column for each state."""
    last = health.error_windows(traffic.log(spark, sf_dir), "1 day").groupBy("backend").agg(F.max_by("err_rate", "win").alias("r"))
    r = F.col("r")
    return last.select("backend", (r < 0.2).cast("int").alias("healthy"), ((r >= 0.2) & (r < 0.3)).cast("int").alias("sick"), (r >= 0.3).cast("int").alias("dead"))


@query("probe_rates", f"""
    WITH {REQUESTS} SELECT backend, {window_sql("ts", 3600)} AS win, count(*) FILTER (status < 500) / 3600.0::DOUBLE AS ok_rate, count(*) FILTER (status >= 500) / 3600.0::DOUBLE AS fail_rate FROM req GROUP BY ALL""")
def probe_rates(spark, sf_dir):
    """Successful and failed probes a second."""
    bad = health.is_error(F.col("status"))
    counted = traffic.log(spark, sf_dir).groupBy("backend", F.window("ts", "1 hour").start.alias("win"))
    return counted.agg((F.count_if(~bad) / F.lit(3600.0)).alias("ok_rate"), (F.count_if(bad) / F.lit(3600.0)).alias("fail_rate"))


@query("load_sources", f"""
    WITH {LATEST} SELECT 'dump' AS source, count(*) AS n FROM latest UNION ALL SELECT 'generated', 500""")
def load_sources(spark, sf_dir):
    """A storage that starts from its dump and generated entries."""
    dump = traffic.entries(spark, sf_dir).select(F.lit("dump").alias("source"), "path", "query")
    made = requests.generate(spark, 500).select(F.lit("generated").alias("source"), "path", "query")
    return control.loaded(dump, made, True, True, True).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("gzip_roundtrip", "SELECT page_id, strlen(html) AS n, true AS same FROM pages")
def gzip_roundtrip(spark, sf_dir):
    """Pages compressed and decompressed again."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("body"))
    back = control.decompress(control.compress(pages, "body", "packed"), "packed", "unpacked")
    return back.select("page_id", F.octet_length("body").cast("bigint").alias("n"), (F.col("body") == F.col("unpacked")).alias("same"))
