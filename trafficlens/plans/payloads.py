"""Catalogue: payloads and entries in binary form, refresh rollups and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficlens.functions import codec
from trafficlens.operators import refresh
from trafficlens.plans import traffic
from trafficlens.plans.base_sql import LATEST, REQUESTS, window_sql
from trafficlens.plans.registry import query
from trafficlens.sources.config import EVENTS_CONFIG


def _headers(*pairs):
    return F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in pairs])


def _packed(spark, sf_dir):
    """Entries with their payloads; those whose bytes divide by seven have none."""
    asked = _headers(("Accept-Encoding", F.lit("gzip")), ("X-Key", F.col("key")))
    payload = codec.pack_payload(F.col("path"), F.col("query"), asked, F.lit(200), _headers(("Server", F.col("key"))), F.concat("key", F.lit("é")))
    return traffic.entries(spark, sf_dir).withColumn("payload", F.when(F.col("weight") % 7 == 0, F.lit(b"")).otherwise(payload))


@query("payload_roundtrip", f"""
    WITH {LATEST}
    SELECT key, CASE WHEN weight % 7 = 0 THEN 0 ELSE 4 + strlen(path) + 4 + strlen(query) + 4 + (8 + 15 + 4) + (8 + 5 + strlen(key)) + 4 + 4 + (12 + 6 + strlen(key)) + 4 + strlen(key) + 2 END AS n_bytes,
           CASE WHEN weight % 7 > 0 THEN path END AS path, CASE WHEN weight % 7 > 0 THEN query END AS query, CASE WHEN weight % 7 > 0 THEN 'Accept-Encoding=gzip,X-Key=' || key END AS asked,
           CASE WHEN weight % 7 > 0 THEN 200 END AS status, CASE WHEN weight % 7 > 0 THEN 'Server=' || key END AS answered, CASE WHEN weight % 7 > 0 THEN key || 'é' END AS body,
           CASE WHEN weight % 7 = 0 THEN 'payload is empty' END AS error
    FROM latest""")
def payload_roundtrip(spark, sf_dir):
    """Payloads packed and unpacked again; an empty one is an error."""
    rows = _packed(spark, sf_dir).withColumn("n_bytes", F.octet_length("payload").cast("bigint"))
    back = codec.unpack_payloads(rows, "payload", ["key", "n_bytes"])
    line = lambda c: F.array_join(F.transform(c, lambda h: F.concat(h["k"], F.lit("="), h["v"])), ",")
    return back.select(
        "key", "n_bytes", "path", "query", line("request_headers").alias("asked"), "status", line("response_headers").alias("answered"),
        F.col("body").cast("string").alias("body"), "error",
    )


@query("entry_roundtrip", f"""
    WITH {LATEST}
    SELECT CASE WHEN weight % 5 = 0 THEN '/gone' ELSE path END AS rule_path, -req_id AS key, CAST(shard AS BIGINT) AS shard, md5(key) AS fingerprint,
           CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 AS refreshed_at, CAST(CASE WHEN weight % 7 = 0 THEN 0 ELSE 1 END AS BOOLEAN) AS has_payload,
           CASE WHEN weight % 5 = 0 THEN 'rule not found for path: ''/gone''' END AS error
    FROM latest""")
def entry_roundtrip(spark, sf_dir):
    """Entries as bytes and read again; those whose rule is no longer configured are refused."""
    rule = F.when(F.col("weight") % 5 == 0, "/gone").otherwise(F.col("path"))
    at = F.unix_seconds(F.col("ts").cast("timestamp")) * 1_000_000_000
    record = codec.pack_entry(rule, -F.col("req_id"), F.col("shard"), F.unhex(F.md5("key")), at, F.col("payload"))
    back = codec.unpack_entries(_packed(spark, sf_dir).select(record.alias("record")), "record", EVENTS_CONFIG.rules_frame(spark))
    return back.select("rule_path", "key", "shard", F.lower(F.hex("fingerprint")).alias("fingerprint"), "refreshed_at", (F.octet_length("payload") > 0).alias("has_payload"), "error")


_FOUND = "duration % 3 = 0"


def _rollup(seconds):
    def run(spark, sf_dir):
        return refresh.rollup(traffic.log(spark, sf_dir), F.expr(_FOUND), F.col("status") == 200, f"{seconds} seconds")

    return run


for _name, _seconds in (("5s", 5), ("1h", 3600), ("12h", 43_200), ("24h", 86_400)):
    query(f"refresh_rollup_{_name}", f"""
    WITH {REQUESTS} SELECT {window_sql("ts", _seconds)} AS win, count(*) AS scans, count(*) FILTER ({_FOUND}) AS found, count(*) FILTER ({_FOUND} AND status = 200) AS success,
           count(*) FILTER ({_FOUND} AND status <> 200) AS errors FROM req GROUP BY 1""")(_rollup(_seconds))


@query("refresh_two_limits", f"""
    WITH {REQUESTS}, s AS (SELECT req_id, duration, {window_sql("ts", 3600)} AS win, row_number() OVER (PARTITION BY {window_sql("ts", 3600)} ORDER BY md5('scan:' || req_id), req_id) AS turn FROM req),
    u AS (SELECT req_id, win, CAST(row_number() OVER (PARTITION BY win ORDER BY turn) AS INT) AS turn FROM s WHERE turn <= 10 AND {_FOUND})
    SELECT req_id, win, turn FROM u WHERE turn <= 3""")
def refresh_two_limits(spark, sf_dir):
    """At most ten scans an hour, drawn at random, and of the entries that they find stale at most three fetches."""
    log = traffic.log(spark, sf_dir).select("req_id", "duration", F.window("ts", "1 hour").start.alias("win"), F.md5(F.concat(F.lit("scan:"), F.col("req_id").cast("string"))).alias("draw"))
    scanned = refresh.limited(log, ["win"], [F.col("draw"), F.col("req_id")], 10).withColumnRenamed("turn", "scan")
    return refresh.limited(scanned.where(_FOUND), ["win"], [F.col("scan")], 3).select("req_id", "win", "turn")
