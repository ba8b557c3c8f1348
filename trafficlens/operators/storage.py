"""Keyed storage as relational operators: hits and misses, kinds of writes, latest entries, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.scalars import entry_weight
from trafficlens.operators.prefix_sum import as_of, running_sum, time_slice


def match_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Add rule_path: the rule whose path equals the request's, null if there is none. Rules are configuration: they
    fit a broadcast by nature."""
    return requests.join(F.broadcast(rules.select(F.col("path").alias("rule_path"))), F.col("path") == F.col("rule_path"), "left")


def unmatched(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """The requests without a rule, which are passed on as they are."""
    return requests.join(F.broadcast(rules.select("path")), "path", "left_anti")


def outcomes(matched: DataFrame, epoch: str | None = None) -> DataFrame:
    """Add stored and outcome: proxied (no rule), hit, error (a miss with a status other than 200) or miss.

    A request hits if its key was stored before: by an earlier request with a rule and status 200, in the same epoch.
    The first of those is found by an aggregate that is combined before the shuffle, so a hot key is no window over
    all its requests. Ties in time go by req_id.
    """
    by = ["key"] + ([epoch] if epoch else [])
    flagged = matched.withColumn("stored", F.col("rule_path").isNotNull() & (F.col("status") == 200))
    first = flagged.where("stored").groupBy(*by).agg(F.min(F.struct("ts", "req_id")).alias("__first"))
    earlier = F.coalesce(F.col("__first") < F.struct("ts", "req_id"), F.lit(False))
    outcome = (
        F.when(F.col("rule_path").isNull(), "proxied").when(earlier, "hit").when(F.col("status") != 200, "error").otherwise("miss")
    )
    return flagged.join(first, by, "left").withColumn("outcome", outcome).drop("__first")


def outcomes_by_fingerprint(matched: DataFrame, fingerprint: str) -> DataFrame:
    """Add outcome as outcomes() does, but an entry counts only if its fingerprint is the request's: of requests with one
    key and different fingerprints, each that is stored takes the place of the other's entry."""
    stored = F.col("rule_path").isNotNull() & (F.col("status") == 200)
    held = as_of(matched, "key", stored, F.col(fingerprint), "__there")
    outcome = (
        F.when(F.col("rule_path").isNull(), "proxied").when(F.col("__there") == F.col(fingerprint), "hit")
        .when(F.col("status") != 200, "error").otherwise("miss")
    )
    return held.withColumn("outcome", outcome).drop("__there")


def walk(entries: DataFrame, stop: Column) -> DataFrame:
    """Each shard's entries in order of their keys, up to and with the first for which `stop` holds. No shard is sorted:
    the first such key is a minimum."""
    first = entries.where(stop).groupBy("shard").agg(F.min("key").alias("__stop"))
    return entries.join(first, "shard", "left").where("__stop IS NULL OR key <= __stop").drop("__stop")


def classify_sets(stored: DataFrame, payload: str, fingerprint: str | None = None) -> DataFrame:
    """Add kind: what each write does to its key: insert (nothing there), collision (another fingerprint is there and
    is replaced), touch (same payload) or update (another one)."""
    before = F.col("__last")
    held = F.struct(F.col(payload).alias("payload"), *([F.col(fingerprint).alias("fingerprint")] if fingerprint else []))
    clash = ~before["fingerprint"].eqNullSafe(F.col(fingerprint)) if fingerprint else F.lit(False)
    kind = (
        F.when(before.isNull(), "insert").when(clash, "collision")
        .when(before["payload"].eqNullSafe(F.col(payload)), "touch").otherwise("update")
    )
    return as_of(stored, "key", F.lit(True), held, "__last").withColumn("kind", kind).drop("__last")


def collisions(entries: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Keys under which different fingerprints were seen, and how many."""
    counted = entries.groupBy(key).agg(F.countDistinct(fingerprint).alias("fingerprints"), F.count(F.lit(1)).alias("requests"))
    return counted.where("fingerprints > 1")


def latest_entries(stored: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The last write of each key: the state of the storage at the end. One partial aggregate, no sort."""
    columns = ["ts", "req_id", "shard", "path", "query", *(extra or [])]
    last = stored.groupBy("key").agg(F.max(F.struct(*columns)).alias("e"), F.count(F.lit(1)).alias("writes"))
    return last.select("key", "writes", *[F.col(f"e.{c}").alias(c) for c in columns])


def weighed(entries: DataFrame, body: Column) -> DataFrame:
    """Add weight: the bytes each entry takes."""
    return entries.withColumn("weight", entry_weight(F.col("path"), F.col("query"), body))


def shard_weights(entries: DataFrame) -> DataFrame:
    """Entries and bytes of each shard."""
    return entries.groupBy("shard").agg(F.count(F.lit(1)).alias("entries"), F.sum("weight").alias("mem"))


def removed(entries: DataFrame, removals: DataFrame) -> DataFrame:
    """The entries whose key is not removed."""
    return entries.join(removals.select("key").distinct(), "key", "left_anti")


def weight_deltas(writes: DataFrame, weight: str) -> DataFrame:
    """Add delta: how each write changes the bytes of its shard (its weight less that of the key's write before)."""
    held = as_of(writes, "key", F.lit(True), F.col(weight), "__last")
    return held.withColumn("delta", F.col(weight) - F.coalesce("__last", F.lit(0))).drop("__last")


def clear_epochs(requests: DataFrame, is_clear: Column) -> DataFrame:
    """Add epoch: how many clears came up to each request. Minutes are summed first, then each minute by itself."""
    value = F.when(is_clear, 1).otherwise(0).cast("bigint")
    return running_sum(requests, time_slice(width="minute"), [F.col("ts"), F.col("req_id")], value, "epoch")


def one_per_shard(entries: DataFrame, seed: str) -> DataFrame:
    """A random entry of each shard: the one with the least seeded hash, so that a run can be repeated."""
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col("key")))
    picked = entries.groupBy("shard").agg(F.min(F.struct(draw.alias("h"), F.col("key").alias("key"))).alias("p"))
    return picked.select("shard", F.col("p.key").alias("key"))
