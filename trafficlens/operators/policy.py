"""Recency and frequency policy: LRU ranks and victims, eviction, stack distance, TinyLFU admission."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trafficlens.operators.prefix_sum import running_sum

FAT_SHARDS = 348  # 17 % of 2,048


def lru_ranks(entries: DataFrame) -> DataFrame:
    """Add recency: the place of each entry in its shard's list, 0 for the most recently used."""
    order = Window.partitionBy("shard").orderBy(F.desc("ts"), F.desc("req_id"))
    return entries.withColumn("recency", (F.row_number().over(order) - 1).cast("bigint"))


def victims(entries: DataFrame) -> DataFrame:
    """The back of each shard's list: its least recently used entry. A partial aggregate, no sort."""
    oldest = entries.groupBy("shard").agg(F.min(F.struct("ts", "req_id", "key")).alias("v"))
    return oldest.select("shard", F.col("v.key").alias("victim"), F.col("v.ts").alias("ts"))


def neighbour_victims(entries: DataFrame, shards: int) -> DataFrame:
    """The victim for a newcomer to each shard: its own, else that of shard + 1, else that of shard - 1.

    Shard 0 is never a left neighbour. Each victim is offered to at most three shards, so this is a shuffle of
    three rows per shard and no range join.
    """
    own = victims(entries)
    offers = own.select(
        "victim", F.col("shard").alias("from_shard"),
        F.explode(F.array(
            F.struct(F.col("shard").alias("shard"), F.lit(0).alias("turn")),
            F.struct((F.col("shard") - 1).alias("shard"), F.lit(1).alias("turn")),
            F.struct(F.when(F.col("shard") > 0, F.col("shard") + 1).alias("shard"), F.lit(2).alias("turn")),
        )).alias("o"),
    )
    real = offers.where(f"o.shard IS NOT NULL AND o.shard >= 0 AND o.shard < {shards}")
    best = real.groupBy(F.col("o.shard").alias("shard")).agg(F.min(F.struct("o.turn", "from_shard", "victim")).alias("b"))
    return best.select("shard", F.col("b.from_shard").alias("from_shard"), F.col("b.victim").alias("victim"))


#: Bytes of a pointer, of the balancer itself (without its array of shards) and of one shard's node.
POINTER_BYTES, BALANCER_BYTES, NODE_BYTES = 8, 40, 40


def balancer_overhead(weights: DataFrame, shards: int) -> DataFrame:
    """The bytes that the lists themselves take: for all shards a pointer twice and a node, and a pointer for each listed one."""
    fixed = BALANCER_BYTES + shards * (2 * POINTER_BYTES + NODE_BYTES)
    return weights.agg((F.lit(fixed) + F.count(F.lit(1)) * F.lit(POINTER_BYTES)).cast("bigint").alias("mem"))


def fat_shards(weights: DataFrame, top: int = FAT_SHARDS, ascending: bool = False) -> DataFrame:
    """The heaviest shards in order (or the lightest), ties by number. At most as many rows as there are shards."""
    order = Window.orderBy(F.asc("mem") if ascending else F.desc("mem"), "shard")
    return weights.withColumn("shard_rank", F.row_number().over(order)).where(F.col("shard_rank") <= top)


def evict(entries: DataFrame, excess: Column | int, order: str = "reference", top: int = FAT_SHARDS) -> DataFrame:
    """The entries that go until `excess` bytes are free, with freed_before: what went before each.

    Shards go from the heaviest; "documented" takes a shard's least recently used entries first, "reference" every
    other one from the most recently used (places 0, 2, 4, ...). An entry goes while less than the excess is free.
    """
    ranked = lru_ranks(entries)
    weights = entries.groupBy("shard").agg(F.sum("weight").alias("mem"))
    fat = fat_shards(weights, top).select("shard", "shard_rank")
    lined = ranked.join(F.broadcast(fat), "shard")  # one row per shard
    if order == "reference":
        lined, by = lined.where("recency % 2 = 0"), [F.col("recency").asc()]
    elif order == "documented":
        by = [F.col("recency").desc()]
    else:
        raise ValueError(f"no such order: {order}")
    run = running_sum(lined, F.col("shard_rank"), by, F.col("weight"), "freed")
    limit = F.lit(excess) if isinstance(excess, int) else excess
    return run.withColumn("freed_before", F.col("freed") - F.col("weight")).where(F.col("freed_before") < limit).drop("freed")


def stack_distances(accesses: DataFrame, shard: str = "shard") -> DataFrame:
    """(shard, req_id, distance): for each access, how many different keys its shard saw since the key's last access;
    null for a first access. An LRU list of n entries hits exactly the accesses with a distance below n.

    Per shard, a Fenwick tree over positions marks each key's last access: n log n instead of a range join. A shard's
    accesses must fit one task; take more shards for longer logs.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "req_id"])
        n = len(frame)
        tree = [0] * (n + 1)

        def add(i: int, by: int) -> None:
            i += 1
            while i <= n:
                tree[i] += by
                i += i & -i

        def upto(i: int) -> int:
            total = 0
            while i > 0:
                total += tree[i]
                i -= i & -i
            return total

        last: dict = {}
        out = []
        for i, key in enumerate(frame["key"]):
            before = last.get(key)
            out.append(None if before is None else upto(n) - upto(before + 1))
            if before is not None:
                add(before, -1)
            add(i, 1)
            last[key] = i
        return pd.DataFrame({"shard": frame["shard"].to_numpy(), "req_id": frame["req_id"].to_numpy(), "distance": pd.array(out, dtype="Int64")})

    rows = accesses.select(F.col(shard).cast("bigint").alias("shard"), "req_id", "ts", "key")
    return rows.groupBy("shard").applyInPandas(run, "shard bigint, req_id bigint, distance bigint")


def counted(log: DataFrame, counts: str = "writes") -> DataFrame:
    """The requests that frequencies count: those that were written to the storage (a rule, and status 200), or all."""
    if counts not in ("writes", "reads"):
        raise ValueError(f"no such counts: {counts}")
    return log.where("rule_path IS NOT NULL AND status = 200") if counts == "writes" else log


def window_frequency(accesses: DataFrame, width: str = "1 minute") -> DataFrame:
    """How often each key came in each window: exact counts in place of a sketch."""
    return accesses.groupBy("key", F.window("ts", width).start.alias("win")).agg(F.count(F.lit(1)).alias("freq"))


def frequency_estimate(frequency: DataFrame, width_seconds: int = 60) -> DataFrame:
    """Add estimate: (this window + the one before) / 2 as integers. A window that is not adjacent counts as zero."""
    turn = Window.partitionBy("key").orderBy("win")
    adjacent = F.unix_seconds(F.col("win").cast("timestamp")) - F.unix_seconds(F.lag("win").over(turn).cast("timestamp")) == width_seconds
    before = F.coalesce(F.when(adjacent, F.lag("freq").over(turn)), F.lit(0))
    return frequency.withColumn("prev", before).withColumn("estimate", F.floor((F.col("freq") + before) / 2).cast("bigint"))


def admissions(candidates: DataFrame, victims_: DataFrame, estimates: DataFrame) -> DataFrame:
    """Whether each candidate (key, shard, win) is at least as frequent as its shard's victim in the same window."""
    known = estimates.select("key", "win", "estimate")
    paired = candidates.join(victims_.select("shard", "victim"), "shard").join(known.withColumnRenamed("estimate", "new_freq"), ["key", "win"])
    old = known.select(F.col("key").alias("victim"), "win", F.col("estimate").alias("old_freq"))
    out = paired.join(old, ["victim", "win"], "left").withColumn("old_freq", F.coalesce("old_freq", F.lit(0)))
    return out.withColumn("admitted", F.col("new_freq") >= F.col("old_freq"))


def first_seen(accesses: DataFrame, width: str = "1 minute") -> DataFrame:
    """The doorkeeper, exactly: the first access of each key in each window."""
    seen = accesses.groupBy("key", F.window("ts", width).start.alias("win")).agg(F.min(F.struct("ts", "req_id")).alias("f"))
    return seen.select("key", "win", F.col("f.req_id").alias("req_id"))


def sketch(accesses: DataFrame, eps: float = 1e-3, confidence: float = 0.99, seed: int = 7) -> DataFrame:
    """A count-min sketch of the keys in each day, for logs whose exact counts would be too many rows."""
    by_day = accesses.groupBy(F.to_date("ts").alias("day"))
    return by_day.agg(F.count(F.lit(1)).alias("accesses"), F.count_min_sketch(F.col("key"), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def eviction_stats(evicted: DataFrame, width: str = "5 seconds") -> DataFrame:
    """Items and bytes evicted in each window."""
    return evicted.groupBy(F.window("ts", width).start.alias("win")).agg(F.count(F.lit(1)).alias("items"), F.sum("weight").alias("mem"))
