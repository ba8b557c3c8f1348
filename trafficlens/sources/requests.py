"""Request logs as DataFrames: from the events table, from urls, and generated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions import keys


def from_events(events: DataFrame) -> DataFrame:
    """A request log: req_id, ts, path, query, client, backend, status, duration, and its canonical key and shard."""
    number = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    out = events.select(
        F.col("event_id").alias("req_id"), "ts", F.concat(F.lit("/"), "event_type").alias("path"),
        F.concat(F.lit("k="), number).alias("query"), F.col("user_id").alias("client"),
        F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("backend"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.round(F.col("value") * 100).cast("bigint").alias("duration"),
    )
    pairs = keys.sort_pairs(keys.keep_prefixed(keys.parse_pairs(F.col("query")), ["k"]))
    keyed = out.withColumn("key", keys.canonical(pairs))
    return keyed.withColumn("shard", keys.shard_of(F.col("key")))


def generate(spark: SparkSession, n: int, path: str = "/api/v2/pagedata", domain: str = "example.com", partitions: int | None = None) -> DataFrame:
    """`n` consecutive synthetic requests with nested `choice` parameters that hold the row's number.

    Two of the parameters have no "="; with keys concatenated without delimiters their hashed bytes are the same.
    """
    i = F.col("id").cast("string")
    deep = lambda k: "choice" + "[choice]" * k + "[name]"
    # The parameters' names and values, and the headers below.
    parts = [
        F.lit(f"project[id]=285&domain={domain}&language=en"),
        F.lit(f"&{deep(0)}=betting&{deep(1)}=betting_live&{deep(2)}=betting_live_null"),
        F.concat(F.lit(f"&{deep(3)}=betting_live_null_"), i),
        F.concat(F.lit(f"&{deep(4)}betting_live_null_"), i, F.lit("_"), i),
        F.concat(F.lit(f"&{deep(5)}betting_live_null_"), i, F.lit("_"), i, F.lit("_"), i),
        F.lit("&choice" + "[choice]" * 6 + "=null"),
    ]
    head = lambda pairs: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs])
    request = [("Host", "0.0.0.0:8020"), ("Accept-Encoding", "gzip, deflate, br"), ("Accept-Language", "en-US,en;q=0.9"), ("Content-Type", "application/json")]
    response = [("Content-Type", "application/json"), ("Vary", "Accept-Encoding, Accept-Language")]
    return spark.range(0, n, 1, partitions).select(
        F.col("id").alias("req_id"), F.lit(path).alias("path"), F.concat(*parts).alias("query"),
        head(request).alias("req_headers"), F.lit(200).alias("status"), head(response).alias("resp_headers"),
    )


def generate_stream(spark: SparkSession, rows_per_second: int, path: str = "/api/v2/pagedata") -> DataFrame:
    """Synthetic requests without end, by the rate source."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select(
        F.col("value").alias("req_id"), F.col("timestamp").alias("ts"), F.lit(path).alias("path"),
        F.concat(F.lit("project[id]=285&choice[name]=betting_live_null_"), F.col("value").cast("string")).alias("query"), F.lit(200).alias("status"),
    )
