"""Traffic metrics over windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.scalars import safe_divide

COUNTERS = ("total", "hits", "misses", "errors", "proxied", "duration")


def counters(requests: DataFrame, width: str, by: list[str] | None = None) -> DataFrame:
    """Counts of outcomes and the sum of durations in each window. Partial aggregates; they add up (see rolled_up)."""
    named = lambda o: F.sum(F.when(F.col("outcome") == o, 1).otherwise(0)).cast("bigint")
    return requests.groupBy(F.window("ts", width).start.alias("win"), *(by or [])).agg(
        F.count(F.lit(1)).alias("total"), named("hit").alias("hits"), named("miss").alias("misses"),
        named("error").alias("errors"), named("proxied").alias("proxied"), F.sum("duration").alias("duration"),
    )


def rolled_up(partial: DataFrame, width: str) -> DataFrame:
    """Counters of wider windows from those of narrower ones."""
    wide = partial.groupBy(F.window("win", width).start.alias("wide"))
    return wide.agg(*[F.sum(c).alias(c) for c in COUNTERS]).withColumnRenamed("wide", "win")


def with_rates(counted: DataFrame, seconds: int) -> DataFrame:
    """Add rps and the average duration; avg_duration is 0 where nothing came."""
    return counted.withColumn("rps", F.col("total") / F.lit(float(seconds))).withColumn(
        "avg_duration", safe_divide(F.col("duration"), F.col("total"))
    )


def with_integer_average(counted: DataFrame, hours: int) -> DataFrame:
    """The long summaries: requests a second over the hours, and the average duration as a whole number."""
    return counted.withColumn("avg_rps", F.col("total") / F.lit(3600.0 * hours)).withColumn(
        "avg_duration", F.when(F.col("total") > 0, F.expr("duration div total")).otherwise(F.lit(0).cast("bigint"))
    )


def hit_rate(counted: DataFrame) -> DataFrame:
    """Add hit_rate in percent; a window without hits and misses has 0."""
    return counted.withColumn("hit_rate", F.lit(100.0) * F.col("hits") / F.greatest((F.col("hits") + F.col("misses")).cast("double"), F.lit(1e-9)))


def error_rate(counted: DataFrame) -> DataFrame:
    """Add error_rate: errors as a percentage of proxied requests, with the denominator held above zero."""
    return counted.withColumn("error_rate", F.lit(100.0) * F.col("errors") / F.greatest(F.col("proxied").cast("double"), F.lit(1e-9)))


def repeated_messages(log: DataFrame, message: str, width: str = "5 seconds") -> DataFrame:
    """How often each message came in each window."""
    return log.groupBy(F.window("ts", width).start.alias("win"), F.col(message).alias("message")).agg(F.count(F.lit(1)).alias("times"))


def per_second(counted: DataFrame, columns: list[str], seconds: int) -> DataFrame:
    """Add <column>_rate: each counter per second."""
    for c in columns:
        counted = counted.withColumn(f"{c}_rate", F.col(c) / F.lit(float(seconds)))
    return counted


def last_values(series: DataFrame, by: list[str], value: str) -> DataFrame:
    """The latest value of each series, as a gauge shows it."""
    return series.groupBy(*by).agg(F.max_by(value, "win").alias(value), F.max("win").alias("win"))


def exposition(values: DataFrame, prefix: str = "cache_") -> DataFrame:
    """Lines of a text exposition from columns (name, value); whole numbers without a decimal point."""
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    return values.select(F.concat(F.lit(prefix), "name", F.lit(" "), number).alias("line"))
