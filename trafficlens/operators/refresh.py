"""Staleness: parameters, probability and choice of the entries to refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trafficlens.sources.config import Config


def with_parameters(entries: DataFrame, rules: DataFrame, config: Config, path: str = "path") -> DataFrame:
    """Add refreshable, ttl_ns, beta and coefficient of each entry's rule.

    A rule with refresh settings that aren't enabled is never refreshed; a zero in them, and a rule without them,
    takes the global value.
    """
    own = rules.select(
        F.col("path").alias("__path"), F.coalesce("refresh_present", F.lit(False)).alias("__present"), F.col("refresh_enabled").alias("__on"),
        *[F.when(F.col("refresh_present") & (F.col(c) > 0), F.col(c)).alias(f"__{c}") for c in ("ttl_ns", "beta", "coefficient")],
    )
    joined = entries.join(F.broadcast(own), F.col(path) == F.col("__path"), "left")
    fallback = {"ttl_ns": F.lit(config.ttl_ns).cast("bigint"), "beta": F.lit(config.beta), "coefficient": F.lit(config.coefficient)}
    out = joined.withColumn("refreshable", ~F.coalesce(F.col("__present"), F.lit(False)) | F.coalesce(F.col("__on"), F.lit(False)))
    for c, value in fallback.items():
        out = out.withColumn(c, F.coalesce(F.col(f"__{c}"), value))
    return out.drop("__path", "__present", "__on", "__ttl_ns", "__beta", "__coefficient")


def with_probability(entries: DataFrame, elapsed_ns: Column) -> DataFrame:
    """Add elapsed_ns, stale (at least ttl * coefficient old) and probability: 1 - exp(-beta * elapsed / ttl), with the
    quotient held between 0 and 1, and 0 for what is not stale or not refreshable."""
    aged = entries.withColumn("elapsed_ns", elapsed_ns)
    stale = F.col("refreshable") & (F.col("elapsed_ns") >= F.floor(F.col("ttl_ns") * F.col("coefficient")).cast("bigint"))
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("elapsed_ns") / F.col("ttl_ns")))
    p = F.lit(1.0) - F.exp(-F.col("beta") * x)
    return aged.withColumn("stale", stale).withColumn("probability", F.when(stale, p).otherwise(F.lit(0.0)))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the hash of its arguments: the draw of a run that can be repeated."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def candidates(scored: DataFrame, draw: Column) -> DataFrame:
    """The entries that a scan would refresh."""
    return scored.where(draw < F.col("probability"))


def limited(df: DataFrame, by: list[str], order: list[Column], rate: int) -> DataFrame:
    """At most `rate` rows of each group, in order: a rate limit over windows of time."""
    turn = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= rate)


def rollup(scans: DataFrame, found: Column, success: Column, width: str) -> DataFrame:
    """Scans, entries found stale, and refreshes that succeeded and failed, in each window."""
    return scans.groupBy(F.window("ts", width).start.alias("win")).agg(
        F.count(F.lit(1)).alias("scans"), F.count_if(found).alias("found"), F.count_if(found & success).alias("success"), F.count_if(found & ~success).alias("errors")
    )
