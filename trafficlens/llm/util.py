"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` to the folder of spark.checkpoint.dir and go on from the files.

    The folder is the one the cluster names, which all executors share. Only where none is set, as in tests,
    a local one is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="trafficlens-checkpoint-"))
    return df.checkpoint(eager=True)


_tables: dict[str, tuple[object, object]] = {}


def tables_of(operator: str, of: object, make: Callable):
    """What a Python worker keeps from task to task, for one operator and one `of` (a model, a path): made where it isn't there.

    A worker outlives the stage it was started for. So only the latest operator's tables stay: whoever comes next drops
    them, with `drop_tables` if it needs none itself.
    """
    if operator not in _tables or _tables[operator][0] != of:
        _tables.clear()
        _tables[operator] = of, make()
    return _tables[operator][1]


def drop_tables() -> None:
    _tables.clear()


def give_back() -> None:
    """Return to the system what this worker holds and doesn't use: Arrow's pool, and the pages that the C library keeps when
    arrays and strings are freed (over 50 MB after a batch of texts), which no later stage of the JVM could take."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def given_back(out: Iterator) -> Iterator:
    """The results of a task that needs no tables: those of others go before it, and its own memory after it."""
    drop_tables()
    yield from out
    give_back()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: str | Column = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit("")).cast("binary")


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """A row number that is unique but not dense. Checkpoint the result before it is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def number_distinct(df: DataFrame, keys: list[str], name: str, buckets: int = 1 << 16) -> DataFrame:
    """One row for each distinct combination of `keys`, with an integer name.

    The name is (bucket of the keys' hash, rank of the keys in sorted order inside the bucket), so it depends
    on the data alone: a task that runs again gives the same names. Copies are combined before the shuffle.
    """
    distinct = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets))
    ranked = distinct.withColumn("__b", bucket).withColumn(
        "__r", F.row_number().over(Window.partitionBy("__b").orderBy(*keys))
    )
    return ranked.select(*keys, (F.col("__b") * F.lit(1 << 40) + F.col("__r")).alias(name), F.col("__n"))


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """`df` without the partitioning by `key` (a long) that an aggregate has left it with.

    A join on `key` then shuffles both of its sides, and Spark can split a side's partition that one key makes too
    large. Joined as it is, an aggregate would draw all rows of a key to the task that has its one row.
    """
    return df.withColumn(key, F.bitwise_not(F.bitwise_not(F.col(key))))  # the same value; + 0 would be optimised away


def most_frequent(counts: DataFrame, n: str, word: str, k: int) -> DataFrame:
    """The `k` rows of a table of counts with the largest counts; of equal ones, the first in order of `word`."""
    return counts.orderBy(F.desc(n), word).limit(k)  # each task sends on at most k rows
