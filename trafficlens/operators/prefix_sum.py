"""Running sums and last values over a total order, without sorting all rows of a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_sum(df: DataFrame, slice_: Column, order: list[Column], value: Column, name: str, within: list[str] | None = None) -> DataFrame:
    """Add `name`: the sum of `value` over the rows before and including each, in the order (slice_, *order).

    `slice_` must grow with the order (a day, a shard's rank). Sums of slices are added up first, which takes one
    row per slice; then each slice is summed by itself, so slices are spread over tasks. `within` starts anew for
    each combination of those columns.
    """
    keys = within or []
    marked = df.withColumn("__slice", slice_).withColumn("__value", value)
    sums = marked.groupBy(*keys, "__slice").agg(F.sum("__value").alias("__sum"))
    ahead = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__ahead", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = marked.join(sums, [*keys, "__slice"]).withColumn(name, F.col("__ahead") + F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return out.drop("__slice", "__value", "__ahead")


def time_slice(ts: str = "ts", width: str = "hour") -> Column:
    """A slice that grows with time. A year has 8,760 hours, or half a million minutes, however long the log."""
    return F.date_trunc(width, F.col(ts))


def as_of(rows: DataFrame, key: str | list[str], is_write: Column, value: Column, name: str, order: tuple[str, ...] = ("ts", "req_id"), slice_: Column | None = None) -> DataFrame:
    """Add `name`: the value of the key's last write before each row, in the given order; null if there is none.

    Made in two steps, so that a hot key is no window over all its rows: the last write of each slice is carried from
    slice to slice (a row for each key and slice), and only a slice's own rows are walked. `slice_` must grow with the
    order; without it slices are hours of the first column. Null keys are one key; rows of equal order go in any."""
    keys = [key] if isinstance(key, str) else key
    at = F.struct(*order)
    named = [f"__key{i}" for i in range(len(keys))]
    marked = rows.withColumn("__write", F.when(is_write, F.struct(value.alias("v")))).withColumn("__slice", time_slice(order[0]) if slice_ is None else slice_)
    slices = marked.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.col("__slice").alias("__at")).agg(
        F.max_by("__write", F.when(F.col("__write").isNotNull(), at)).alias("__last")
    )
    carried = Window.partitionBy(*named).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.select(*named, "__at", F.last("__last", ignorenulls=True).over(carried).alias("__before"))
    same = F.col("__slice").eqNullSafe(F.col("__at"))
    for k, n in zip(keys, named):
        same = same & F.col(k).eqNullSafe(F.col(n))
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.coalesce(F.last("__write", ignorenulls=True).over(inside), F.col("__before"))
    known = marked.join(before, same).withColumn("__found", found["v"])
    return known.drop("__write", "__slice", "__before", "__at", *named).withColumnRenamed("__found", name)
