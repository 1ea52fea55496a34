"""Order-dependent work without a single-task window.

A plain ``Window.partitionBy(k).orderBy(...)`` sorts a whole key in one task. Here the
rows are range-partitioned on (keys, order) first, so a key holding any share of the data
is spread over many buckets; only one small row per (key, bucket) is ordered afterwards.
The bucketed rows are checkpointed: range bounds are sampled, so both passes must read
the same assignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tamarisk.session import materialise

BUCKET = "_range_bucket"
KEY = "_range_key"


def range_bucketed(df: DataFrame, keys: list[str], order: list[Column | str], buckets: int | None = None) -> DataFrame:
    """Rows with their bucket, and the keys as one struct (so that a null key is a key like any other)."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *keys, *order).withColumn(BUCKET, F.spark_partition_id())
    return materialise(cut.withColumn(KEY, F.struct(*keys) if keys else F.lit(0)))


def running_totals(df: DataFrame, keys: list[str], order: list[Column | str], totals: dict[str, Column],
                   buckets: int | None = None) -> DataFrame:
    """Adds inclusive running sums of each expression, per key, in the given order."""
    cut = range_bucketed(df, keys, order, buckets)
    on = [KEY, BUCKET]
    per_bucket = cut.groupBy(*on).agg(*[F.sum(e).alias(n) for n, e in totals.items()])
    earlier = W.partitionBy(KEY).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(*on, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals])
    inside = W.partitionBy(*on).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(e).over(inside).alias(f"_inside_{n}") for n, e in totals.items()])
    out = local.join(offsets, on)
    return out.select(*df.columns, *[(F.col(f"_inside_{n}") + F.col(f"_before_{n}")).alias(n) for n in totals])


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str, buckets: int | None = None) -> DataFrame:
    """Adds a 1-based row number per key."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")}, buckets)


def extreme_of_each(df: DataFrame, keys: list[str], order: list[str], last: bool = True) -> DataFrame:
    """The last (or first) row of each key in the given order; of rows alike in it the greatest (or smallest).

    The first column of the order is a number or a time, whose extreme combines in hash maps before the
    shuffle; only the rows that reach it are compared whole. However many rows of a key reach it (a bulk
    load stamps one time on all), each task sends one of them on.
    """
    pick = F.max if last else F.min
    rest = [*order[1:], *[c for c in df.columns if c not in keys and c not in order[1:]]]
    ends = df.groupBy(*keys).agg(pick(order[0]).alias("_end"))
    at_end = df.join(ends, keys).where(F.col(order[0]).eqNullSafe(F.col("_end")))
    one = at_end.groupBy(*keys).agg(pick(F.struct(*rest)).alias("_c"))
    return one.select(*keys, "_c.*").select(*df.columns)


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: list[str],
                  prefix: str = "prev_", buckets: int | None = None) -> DataFrame:
    """Adds each value column of the previous row of the same key (null on the first row)."""
    cut = range_bucketed(df, keys, order, buckets)
    on = [KEY, BUCKET]
    row = F.struct(*values)
    tails = cut.groupBy(*on).agg(F.max_by(row, F.struct(*order)).alias("_tail"))
    carried = tails.select(*on, F.lag("_tail").over(W.partitionBy(KEY).orderBy(BUCKET)).alias("_carried"))
    local = cut.withColumn("_local", F.lag(row).over(W.partitionBy(*on).orderBy(*order)))
    out = local.join(carried, on).withColumn("_prev", F.coalesce("_local", "_carried"))
    return out.select(*df.columns, *[F.col("_prev")[v].alias(prefix + v) for v in values])
