"""Running sums, row numbers and exact quantiles over whole tables, in any number of tasks.

Rows are dealt to ranges of their order and written; then the ranges' sums, one row each, give what lies before a range,
and a window within each range does the rest. No task sees more than a range.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.sources.tables import scratch

_PART = "_part"


class Ordered(NamedTuple):
    """rows with `before` (sum of the weights of all earlier rows), and the sum of all weights."""

    rows: DataFrame
    total: int


def running(rows: DataFrame, *order: str, weight: Column | None = None) -> Ordered:
    """`rows` in ascending order of columns that together are unique; each row weighs 1 unless `weight` says otherwise.

    Rows with equal `order` stay in one range, so an order that many rows share needs a further column.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("before", F.lit(1).cast("long") if weight is None else weight.cast("long"))
    dealt = dealt.repartitionByRange(*order).withColumn(_PART, F.spark_partition_id())
    path = scratch(spark, "ordered")
    dealt.write.parquet(path)
    kept = spark.read.schema(dealt.schema).parquet(path)
    sums = sorted(map(tuple, kept.groupBy(_PART).agg(F.sum("before")).collect()))  # one row a range
    offsets, total = [], 0
    for part, n in sums:
        offsets.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(offsets, f"{_PART} int, _start long"))
    earlier = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("before").over(earlier), F.lit(0))
    return Ordered(kept.join(starts, _PART).withColumn("before", before).drop("_start", _PART), total)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with number, from 1, in ascending order of columns that together are unique."""
    return running(rows, *order).rows.withColumnRenamed("before", "number").withColumn("number", F.col("number") + 1)


def quantiles(rows: DataFrame, c: str, shares: dict[str, float]) -> DataFrame:
    """One row with the exact quantiles of a column by name, interpolated between neighbours; null without any value.

    Values are counted, so a task holds no list of them, and a value that many rows have is one row.
    """
    counted = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
    found, total = running(counted, "v", weight=F.col("n"))
    made = []
    for name, share in shares.items():
        at = max(total - 1, 0) * share
        low = F.max(F.when(F.col("before") <= int(at), F.col("v"))).cast("double")
        high = F.max(F.when(F.col("before") <= min(int(at) + 1, max(total - 1, 0)), F.col("v"))).cast("double")
        made.append((low + (high - low) * (at - int(at))).alias(name))
    return found.agg(*made)
