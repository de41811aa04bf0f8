"""Connected components by alternating large-star and small-star joins; only partially aggregated groupings and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. Large star links every larger neighbour of u to u's least neighbour, small star every smaller one."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        made = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return made.where("u <> v").distinct()


def _done(edges: DataFrame) -> bool:
    """True if every node is either a root or has one parent that is a root: one grouping tells."""
    child, parent = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    seen = child.union(parent).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """`edges` (u, v: long) to (u, root): every node of an edge with the least node it is joined to."""
    turned = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(turned.distinct(), label)
    while not _done(now):  # about log2(diameter) rounds
        before, now = now, materialize(_star(_star(now, True), False), label)
        discard(before)
    return now.union(now.select(F.col("v").alias("u"), "v").distinct()).withColumnRenamed("v", "root")
