"""Data skipping by zone maps."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import bounds, part_of, shuffle_partitions


def overlapping(zones: DataFrame, lower, upper) -> DataFrame:
    """Zones that may hold keys of [lower, upper)."""
    return zones.filter((F.col("last_key") >= F.lit(lower)) & (F.col("first_key") < F.lit(upper)))


def find_run(last_keys: list[bytes], key: bytes) -> int | None:
    """Of sorted, disjoint runs the first whose last key is at or after ``key``; None past the end."""
    at = bisect_left(last_keys, key)
    return at if at < len(last_keys) else None


def find_block(probes: DataFrame, zones: DataFrame, key: str = "key", block: str = "block") -> DataFrame:
    """Every probe with the first block whose last key is at or after it; null past the end or for a null key.

    Distinct keys and zones are merged into one order and each key takes the next zone's block, in two
    steps: within ranges of keys, then across the ranges, so that no task holds all rows and nothing is
    paired. The ranges' bounds are values, so every step sees the same ranges."""
    points = probes.select(F.col(key).alias("k")).filter("k IS NOT NULL").distinct()
    ends = zones.select(F.col("last_key").alias("k"), F.col(block).cast("long").alias("b"))
    cuts = bounds(ends, "k", shuffle_partitions(probes))
    both = points.select("k", F.lit(None).cast("long").alias("b"), F.lit(1).alias("probe")).unionAll(ends.select("k", "b", F.lit(0)))
    ranged = both.withColumn("part", part_of(F.col("k"), cuts))
    behind = Window.partitionBy("part").orderBy(F.col("k").desc(), F.col("probe")).rowsBetween(Window.unboundedPreceding, 0)
    near = ranged.withColumn("found", F.last("b", ignorenulls=True).over(behind)).filter("probe = 1")
    heads = ends.groupBy(part_of(F.col("k"), cuts).alias("part")).agg(F.min(F.struct("k", "b"))["b"].alias("first"))
    # One row for each range, so a window over all of them is small.
    parts = probes.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("part")).join(heads, "part", "left")
    later = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("part", F.last("first", ignorenulls=True).over(later).alias("carried"))
    found = near.join(F.broadcast(carry), "part").select(F.col("k").alias(key), F.coalesce("found", "carried").alias(block))
    return probes.join(found, key, "left")
