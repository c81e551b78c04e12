"""Ranges of keys by bounds that are known values, so that a row's range is the same wherever it is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys sampled for each bound.
OVER = 16


def bounds(df: DataFrame, key: str, parts: int) -> list:
    """At most ``parts`` - 1 keys that cut ``df`` into about equal parts, from a sample of OVER keys a part."""
    sample = df.select(F.col(key).alias("k")).filter("k IS NOT NULL").orderBy(F.rand(7)).limit(OVER * parts)
    keys = sorted(r[0] for r in sample.collect())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def part_of(key: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are at or below the key, by a tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        at = (low + high) // 2
        return F.when(key < F.lit(cuts[at]), tree(low, at)).otherwise(tree(at + 1, high))

    return tree(0, len(cuts))


def shuffle_partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_rank(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """Adds each row's place in the order of ``key``, from 0: counts of the ranges before, then a rank within."""
    placed = df.withColumn("_part", part_of(F.col(key), bounds(df, key, shuffle_partitions(df))))
    counts = placed.groupBy("_part").agg(F.count("*").alias("c"))
    # A row for each range, so this window is small.
    before = F.coalesce(F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = F.broadcast(counts.select("_part", before.alias("_before")))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return placed.withColumn("_rank", rank).join(begins, "_part").withColumn(name, F.col("_before") + F.col("_rank") - 1).drop("_part", "_rank", "_before")
