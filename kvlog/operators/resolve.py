"""Last-writer-wins resolution and merges of runs, as DataFrame plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per_key(log: DataFrame, *order: Column, key: str = "key") -> DataFrame:
    """The first row of each key by ``order`` (the largest seq by default). The limit on row_number is
    applied before the shuffle as well, so each task sends a row per key."""
    ranked = Window.partitionBy(key).orderBy(*(order or (F.col("seq").desc(),)))
    return log.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def newest_narrow(log: DataFrame, key: str = "key") -> DataFrame:
    """The same for a plain log, by a partial and final aggregate."""
    top = F.max_by(F.struct("value", "is_deleted", "seq"), "seq").alias("top")
    return log.groupBy(key).agg(top).select(key, "top.*")


def live(resolved: DataFrame) -> DataFrame:
    return resolved.filter(~F.col("is_deleted"))


def shadowed(log: DataFrame) -> DataFrame:
    """Writes that a later one of the same key hides."""
    return log.join(newest_per_key(log).select("key", "seq"), ["key", "seq"], "left_anti")


def kway_merge(runs: list[DataFrame]) -> DataFrame:
    """Runs from the newest to the oldest as one; a key's row is that of the first run that has it.
    Tombstones stay. One aggregation, however many runs there are."""
    ranked = [r.withColumn("_source", F.lit(i)) for i, r in enumerate(runs)]
    return newest_per_key(reduce(DataFrame.unionByName, ranked), F.col("_source").asc()).drop("_source")


def two_way_merge(newer: DataFrame, older: DataFrame, key: str = "key") -> DataFrame:
    """A full outer join that takes the newer run's columns where it has the key; null values included."""
    rest = [c for c in newer.columns if c != key]
    left = newer.select(key, F.struct(*rest).alias("_newer"))
    right = older.select(key, F.struct(*rest).alias("_older"))
    return left.join(right, key, "full").select(key, F.coalesce("_newer", "_older").alias("_row")).select(key, "_row.*")


def concat_runs(runs: list[DataFrame]) -> DataFrame:
    """Runs with disjoint key ranges."""
    return reduce(DataFrame.unionByName, runs)


def compact(runs: DataFrame, drop_tombstones: bool, *order: Column) -> DataFrame:
    """The rows that stay when runs are merged; tombstones go only if nothing older lies below."""
    merged = newest_per_key(runs, *order)
    return live(merged) if drop_tombstones else merged
