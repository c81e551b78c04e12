"""How entries are laid out: memtables, blocks, zone maps, files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import shuffle_partitions

#: Two length prefixes and one offset of 16 bits for each entry, and the count of a block.
ENTRY_OVERHEAD, BLOCK_OVERHEAD = 6, 2


def entry_bytes(key: Column, value: Column) -> Column:
    return F.octet_length(key) + F.octet_length(value)


def folded(df: DataFrame, by: str, order: str, value: str, start: Callable[[], Callable], name: str, kind: str) -> DataFrame:
    """Adds a column: for the rows of each group in order, what a function made by ``start`` gives for
    ``value``. Groups are sorted and read as streams, so that of a group only the function's state is held."""
    at_by, at_value = df.columns.index(by), df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, step = None, None
        for batch in batches:
            out = []
            for group, x in zip(batch.column(at_by).to_pylist(), batch.column(at_value).to_pylist(), strict=True):
                if step is None or group != own:
                    own, step = group, start()
                out.append(step(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` {kind}"
    return df.repartition(shuffle_partitions(df), by).sortWithinPartitions(by, order).mapInArrow(run, schema)


def greedy(capacity: int, fixed: int = 0) -> Callable[[int], int]:
    """A function that gives the container of each size in order: a new one begins when an item doesn't fit."""
    at, used = 0, fixed

    def step(size: int) -> int:
        nonlocal at, used
        if used > fixed and used + size > capacity:
            at, used = at + 1, fixed
        used += size
        return at

    return step


def greedy_layout(df: DataFrame, by: str, order: str, size: str, capacity: int, fixed: int = 0, name: str = "container") -> DataFrame:
    """``greedy`` within each group of ``by`` (a run, a writer), whose rows come one after the other."""
    return folded(df, by, order, size, lambda: greedy(capacity, fixed), name, "bigint")


def freeze_layout(writes: DataFrame, by: str, capacity: int) -> DataFrame:
    """The memtable each write lands in: every write counts, overwrites too."""
    sized = writes.withColumn("_size", entry_bytes(F.col("key"), F.col("value")).cast("long"))
    return greedy_layout(sized, by, "seq", "_size", capacity, name="memtable_id").drop("_size")


def block_layout(entries: DataFrame, by: str, block_bytes: int) -> DataFrame:
    """The block each entry of a sorted run lands in."""
    sized = entries.withColumn("_size", (entry_bytes(F.col("key"), F.col("value")) + ENTRY_OVERHEAD).cast("long"))
    return greedy_layout(sized, by, "key", "_size", block_bytes, BLOCK_OVERHEAD, "block").drop("_size")


def fixed_blocks(entries: DataFrame, by: str, block_bytes: int, width: int) -> DataFrame:
    """The same for entries of one width: a block holds a fixed number of them."""
    per = (block_bytes - BLOCK_OVERHEAD) // (width + ENTRY_OVERHEAD)
    rank = F.row_number().over(Window.partitionBy(by).orderBy("key"))
    return entries.withColumn("block", F.floor((rank - 1) / F.lit(per)).cast("long"))


def zone_map(entries: DataFrame, *by: str) -> DataFrame:
    """First and last key, entries and bytes of each group."""
    return entries.groupBy(*by).agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n_entries"),
        F.sum(entry_bytes(F.col("key"), F.col("value"))).cast("long").alias("n_bytes"),
    )


def memtable_size(writes: DataFrame, by: str) -> DataFrame:
    """Distinct keys, tombstones included."""
    return writes.groupBy(by).agg(F.countDistinct("key").alias("n_keys"))


def split_files(df: DataFrame, n_bytes: int, target: int) -> DataFrame:
    """Rows range-partitioned into files of about ``target`` bytes, each sorted by key."""
    return df.repartitionByRange(max(1, -(-n_bytes // target)), "key").sortWithinPartitions("key")
