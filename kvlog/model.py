"""The data model: a log of versioned entries, and the store's options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Length prefixes are 16 bits.
MAX_LENGTH = 65_535

LOG = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType(), False),
    T.StructField("is_deleted", T.BooleanType(), False),
    T.StructField("seq", T.LongType(), False),
])


@dataclass(frozen=True)
class StoreOptions:
    """What can be set before a store is opened. A block is a Parquet page; ``bloom_fpr`` is the rate of
    the runs' Bloom filters; ``cache_entries`` are kept of what single reads have found."""

    block_bytes: int = 4 << 20
    memtable_bytes: int = 128 << 20
    memtable_limit: int = 2
    size_ratio: float = 8.0
    l0_trigger: int = 8
    max_levels: int = 8
    enable_wal: bool = False
    bloom_fpr: float = 0.01
    run_bytes: int = 128 << 20
    cache_entries: int = 1024

    def __post_init__(self):
        if self.memtable_limit < 2:
            raise ValueError("at least one active and one frozen memtable are needed")
        if self.max_levels < 1 or self.l0_trigger < 1 or self.size_ratio <= 0 or not 0 < self.bloom_fpr < 1:
            raise ValueError("options out of range")


def tombstone(value: Column) -> Column:
    """An empty value is a deletion."""
    return F.octet_length(value) == 0


def as_log(df: DataFrame, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """Any frame as a log; a null value counts as empty."""
    v = F.coalesce(F.col(value).cast("binary"), F.lit(b""))
    return df.select(F.col(key).cast("binary").alias("key"), v.alias("value"), tombstone(v).alias("is_deleted"), F.col(seq).cast("long").alias("seq"))


def check_entry(key: bytes, value: bytes) -> None:
    if len(key) > MAX_LENGTH or len(value) > MAX_LENGTH:
        raise ValueError(f"keys and values have at most {MAX_LENGTH} bytes")
