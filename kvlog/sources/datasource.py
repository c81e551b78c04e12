"""spark.read.format("kvlog"): a store's log with runs pruned by the manifest, in Spark's Python data source API."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


class RunPartition(InputPartition):
    """A run's file, and the bounds of the keys that are wanted."""

    def __init__(self, path: str, lower: bytes | None, upper: bytes | None):
        super().__init__(path)
        self.path, self.lower, self.upper = path, lower, upper


class KvLogReader(DataSourceReader):
    """Takes key bounds for pruning; Spark filters the rows."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.lower: bytes | None = None
        self.upper: bytes | None = None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if hasattr(f, "value") and f.attribute == ("key",):
                value = bytes(f.value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.lower = value if self.lower is None else max(self.lower, value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.upper = value if self.upper is None else min(self.upper, value)
            yield f

    def partitions(self) -> list[RunPartition]:
        live: dict[int, dict] = {}
        folder = os.path.join(self.root, "_log")
        for name in sorted(x for x in os.listdir(folder) if x[0] not in "._"):
            with open(os.path.join(folder, name), encoding="utf-8") as lines:
                commit = json.load(lines)
            for run_id in commit["remove"]:
                live.pop(run_id, None)
            live.update({r["run_id"]: r for r in commit["add"]})
        kept = [r for r in live.values() if (self.lower is None or bytes.fromhex(r["max_key"]) >= self.lower) and (self.upper is None or bytes.fromhex(r["min_key"]) <= self.upper)]
        return [RunPartition(os.path.join(self.root, "runs", r["path"]), self.lower, self.upper) for r in kept]

    def read(self, partition: RunPartition) -> Iterator[pa.RecordBatch]:
        columns, wanted = ["key", "value", "is_deleted", "seq"], pc.scalar(True)
        # Row groups beyond the bounds are left by their statistics.
        if partition.lower is not None:
            wanted = wanted & (pc.field("key") >= pa.scalar(partition.lower, pa.binary()))
        if partition.upper is not None:
            wanted = wanted & (pc.field("key") <= pa.scalar(partition.upper, pa.binary()))
        yield from ds.dataset(partition.path, format="parquet").to_batches(columns=columns, filter=wanted)


class KvLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvlog"

    def schema(self) -> str:
        return "key binary, value binary, is_deleted boolean, seq bigint"

    def reader(self, schema) -> KvLogReader:
        return KvLogReader(self.options)


def register(spark: SparkSession) -> None:
    """For stores in a folder that all workers mount."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KvLogSource)
