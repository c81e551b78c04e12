"""Operator 7: shards of near equal bytes by Karmarkar-Karp differencing over indivisible groups.

Equal texts form a group that goes to one shard. A partition of groups is differenced to a partial
partition of ``shards`` sums: the two with the largest spread are combined again and again, oppositely
ordered. The partial partitions of all tasks (``shards`` numbers each) are combined in the same way on
the driver, which gives each task's subsets their shards. So every step is the same differencing, and
nothing but sums leaves a task.

Edge cases: a null text has size 16 and is in the group of the empty text. Repeated rows get slots of
their own. A null id takes part. If one group outweighs a shard's share, its shard is the largest; the
others share the rest evenly. Texts of any length count whole. An empty table gives an empty result.
Columns other than key and text, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, table, text_bytes

SHARDS, OVERHEAD = 40, 16
#: Groups that a task differences at once, which bounds its memory.
AT_ONCE = 20_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over n partial partitions (rows of m sums): the subset of the whole that each of
    a row's subsets goes to, and the whole's sums."""
    n, m = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    current = list(np.take_along_axis(sums, order, axis=1))
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(current)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heap[0]
        joined = current[i] + current[j][::-1]
        by = np.argsort(-joined, kind="stable")
        joined = joined[by]
        made.append((i, j, by.astype(np.int16)))
        current[i] = current[j] = None
        heapq.heapreplace(heap, (-int(joined[0] - joined[-1]), len(current)))
        current.append(joined)
    total = current[heap[0][1]]
    at = {heap[0][1]: np.arange(m, dtype=np.int16)}
    for k in range(len(made) - 1, -1, -1):
        i, j, by = made[k]
        label = np.empty(m, np.int16)
        label[by] = at.pop(n + k)
        at[i], at[j] = label, label[::-1]
    labels = np.empty((n, m), np.int16)
    for i in range(n):
        labels[i, order[i]] = at[i]
    return labels, total


def divide(sizes: np.ndarray, shards: int, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each item, and the shards' sums."""
    found, wholes = [], []
    for at in range(0, len(sizes), at_once):
        part = sizes[at : at + at_once]
        rows = np.zeros((len(part), shards), np.int64)
        rows[:, 0] = part
        labels, total = difference(rows)
        found.append(labels[:, 0])
        wholes.append(total)
    labels, total = difference(np.array(wholes))
    return np.concatenate([labels[k][x] for k, x in enumerate(found)]), total


def _task(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        groups = pa.Table.from_batches(got).sort_by([("size", "descending"), ("group", "ascending")])
        own, _ = divide(groups["size"].to_numpy(), shards)
        task = np.full(len(own), TaskContext.get().partitionId(), np.int32)
        out = pa.table([groups["group"], groups["size"], pa.array(task), pa.array(own.astype(np.int32))], ["group", "size", "task", "subset"])
        yield from out.to_batches(max_chunksize=10_000)

    return run


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard and slot of every row; groups of equal texts stay together."""
    spark, raw = docs.sparkSession, text_bytes(text)
    rows = docs.select(F.col(key).alias("key"), (F.length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("group"))
    rows = materialise(rows, "sizes")
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    parted = materialise(groups.repartition(partitions(spark), "group").mapInArrow(_task(shards), "group binary, size bigint, task int, subset int"), "parted")
    # Tasks times shards rows, whatever the input.
    sums = parted.groupBy("task", "subset").agg(F.sum("size").alias("size")).collect()
    tasks = sorted({r["task"] for r in sums})
    wholes = np.zeros((len(tasks), shards), np.int64)
    place = {t: i for i, t in enumerate(tasks)}
    for r in sums:
        wholes[place[r["task"]], r["subset"]] = r["size"]
    names = difference(wholes)[0] if tasks else np.zeros((0, shards), np.int16)
    pairs = [(t, k, int(names[i, k])) for i, t in enumerate(tasks) for k in range(shards)]
    named = spark.createDataFrame(pairs, "task int, subset int, shard int")
    homes = materialise(parted.join(F.broadcast(named), ["task", "subset"]).select("group", "shard"), "homes")
    placed = rows.join(homes, "group").select("key", "size", "text_crc32", "shard", F.pmod(F.xxhash64("key", "text_crc32"), F.lit(partitions(spark))).cast("int").alias("part"))
    placed = materialise(placed, "placed")
    # Slots without one task per shard: numbered in parts of a shard, which begin where the parts before end.
    counts = placed.groupBy("shard", "part").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("begin"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key"))
    out = placed.withColumn("at", number).join(F.broadcast(begins), ["shard", "part"])
    return out.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("begin") + F.col("at") - 1).cast("long").alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
