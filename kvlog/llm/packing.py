"""Operator 9: best-fit packing of token sequences by hierarchical residual packing.

Each partition encodes its documents and best-fits its pieces, longest first. Nearly full bins are
done. Underfull bins go up a tree as single items: at each level the bins of FAN_IN neighbours meet in
one task, are best-fitted again, and what is full enough for the level is done. From the fourth level
on only bins at most half full go up, of which a best fit leaves one at most in each task, so the root
gets a bounded number whatever the corpus.

Edge cases: a null or empty text is the single end token. Repeated rows are packed once each. A null
key is carried along. A long text is cut into pieces of the capacity, its first piece being the rest.
A special token that a text holds is that token, as the tokenizer file has it. An empty table gives an
empty result. Columns other than key and text, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec, sliced, texts_of
from .common import materialise, table

CAPACITY, END, FAN_IN = 1024, 2, 8
#: Pieces that a partition packs at once; its memory stays bounded however large it is.
AT_ONCE = 200_000
#: A bin below this share of the capacity goes up from each level.
SHARES = (15 / 16, 7 / 8, 3 / 4, 1 / 2)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, in the order given, and the fill of each bin. Bins are kept by
    their free room, and the bits of a number tell which rooms there are."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, offsets, fills = 0, [], [], []
    for length in lengths:
        above = rooms >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, k = capacity, len(fills)
            fills.append(0)
        bins.append(k)
        offsets.append(fills[k])
        fills[k] += length
        left = room - length
        if left:
            by_room[left].append(k)
            rooms |= 1 << left
    return bins, offsets, fills


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)]


def _local(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, base, made = codec(path), TaskContext.get().partitionId() << 33, 0
        rows: list[list] = [[] for _ in range(5)]
        kind = None

        def flush() -> pa.RecordBatch:
            nonlocal made
            keys, piece, start, length, crc = rows
            order = np.argsort(-np.array(length, np.int64), kind="stable")
            bins, offsets, fills = best_fit(np.array(length, np.int64)[order].tolist(), capacity)
            own, at = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            own[order], at[order] = bins, offsets
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, kind), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(own + (base + made)), pa.array(at), pa.array(np.array(fills, np.int64)[own])],
                ["key", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"],
            )
            made += len(fills)
            for x in rows:
                x.clear()
            return out

        for batch in sliced(batches):
            kind = batch.column(0).type
            ids, starts = coder.encode(texts_of(batch.column(1)))
            last = np.array([end], np.uint32)
            for key, a, b in zip(batch.column(0).to_pylist(), starts.tolist(), starts[1:].tolist(), strict=False):
                own = np.concatenate([ids[a:b], last]).astype("<u4", copy=False)
                raw = own.tobytes()
                for i, (start, length) in enumerate(cut(len(own), capacity)):
                    for x, v in zip(rows, (key, i, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])), strict=True):
                        x.append(v)
            if len(rows[0]) >= AT_ONCE:
                yield flush()
        if rows[0]:
            yield flush()

    return run


def _merge(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        ids, fills = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in (0, 1))
        order = np.lexsort((ids, -fills))
        ids, fills = ids[order], fills[order]
        bins, offsets, totals = best_fit(fills.tolist(), capacity)
        bins = np.array(bins)
        parents = ids[np.unique(bins, return_index=True)[1]]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(parents[bins]), pa.array(np.array(offsets, np.int64)), pa.array(np.array(totals, np.int64)[bins])], ["bin", "parent", "shift", "fill"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of every piece of every text."""
    kind = docs.schema[key].dataType.simpleString()
    local = materialise(docs.select(key, text).mapInArrow(_local(path, capacity, end), f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, fill bigint"), "pieces")
    tasks = (local.agg(F.max(F.shiftright("bin", 33))).first()[0] or 0) + 1
    limit = capacity * SHARES[0]
    # The piece at offset 0 stands for its bin; no piece is empty.
    items, above, level = local.filter((F.col("offset") == 0) & (F.col("fill") < limit)).select("bin", "fill"), None, 0
    while tasks > 1:
        level += 1
        tasks = -(-tasks // FAN_IN)
        limit = capacity * SHARES[min(level, len(SHARES) - 1)]
        grouped = items.repartition(tasks, F.shiftright("bin", 33 + 3 * level))
        moved = materialise(grouped.select("bin", "fill").mapInArrow(_merge(capacity), "bin bigint, parent bigint, shift bigint, fill bigint"), f"level{level}")
        items = moved.filter((F.col("bin") == F.col("parent")) & (F.col("fill") < limit)).select("bin", "fill")
        up = moved.select(F.col("bin").alias("from"), F.col("parent").alias("to"), F.col("shift").alias("by"))
        if above is None:
            above = up.toDF("bin", "parent", "shift")
        else:
            above = above.join(up, F.col("parent") == F.col("from"), "left").select("bin", F.coalesce("to", "parent").alias("parent"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"))
    names = [F.col("key").alias(key), "piece", "start", "length", "ids_crc32"]
    if above is None:
        return local.select(*names, F.col("bin").alias("sequence_id"), "offset")
    done = local.filter(F.col("fill") >= capacity * SHARES[0]).select(*names, F.col("bin").alias("sequence_id"), "offset")
    rest = local.filter(F.col("fill") < capacity * SHARES[0]).join(above, "bin").select(*names, F.col("parent").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return done.unionAll(rest)


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op9_best_fit": op9_best_fit}
ORACLES: dict[str, str] = {}
