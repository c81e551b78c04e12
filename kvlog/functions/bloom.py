"""Bloom filters over MurmurHash3 (32 bits), one seed a hash."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bits_per_key(fpr: float) -> int:
    return math.ceil(-math.log(fpr) / math.log(2) ** 2)


def n_hashes(bpk: int) -> int:
    return math.ceil(bpk * math.log(2))


def n_bits(n_keys: int, bpk: int) -> int:
    """In whole bytes."""
    return -(-n_keys * bpk // 8) * 8


def murmur3(key: bytes, seed: int) -> int:
    """MurmurHash3_x86_32, a public-domain function."""
    mask, h = 0xFFFFFFFF, seed

    def scrambled(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    whole = len(key) // 4 * 4
    for word in np.frombuffer(key[:whole], "<u4").tolist():
        h ^= scrambled(word)
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if len(key) > whole:
        h ^= scrambled(int.from_bytes(key[whole:], "little"))
    h ^= len(key)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def murmur3_many(keys: list[bytes], hashes: int) -> np.ndarray:
    """MurmurHash3 of every key (rows) under seeds from 0 (columns), all keys of a length at once."""

    def scrambled(k: np.ndarray) -> np.ndarray:
        k = k * 0xCC9E2D51
        return (k << 15 | k >> 17) * 0x1B873593

    out = np.empty((len(keys), hashes), np.uint32)
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    order = np.argsort(sizes, kind="stable")
    lengths, starts = np.unique(sizes[order], return_index=True)
    for size, own in zip(lengths.tolist(), np.split(order, starts[1:]), strict=False):
        padded = -(-size // 4) * 4
        words = np.frombuffer(b"".join(keys[i].ljust(padded, b"\0") for i in own), "<u4").reshape(len(own), padded // 4)
        h = np.tile(np.arange(hashes, dtype=np.uint32), (len(own), 1))
        for j in range(size // 4):
            h ^= scrambled(words[:, j])[:, None]
            h = (h << 13 | h >> 19) * 5 + 0xE6546B64
        if size % 4:
            h ^= scrambled(words[:, -1])[:, None]
        h ^= np.uint32(size)
        h = (h ^ h >> 16) * 0x85EBCA6B
        h = (h ^ h >> 13) * 0xC2B2AE35
        out[own] = h ^ h >> 16
    return out


class Bloom:
    def __init__(self, bits: bytearray, hashes: int):
        self.bits, self.hashes = bits, hashes

    @classmethod
    def of(cls, keys, bpk: int) -> Bloom:
        made = cls(bytearray(n_bits(len(keys), bpk) // 8), n_hashes(bpk))
        for key in keys:
            for at in made.positions(key):
                made.bits[at >> 3] |= 1 << (at & 7)
        return made

    def positions(self, key: bytes) -> list[int]:
        return [murmur3(key, i) % (8 * len(self.bits)) for i in range(self.hashes)] if self.bits else []

    def may_contain(self, key: bytes) -> bool:
        return bool(self.bits) and all(self.bits[at >> 3] >> (at & 7) & 1 for at in self.positions(key))

    def encode(self) -> bytes:
        return bytes(self.bits) + bytes([self.hashes])

    @classmethod
    def decode(cls, data: bytes) -> Bloom:
        return cls(bytearray(data[:-1]), data[-1])


def plausible(m: Column, n_set: Column, fpr: float) -> Column:
    """Whether ``n_set`` of a filter's ``m`` bits is near the number that its keys set by chance: within a tenth of
    the bits, or in small filters, which chance moves further, within 2 * sqrt(m), over seven deviations at 0.01."""
    bpk = bits_per_key(fpr)
    n_keys = F.floor(m / bpk)  # as rounding adds fewer bits than a key has, if that is 8 or more
    expected = m * (1 - F.pow(1 - 1 / m, n_keys * n_hashes(bpk)))
    return F.abs(n_set - expected) <= F.greatest(m * 0.1, 2 * F.sqrt(m))


def _counts(keys: DataFrame, by: str, fpr: float, key: str) -> DataFrame:
    """(by, m): each run's filter size in bits."""
    return keys.groupBy(by).agg((F.ceil(F.countDistinct(key) * bits_per_key(fpr) / 8) * 8).cast("long").alias("m"))


def _runs(df: DataFrame, *order: str) -> DataFrame:
    """Whole groups (all of ``order`` but its last), each in one partition and in order. They are dealt by a hash:
    Spark leaves out a deal by the group itself where a join has dealt by it, and AQE may then undo the join's."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, F.xxhash64(*order[:-1])).sortWithinPartitions(*order)


def build(keys: DataFrame, by: str, fpr: float, key: str = "key") -> DataFrame:
    """(by, m, bits): each run's filter as bytes. A run's keys are read as a stream beside its bits."""
    hashes, kind = n_hashes(bits_per_key(fpr)), keys.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bits, made = None, None, []
        for batch in batches:
            groups, m = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            found = murmur3_many(batch.column(1).to_pylist(), hashes).astype(np.int64) % m[:, None]
            cuts = [i for i in range(len(groups)) if i == 0 or groups[i] != groups[i - 1]] + [len(groups)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if bits is None or groups[a] != own:
                    if bits is not None:
                        made.append((own, len(bits), bits))
                    own, bits = groups[a], np.zeros(int(m[a]), np.uint8)
                bits[found[a:b].ravel()] = 1
            while made:
                yield row(batch.column(0).type, *made.pop(0))
        if bits is not None:
            yield row(batch.column(0).type, own, len(bits), bits)

    def row(kind: pa.DataType, group, m: int, bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], kind), pa.array([m]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["own", "m", "bits"])

    sized = keys.select(by, F.col(key).cast("binary").alias("k")).join(_counts(keys, by, fpr, key), by)
    return _runs(sized.select(by, "k", "m"), by, "k").mapInArrow(run, f"own {kind}, m bigint, bits binary").withColumnRenamed("own", by)


def probe(keys: DataFrame, filters: DataFrame, by: str, fpr: float, key: str = "key", at_once: int = 100_000) -> DataFrame:
    """Rows (by, key) of ``keys``, each once, that the run's filter may hold. A filter leads the rows of its
    run, in parts of about ``at_once`` keys. Keys of a run without a filter do not pass."""
    hashes, kinds = n_hashes(bits_per_key(fpr)), [keys.schema[c].dataType.simpleString() for c in (by, key)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, own = None, None
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            leads = batch.column(2)
            cuts = [i for i in range(len(groups)) if i == 0 or groups[i] != groups[i - 1]] + [len(groups)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if groups[a] != own:
                    own, bits = groups[a], None
                if leads[a].is_valid:
                    bits, a = np.frombuffer(leads[a].as_py(), np.uint8), a + 1
                if bits is not None and len(bits) and a < b:
                    at = murmur3_many(batch.column(4).slice(a, b - a).to_pylist(), hashes).astype(np.int64) % (8 * len(bits))
                    kept[a:b] = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["own", "k"]).filter(pa.array(kept))

    asked = keys.select(F.col(by).alias("own"), F.col(key).alias("k")).filter("k IS NOT NULL").distinct()
    parts = asked.groupBy("own").agg(F.ceil(F.count("*") / at_once).cast("long").alias("parts"))
    rows = asked.join(parts, "own").select("own", F.pmod(F.xxhash64("k"), "parts").alias("part"), F.lit(None).cast("binary").alias("lead"), "k", F.col("k").cast("binary").alias("raw"))
    none = F.lit(None)
    leads = parts.join(filters.select(F.col(by).alias("own"), "bits"), "own")
    leads = leads.select("own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("bits").alias("lead"), none.cast(kinds[1]).alias("k"), none.cast("binary").alias("raw"))
    return _runs(leads.unionAll(rows), "own", "part", "raw").mapInArrow(run, f"own {kinds[0]}, k {kinds[1]}").toDF(by, key)
