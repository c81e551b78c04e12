"""A durable key-value store: memtables on the driver, Parquet runs, a manifest and a write-ahead log.

A run is a file with a range of keys. Reads prune runs by the manifest's key ranges, then resolve versions
by the relational operators; of versions with one seq, which only a caller's own numbers can give, any."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LOG, MAX_LENGTH, StoreOptions, as_log, check_entry
from ..operators import policy, read
from ..operators.cache import LruCache
from ..operators.layout import split_files
from ..operators.resolve import compact, live, newest_per_key
from .files import Files
from .manifest import Manifest, Run
from .wal import Wal


class Memtable:
    """Newest entry of each key. Every write takes room, overwrites too."""

    def __init__(self, number: int):
        self.number, self.used, self.logged = number, 0, -1
        self.entries: dict[bytes, tuple[bytes, int]] = {}

    def put(self, key: bytes, value: bytes, seq: int) -> None:
        self.entries[key] = (value, seq)
        self.used += len(key) + len(value)


class KVStore:
    def __init__(self, spark: SparkSession, path: str, options: StoreOptions | None = None):
        self.spark, self.options = spark, options or StoreOptions()
        self.files = Files(spark, path)
        self.files.make("runs")
        self.manifest, self.wal = Manifest(self.files), Wal(self.files)
        self._open = True
        self.next_seq = 1 + max([0, *(r.max_seq for r in self.manifest.runs.values())])
        self.frozen: list[Memtable] = []
        self._numbers = 0
        self._cache = LruCache(self.options.cache_entries)
        for number, entries in self.wal.replay():
            table = Memtable(number)
            # What a run holds already was flushed before its log could be dropped.
            fresh = [e for e in entries if e[2] >= self.next_seq]
            for entry in fresh:
                table.put(*entry)
                table.logged = entry[2]
            self._numbers = max(self._numbers, number + 1)
            if fresh:
                self.frozen.insert(0, table)
            else:
                self.wal.drop(number)
        self.next_seq = max([self.next_seq, *(s + 1 for t in self.frozen for _, s in t.entries.values())])
        self.active = self._new_memtable()

    def __enter__(self) -> KVStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _new_memtable(self) -> Memtable:
        self._numbers += 1
        return Memtable(self._numbers - 1)

    # Writes

    def put(self, key: bytes, value: bytes) -> None:
        self.put_many([(key, value)])

    def put_many(self, entries: Iterable[tuple[bytes, bytes]]) -> None:
        """Writes in order. The log gets one file for all that go to one memtable."""
        if not self._open:
            raise ValueError("the store is closed")
        entries, held = list(entries), []
        for key, value in entries:
            check_entry(key, value)
            if len(key) + len(value) > self.options.memtable_bytes:
                raise ValueError("the entry is larger than a memtable")
        used = self.active.used
        for key, value in entries:
            if used + len(key) + len(value) > self.options.memtable_bytes:
                self._take(held)
                self.freeze()
                self._flush_due()
                held, used = [], 0
            held.append((key, value, self.next_seq))
            self.next_seq += 1
            used += len(key) + len(value)
        self._take(held)
        self._flush_due()

    def _take(self, entries: list[tuple[bytes, bytes, int]]) -> None:
        if self.options.enable_wal and entries:
            self.wal.append(self.active.number, entries)
            self.active.logged = entries[-1][2]
        for key, value, seq in entries:
            self.active.put(key, value, seq)
            self._cache.drop(key)

    def _flush_due(self) -> None:
        while self.frozen and len(self.frozen) >= self.options.memtable_limit - 1:
            self._flush_oldest()

    def sync(self) -> None:
        """What is in memory only goes to the log, so that it outlives a crash."""
        for table in self._buffers():
            fresh = sorted(((k, v, s) for k, (v, s) in table.entries.items() if s > table.logged), key=lambda e: e[2])
            if fresh:
                self.wal.append(table.number, fresh)
                table.logged = fresh[-1][2]

    def delete(self, key: bytes) -> None:
        self.put(key, b"")

    def put_df(self, df: DataFrame, key: str = "key", value: str = "value", seq: str = "seq", keep_seq: bool = False, batch: tuple[str, int] | None = None) -> None:
        """Bulk writes: runs of their own, of AQE's sizes. ``seq`` gives the order of the rows among themselves,
        all after what is there; with ``keep_seq`` it is their number in the store, so that a late row with a
        lower one loses. A null key or seq, or one too long, fails. ``batch`` is a stream's name and a
        number: a batch that was committed is left."""
        if batch is not None and self.manifest.batches.get(batch[0], -1) >= batch[1]:
            return
        self.flush()
        log = as_log(df, key, value, seq)
        if not keep_seq:
            least = log.agg(F.min("seq")).first()[0] or 0
            log = log.withColumn("seq", F.col("seq") - least + self.next_seq)
        bad = F.col("key").isNull() | F.col("seq").isNull() | (F.octet_length("key") > MAX_LENGTH) | (F.octet_length("value") > MAX_LENGTH)
        log = log.withColumn("key", F.when(bad, F.raise_error(F.lit(f"keys and seqs are not null, keys and values have at most {MAX_LENGTH} bytes"))).otherwise(F.col("key")))
        self._cache.clear()
        self._write_runs(newest_per_key(log).repartitionByRange("key").sortWithinPartitions("key"), 0, [], batch)
        self._maybe_compact()

    def delete_df(self, keys: DataFrame, key: str = "key") -> None:
        self.put_df(keys.select(F.col(key).alias("key"), F.lit(b"").alias("value"), F.lit(0).alias("seq")))

    # Reads

    def _buffers(self) -> list[Memtable]:
        return [self.active, *self.frozen]

    def _log(self, lower: bytes | None = None, upper: bytes | None = None, version: int | None = None, inclusive: bool = False) -> DataFrame:
        runs = list(self.manifest.runs.values()) if version is None else self.manifest.at(version)
        above = lambda r: upper is None or bytes.fromhex(r.min_key) < upper or (inclusive and bytes.fromhex(r.min_key) == upper)
        kept = [r for r in runs if above(r) and (lower is None or bytes.fromhex(r.max_key) >= lower)]
        paths = [self._file(r) for r in kept]
        out = self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)
        buffered = [(k, v, not v, s) for t in self._buffers() for k, (v, s) in t.entries.items()] if version is None else []
        return out.unionByName(self.spark.createDataFrame(buffered, LOG)) if buffered else out

    def pruned_runs(self, lower: bytes | None, upper: bytes | None) -> int:
        """How many runs a read of [lower, upper) skips."""
        return sum(1 for r in self.manifest.runs.values() if (upper is not None and bytes.fromhex(r.min_key) >= upper) or (lower is not None and bytes.fromhex(r.max_key) < lower))

    def get(self, key: bytes) -> bytes | None:
        for table in self._buffers():
            if key in table.entries:
                return table.entries[key][0] or None
        if key not in self._cache:
            rows = read.get(self._log(key, key, inclusive=True), key).select("value").collect()
            self._cache.put(key, bytes(rows[0][0]) if rows else b"")
        return self._cache.get(key) or None

    def seek(self, key: bytes) -> tuple[bytes, bytes] | None:
        """The first live entry at or after a key. The range that is read grows from the next run's end."""
        ends = sorted({bytes.fromhex(r.max_key) for r in self.manifest.runs.values()} | {k for t in self._buffers() for k in t.entries})
        ends = [e + b"\0" for e in ends if e >= key]
        at = 1
        while ends:
            rows = self.scan(key, ends[min(at, len(ends)) - 1]).limit(1).collect()
            if rows:
                return bytes(rows[0]["key"]), bytes(rows[0]["value"])
            if at >= len(ends):
                break
            key, at = ends[at - 1], 2 * at + 1
        return None

    def prefix_scan(self, prefix: bytes) -> DataFrame:
        return self.scan(prefix, read.successor(prefix))

    def multi_get(self, probes: DataFrame, key: str = "key") -> DataFrame:
        return read.multi_get(self._log(), probes, key)

    def scan(self, lower: bytes | None = None, upper: bytes | None = None, reverse: bool = False) -> DataFrame:
        return read.scan(self._log(lower, upper), lower, upper, reverse).select("key", "value")

    def cursor(self, lower: bytes | None = None, upper: bytes | None = None, reverse: bool = False) -> read.Cursor:
        return read.Cursor(self.scan(lower, upper, reverse), reverse)

    def as_df(self, live_only: bool = True, version: int | None = None) -> DataFrame:
        log = self._log(version=version)
        return live(newest_per_key(log)) if live_only else log

    def stats(self) -> dict:
        return {
            "levels": [len(x) for x in self.manifest.levels()], "frozen": len(self.frozen), "memtable_keys": len(self.active.entries),
            "memtable_bytes": self.active.used, "version": self.manifest.version, "n_entries": sum(r.n_entries for r in self.manifest.runs.values()),
            "n_bytes": sum(r.n_bytes for r in self.manifest.runs.values()), "next_seq": self.next_seq,
        }

    @staticmethod
    def detect_leaks() -> bool:
        """Memory is managed here."""
        return False

    # Freeze, flush, compaction

    def freeze(self) -> None:
        self.frozen.insert(0, self.active)
        self.active = self._new_memtable()

    def _flush_oldest(self) -> None:
        table = self.frozen[-1]
        rows = [(k, v, not v, s) for k, (v, s) in sorted(table.entries.items())]
        if rows:
            self._write_runs(split_files(self.spark.createDataFrame(rows, LOG), 1, 1), 0, [])
        self.frozen.pop()
        self.wal.drop(table.number)
        self._maybe_compact()

    def flush(self) -> None:
        """All memtables to runs."""
        if self.active.entries:
            self.freeze()
        while self.frozen:
            self._flush_oldest()

    def _file(self, run: Run) -> str:
        return f"{self.files.root}/runs/{run.path}"

    def _write_runs(self, rows: DataFrame, level: int, remove: list[int], batch: tuple[str, int] | None = None) -> None:
        """Files first, then one commit; what a crash leaves in between is never read. ``rows`` are in ranges
        of keys and sorted; each partition is a file, and each file a run."""
        first = self.manifest.next_run
        # Files of runs left by a crash are not in the manifest and may be replaced.
        # Adaptive: a filter as large as its keys need, not the largest.
        folder, bloom = f"{first:012d}", "parquet.bloom.filter"
        options = {f"{bloom}.enabled#key": True, f"{bloom}.fpp#key": self.options.bloom_fpr, f"{bloom}.adaptive.enabled#key": True, "parquet.page.size": self.options.block_bytes}
        rows.write.mode("overwrite").options(**options).parquet(f"{self.files.root}/runs/{folder}")
        made = self.spark.read.schema(LOG).parquet(f"{self.files.root}/runs/{folder}")
        file = made.select("key", "seq", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"))
        files = file.groupBy("name", "size").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"), F.max("seq").alias("top")).orderBy("low").collect()
        add = [Run(first + i, level, bytes(r.low).hex(), bytes(r.high).hex(), r.n, r.size, r.top, f"{folder}/{r.name}") for i, r in enumerate(files)]
        self.next_seq = max([self.next_seq, *(r.max_seq + 1 for r in add)])
        if add or remove or batch:
            self.manifest.commit(add, remove, batch)

    def _levels(self) -> list[list[str | int]]:
        """Level 0 as its writes, which may overlap; the levels below as their runs, which don't."""
        levels = self.manifest.levels()
        return [list(dict.fromkeys(self.manifest.runs[i].path.split("/")[0] for i in levels[0])), *levels[1:]]

    def _maybe_compact(self) -> None:
        task = policy.pick(self._levels(), self.options)
        if task:
            levels = [*self.manifest.levels(), []]
            self._compact([*levels[task.upper], *levels[task.lower]], task.lower, task.bottom)

    def _compact(self, ids: list[int], level: int, bottom: bool) -> None:
        runs = [self.manifest.runs[i] for i in ids]
        inputs = self.spark.read.schema(LOG).parquet(*map(self._file, runs))
        self._write_runs(split_files(compact(inputs, bottom), sum(r.n_bytes for r in runs), self.options.run_bytes), level, ids)

    def compact(self) -> None:
        """All runs into the deepest level; tombstones go."""
        self.flush()
        levels = self.manifest.levels()
        ids = [i for level in levels for i in level]
        if ids:
            self._compact(ids, max(1, len(levels) - 1), True)

    def vacuum(self) -> None:
        """Delete files that no live run has; earlier versions can't be read any more."""
        kept = {r.path.split("/")[0] for r in self.manifest.runs.values()}
        for name in self.files.names("runs"):
            if name not in kept:
                self.files.delete(f"runs/{name}")

    def close(self) -> None:
        if self._open:
            self.flush()
            self._open = False
