import random

import pytest
from pyspark.sql import functions as F

from kvlog.model import StoreOptions
from kvlog.sources import datasource
from kvlog.sources.store import KVStore
from kvlog.streaming.upsert import into_store, newest_stream

TINY = StoreOptions(memtable_bytes=16, memtable_limit=2, l0_trigger=3, size_ratio=2.0, max_levels=3)


def test_demo(spark, tmp_path):
    with KVStore(spark, str(tmp_path)) as db:
        for i, k in enumerate([b"apple", b"banana", b"cherry", b"date", b"elderberry"], 1):
            db.put(k, str(i).encode())
        assert db.get(b"apple") == b"1" and db.get(b"none") is None
        assert [k for k, _ in db.cursor(b"apple", b"elderberry")] == [b"apple", b"banana", b"cherry", b"date"]
        assert not db.detect_leaks()
    with pytest.raises(ValueError):
        db.put(b"a", b"b")


def test_against_a_dict(spark, tmp_path):
    rng, model, path = random.Random(3), {}, str(tmp_path)
    db = KVStore(spark, path, TINY)
    for step in range(30):
        key, value = f"k{rng.randrange(8)}".encode(), f"v{step}".encode()
        if rng.random() < 0.3:
            db.delete(key)
            model.pop(key, None)
        else:
            db.put(key, value)
            model[key] = value
        if step == 15:
            db.close()
            db = KVStore(spark, path, TINY)
    assert [(bytes(r.key), bytes(r.value)) for r in db.scan().collect()] == sorted(model.items())
    for k in [b"k0", b"k3", b"k7"]:
        assert db.get(k) == model.get(k)
    before = db.manifest.version
    db.compact()
    assert sum(db.stats()["levels"]) == 1 and db.as_df(live_only=False).filter("is_deleted").count() == 0
    assert {bytes(r.key): bytes(r.value) for r in db.as_df().collect()} == model
    assert db.as_df(live_only=False, version=before).count() > 0
    db.vacuum()
    assert {bytes(r.key): bytes(r.value) for r in db.as_df().collect()} == model


def test_wal_survives_a_crash(spark, tmp_path):
    options = StoreOptions(memtable_bytes=1000, enable_wal=True)
    db = KVStore(spark, str(tmp_path), options)
    for i in range(4):
        db.put(f"key{i}".encode(), b"\0\xff")
    db.delete(b"key1")
    again = KVStore(spark, str(tmp_path), options)  # without close
    assert again.get(b"key0") == b"\0\xff" and again.get(b"key1") is None
    again.put(b"key5", b"x")
    again.close()
    assert [bytes(r.key) for r in KVStore(spark, str(tmp_path), options).scan().collect()] == [b"key0", b"key2", b"key3", b"key5"]


def test_a_run_without_its_commit_is_not_read(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    db.put(b"a", b"1")
    db.flush()
    spark.createDataFrame([(b"z", b"9", False, 99)], "key binary, value binary, is_deleted boolean, seq bigint").write.parquet(f"{tmp_path}/runs/{7:012d}")
    assert [bytes(r.key) for r in KVStore(spark, str(tmp_path)).scan().collect()] == [b"a"]


def test_bulk_multi_get_and_data_source(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    rows = spark.range(100).select(F.format_string("%04d", F.col("id") % 40).alias("key"), F.col("id").cast("string").alias("value"), F.col("id").alias("seq"))
    db.put_df(rows)
    db.delete_df(spark.createDataFrame([(b"0003",)], "key binary"))
    found = db.multi_get(spark.createDataFrame([(b"0003",), (b"0004",), (b"9999",)], "key binary"))
    assert {bytes(r.key): r.value and bytes(r.value) for r in found.collect()} == {b"0003": None, b"0004": b"84", b"9999": None}
    assert db.pruned_runs(b"5000", None) == 2
    datasource.register(spark)
    source = spark.read.format("kvlog").option("path", str(tmp_path)).load()
    assert source.count() == 41
    assert source.filter(F.col("key") >= F.lit(b"0038")).count() == 2
    with pytest.raises(ValueError):
        KVStore(spark, str(tmp_path / "x"), TINY).put(b"k" * 20, b"")


def test_bulk_writes_by_seq(spark, tmp_path):
    db = KVStore(spark, str(tmp_path))
    db.put(b"a", b"old")
    put = lambda rows, **given: db.put_df(spark.createDataFrame(rows, "key string, value string, seq bigint"), **given)
    put([("a", "new", -5), ("a", "newest", -4)])
    assert db.get(b"a") == b"newest"  # whatever the numbers, after what was there
    top = db.next_seq
    put([("k", "seven", top + 7)], keep_seq=True, batch=("s", 0))
    put([("k", "two", top + 2)], keep_seq=True, batch=("s", 1))
    assert db.get(b"k") == b"seven"
    db.put(b"k", b"put")
    put([("k", "seven", top + 700)], keep_seq=True, batch=("s", 1))  # comes again
    assert db.get(b"k") == b"put" and KVStore(spark, str(tmp_path)).manifest.batches == {"s": 1}
    for bad in ((None, "v", 1), ("k", "v", None), ("k" * 70_000, "v", 1)):
        with pytest.raises(Exception, match="not null"):
            put([bad])
    assert db.get(b"k") == b"put"


def test_late_batches_of_a_stream_lose(spark, tmp_path):
    schema, source = "key string, value string, seq bigint", str(tmp_path / "in")
    db = KVStore(spark, str(tmp_path / "db"))
    for rows in ([("k", "seven", 7)], [("k", "two", 2), ("b", "1", 3)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        into_store(stream, db, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert db.get(b"k") == b"seven" and db.get(b"b") == b"1"
    assert list(db.manifest.batches.values()) == [1]


def test_levels_hold_files(spark, tmp_path):
    """Compaction makes a run of each file, so that levels have sizes and reads skip files."""
    options = StoreOptions(l0_trigger=2, run_bytes=4000, size_ratio=2.0, max_levels=3)
    db = KVStore(spark, str(tmp_path), options)
    for part in range(2):
        db.put_df(spark.range(2000).select(F.format_string("%06d", F.col("id") * 2 + part).alias("key"), F.lit("v").alias("value"), F.col("id").alias("seq")))
    levels = db.stats()["levels"]
    assert levels[0] == 0 and levels[1] > 3
    runs = sorted(db.manifest.runs.values(), key=lambda r: r.min_key)
    assert all(a.max_key < b.min_key for a, b in zip(runs, runs[1:], strict=False))
    assert db.pruned_runs(b"000000", b"000010") >= len(runs) - 2
    assert db.as_df().count() == 4000 and db.get(b"000007") == b"v"
    datasource.register(spark)
    assert spark.read.format("kvlog").option("path", str(tmp_path)).load().filter(F.col("key") < F.lit(b"000010")).count() == 10


def test_group_commit_and_sync(spark, tmp_path):
    options = StoreOptions(memtable_bytes=60, memtable_limit=9, enable_wal=True)
    db = KVStore(spark, str(tmp_path / "wal"), options)
    db.put_many([(f"key{i}".encode(), b"v" * 10) for i in range(10)])
    assert len(db.frozen) == 2 and len(db.files.names("wal")) == 3
    assert sum(len(db.files.names(f"wal/{x}")) for x in db.files.names("wal")) == 3  # a file for each memtable
    assert KVStore(spark, str(tmp_path / "wal"), options).get(b"key9") == b"v" * 10
    with pytest.raises(ValueError):
        db.put_many([(b"a", b"1"), (b"k" * 70, b"")])
    assert db.get(b"a") is None
    plain = KVStore(spark, str(tmp_path / "plain"))
    plain.put(b"a", b"1")
    plain.sync()
    plain.put(b"a", b"2")
    plain.put(b"b", b"3")
    again = KVStore(spark, str(tmp_path / "plain"))  # without close
    assert again.get(b"a") == b"1" and again.get(b"b") is None
    plain.sync()
    assert KVStore(spark, str(tmp_path / "plain")).get(b"a") == b"2"


def test_recovery_counts_runs(spark, tmp_path):
    options = StoreOptions(memtable_bytes=8, memtable_limit=4)
    with KVStore(spark, str(tmp_path), options) as db:
        for i in range(5):
            db.put(f"key{i}".encode(), f"val{i}".encode())
    again = KVStore(spark, str(tmp_path), options)
    assert again.stats()["levels"] == [5]
    again.put(b"key6", b"val6")
    assert [again.get(f"key{i}".encode()) for i in range(7)] == [b"val0", b"val1", b"val2", b"val3", b"val4", None, b"val6"]


def test_seek_prefix_and_cached_reads(spark, tmp_path, monkeypatch):
    db = KVStore(spark, str(tmp_path))
    for k in (b"a1", b"a2", b"b1", b"c1"):
        db.put(k, k)
        db.flush()
    db.delete(b"b1")
    assert db.seek(b"a2") == (b"a2", b"a2") and db.seek(b"a3") == (b"c1", b"c1") and db.seek(b"d") is None
    assert [bytes(r.key) for r in db.prefix_scan(b"a").collect()] == [b"a1", b"a2"]
    assert db.get(b"a1") == b"a1" and db.get(b"zz") is None
    monkeypatch.setattr(db, "_log", None)  # no read from here on
    assert db.get(b"a1") == b"a1" and db.get(b"zz") is None and db.get(b"b1") is None
    monkeypatch.undo()
    db.put(b"a1", b"new")
    db.flush()
    assert db.get(b"a1") == b"new"


def test_streams(spark, tmp_path):
    schema = "key string, value string, seq bigint"
    spark.createDataFrame([("a", "1", 5), ("a", "0", 2), ("b", "2", 6)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    db = KVStore(spark, str(tmp_path / "db"))
    into_store(stream, db, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert db.get(b"a") == b"1" and db.get(b"b") == b"2"
    newest_stream(stream).writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r.key: r.value for r in spark.table("newest").collect()} == {"a": "1", "b": "2"}
