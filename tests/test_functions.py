import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from kvlog.functions import bloom, codec
from kvlog.plans import catalogue


def test_block_layout_in_bytes():
    data = codec.encode_block([(b"key1", b"val1"), (b"k2", b"v2")])
    assert data == b"\x04\x00key1\x04\x00val1\x02\x00k2\x02\x00v2" + b"\x00\x00\x0c\x00\x02\x00"
    assert codec.decode_block(data) == [(b"key1", b"val1"), (b"k2", b"v2")]
    with pytest.raises(ValueError):
        codec.encode_block([])


def test_checksum():
    sealed = codec.seal_block(codec.encode_block([(b"a\0\xff", b"1")]))
    assert codec.open_block(sealed) == [(b"a\0\xff", b"1")]
    assert sealed[-4:] == zlib.crc32(sealed[:-4]).to_bytes(4, "little")
    with pytest.raises(ValueError):
        codec.open_block(b"\1" + sealed[1:])


def test_meta():
    zones = [(0, b"apple", b"banana"), (1234, b"carrot", b"date")]
    assert len(codec.encode_meta(zones)) == 41
    assert codec.decode_meta(codec.encode_meta(zones)) == zones


def test_murmur_vectors():
    assert bloom.murmur3(b"", 0) == 0
    assert bloom.murmur3(b"", 1) == 0x514E28B7
    assert bloom.murmur3(b"test", 0) == 0xBA6BD213
    assert bloom.murmur3(b"Hello, world!", 0) == 0xC0363E43


def test_bloom():
    assert (bloom.bits_per_key(0.01), bloom.n_hashes(10)) == (10, 7)
    keys = [b"apple", b"banana", b"carrot", b"durian"]
    made = bloom.Bloom.decode(bloom.Bloom.of(keys, 10).encode())
    assert all(map(made.may_contain, keys))
    assert not made.may_contain(b"guava") and not made.may_contain(b"orange")
    one = bloom.Bloom(bytearray([0b10110010]), 3)
    assert [i for i in range(8) if one.bits[0] >> i & 1] == [1, 4, 5, 7]


def test_murmur3_of_many_keys():
    keys = [bytes(range(i % 256)) * (i % 3) + b"\xff" * (i % 7) for i in range(300)]
    assert bloom.murmur3_many(keys, 7).tolist() == [[bloom.murmur3(k, i) for i in range(7)] for k in keys]
    assert bloom.murmur3_many([], 7).shape == (0, 7)


def test_bloom_frames_match_single_filters(spark):
    own = {run: [f"key{run}-{i}" for i in range(run * 40)] for run in (1, 2, 3)}
    keys = spark.createDataFrame([(r, k) for r, x in own.items() for k in x], "run_id int, key string")
    asked = [(r, f"key{q}-{i}") for r in own for q in own for i in range(200)]
    filters = bloom.build(keys, "run_id", 0.01)
    single = {r: bloom.Bloom.of([k.encode() for k in x], 10) for r, x in own.items()}
    assert {r.run_id: (r.m, bytes(r.bits)) for r in filters.collect()} == {r: (8 * len(b.bits), bytes(b.bits)) for r, b in single.items()}
    want = sorted((r, k) for r, k in asked if single[r].may_contain(k.encode()))
    assert sum(k in own[r] for r, k in want) == sum(map(len, own.values())) and len(want) < 300
    for at_once in (100_000, 50):  # a run's keys in parts
        got = bloom.probe(spark.createDataFrame([*asked, (9, "no filter"), (1, None)], "run_id int, key string"), filters, "run_id", 0.01, at_once=at_once)
        assert sorted(map(tuple, got.collect())) == want


@pytest.fixture
def late_broadcasts(spark):
    """As on large tables: joins of a small side turn into broadcasts while they run, and tasks aren't put together."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_bloom_probe_after_late_broadcasts(spark, late_broadcasts):
    keys = spark.range(0, 1200, 1, 8).selectExpr("id % 3 AS run_id", "concat('key', id) AS key")
    asked = spark.range(0, 2400, 1, 8).selectExpr("id % 3 AS run_id", "concat('key', id) AS key")
    single = {r: bloom.Bloom.of([f"key{i}".encode() for i in range(r, 1200, 3)], 10) for r in range(3)}
    got = bloom.probe(asked, bloom.build(keys, "run_id", 0.01), "run_id", 0.01)
    assert sorted(map(tuple, got.collect())) == sorted((i % 3, f"key{i}") for i in range(2400) if single[i % 3].may_contain(f"key{i}".encode()))


def test_bloom_build_after_late_broadcasts(spark, late_broadcasts):
    keys = spark.range(0, 1200, 1, 8).selectExpr("id % 3 AS run_id", "concat('key', id) AS key")
    single = {r: bloom.Bloom.of([f"key{i}".encode() for i in range(r, 1200, 3)], 10) for r in range(3)}
    got = bloom.build(keys, "run_id", 0.01).collect()
    assert sorted((r.run_id, r.m, bytes(r.bits)) for r in got) == [(r, 8 * len(b.bits), bytes(b.bits)) for r, b in single.items()]


def test_bloom_bits_of_larger_events_after_late_broadcasts(spark, late_broadcasts, tmp_path):
    """Sixteen runs with the SQL."""
    made = spark.range(0, 16_000, 1, 8).selectExpr("id AS event_id", "id * 7919 % 1500 AS user_id", "'click' AS event_type")
    made.write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalogue.bloom_bits(spark, str(tmp_path)).select("run_id", "m", "plausible").collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(catalogue.ORACLES["bloom_bits"]).fetchall())


def test_bloom_bits_of_small_runs(spark, tmp_path):
    """Runs of 1 to 40 keys, as at the end of a log whose length is no multiple of a run's, with the SQL."""
    made = spark.range(0, 400_000, 1, 8).filter("id % 1000 < 1 + id div 10000").selectExpr("id AS event_id", "id * 7919 % 1000003 AS user_id", "'click' AS event_type")
    made.write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalogue.bloom_bits(spark, str(tmp_path)).select("run_id", "m", "plausible").collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(catalogue.ORACLES["bloom_bits"]).fetchall())


def test_bloom_plausible_fill(spark):
    """What few keys set by chance, and filters of too few or too many keys."""
    known = [(16, 4, True), (16, 7, True), (64, 25, True), (64, 40, True), (10_000, 5034, True), (200, 30, False), (10_000, 2950, False), (10_000, 7500, False)]
    got = spark.createDataFrame(known, "m long, n_set int, want boolean").select("*", bloom.plausible(F.col("m"), F.col("n_set"), 0.01).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
