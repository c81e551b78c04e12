import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kvlog.model import LOG, StoreOptions
from kvlog.operators import cache, layout, policy, prune, ranges, read, resolve


def log(spark, rows):
    return spark.createDataFrame([(k.encode(), v.encode(), not v, s) for k, v, s in rows], LOG)


def shown(df):
    return [(bytes(r["key"]).decode(), bytes(r["value"]).decode()) for r in df.collect()]


def test_kway_merge_keeps_tombstones_and_prefers_the_newest(spark):
    runs = [log(spark, [("b", "", 9), ("c", "4", 8), ("d", "5", 7)]), log(spark, [("a", "1", 6), ("b", "2", 5), ("c", "3", 4)]), log(spark, [("e", "4", 3)])]
    assert shown(resolve.kway_merge(runs).orderBy("key")) == [("a", "1"), ("b", ""), ("c", "4"), ("d", "5"), ("e", "4")]
    assert shown(resolve.two_way_merge(runs[0], runs[1]).orderBy("key")) == [("a", "1"), ("b", ""), ("c", "4"), ("d", "5")]
    assert shown(resolve.concat_runs(runs[1:]).orderBy("key"))[-1] == ("e", "4")


def test_reads(spark):
    rows = [("a", "1", 1), ("b", "2", 2), ("c", "3", 3), ("d", "4", 4), ("e", "5", 5), ("b", "", 6), ("d", "7", 7)]
    frame = log(spark, rows)
    assert shown(read.scan(frame, b"b", b"e")) == [("c", "3"), ("d", "7")]
    assert shown(read.scan(frame, b"a", b"e", reverse=True)) == [("d", "7"), ("c", "3"), ("a", "1")]
    assert shown(read.scan(frame, b"x", b"z")) == []
    assert shown(read.get(frame, b"b")) == [] and shown(read.get(frame, b"d")) == [("d", "7")]
    assert shown(read.seek(frame, b"b")) == [("c", "3")]
    assert resolve.shadowed(frame).count() == 2
    assert read.successor(b"a\xff\xff") == b"b" and read.successor(b"\xff") is None
    cursor = read.Cursor(read.scan(frame))
    assert list(cursor) == [(b"a", b"1"), (b"c", b"3"), (b"d", b"7"), (b"e", b"5")] and not cursor.is_valid()


def test_key_predicates_reach_the_scan_and_values_do_not(spark, tmp_path):
    log(spark, [("a", "1", 1), ("b", "", 2)]).write.parquet(str(tmp_path / "log"))
    plan = read.scan(spark.read.parquet(str(tmp_path / "log")), b"a", b"b")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "EqualTo(is_deleted" not in plan


def test_greedy():
    places = lambda sizes, *given: list(map(layout.greedy(*given), sizes))
    assert places([6, 6, 6], 12) == [0, 0, 1]
    # Blocks of 32 bytes hold two entries of 4 + 4 bytes.
    assert places([14] * 5, 32, 2) == [0, 0, 1, 1, 2]
    assert places([99, 1], 12) == [0, 1]


def test_folds_start_again_with_each_group(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.randrange(1, 9)) for g in (None, 1, 2, 3) for i in range(50)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = layout.greedy_layout(spark.createDataFrame(rows, "g int, i int, size int"), "g", "i", "size", 12).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in (None, 1, 2, 3):
        own = sorted((r.i, r["size"], r.container) for r in got if r.g == g)
        assert [c for *_, c in own] == list(map(layout.greedy(12), [s for _, s, _ in own]))


def test_find_block_against_brute_force(spark):
    rng = random.Random(1)
    keys = sorted(rng.sample(range(10_000), 400))
    zones = [(f"{k:05d}", i) for i, k in enumerate(keys)]
    probes = [(f"{rng.randrange(10_200):05d}",) for _ in range(500)]
    got = prune.find_block(spark.createDataFrame(probes, "key string"), spark.createDataFrame(zones, "last_key string, block bigint"))
    lasts = [z[0] for z in zones]
    assert sorted((r.key, r.block if r.block is not None else -1) for r in got.collect()) == sorted((p[0], -1 if (f := prune.find_run(lasts, p[0])) is None else f) for p in probes)


@pytest.fixture
def small_parts(spark):
    """Exchanges that AQE coalesces each in its own way."""
    kept = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_find_block_loses_no_probe(spark, small_parts):
    """A million probes, a hot one and some without a key among them."""
    key = lambda c: F.format_string("%09d", c)
    probes = spark.range(1_000_000).select(F.when(F.col("id") % 10 == 0, key(F.lit(77))).when(F.col("id") % 1001 == 0, None).otherwise(key(F.col("id") * 7)).alias("key"), "id")
    zones = spark.range(1, 6001).select(key(F.col("id") * 1000).alias("last_key"), F.col("id").alias("block"))
    got = prune.find_block(probes, zones)
    number = F.col("key").cast("long")
    want = F.when(number <= 6_000_000, F.greatest(F.ceil(number / 1000), F.lit(1)))
    n, wrong = got.agg(F.count("*"), F.count(F.when(~F.col("block").eqNullSafe(want), 1))).first()
    assert (n, wrong) == (1_000_000, 0)


def test_ranks_over_all_ranges(spark, small_parts):
    rows = spark.range(200_000).select(F.format_string("%09d", F.col("id") * 7919 % 200_003).alias("key"))
    got = ranges.with_rank(rows, "key")
    n, kinds, low, high = got.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()
    assert (n, kinds, low, high) == (200_000, 200_000, 0, 199_999)
    assert got.join(rows.withColumn("below", F.row_number().over(Window.orderBy("key")) - 1), "key").filter("rank <> below").isEmpty()


def test_ranges_without_rows(spark):
    none = spark.createDataFrame([], "last_key string, block bigint")
    assert [r.block for r in prune.find_block(spark.createDataFrame([("a",), (None,)], "key string"), none).collect()] == [None, None]
    assert ranges.with_rank(none, "last_key").count() == 0


def test_cursor_steps_both_ways_and_seeks(spark):
    frame = log(spark, [("1", "value1", 1), ("3", "value3", 2), ("4", "value4", 3)])
    cursor = read.Cursor(read.scan(frame, b"1"))
    seen = [cursor.key()]
    for step in (cursor.next, cursor.next, cursor.prev, cursor.prev, cursor.next):
        step()
        seen.append(cursor.key())
    assert seen == [b"1", b"3", b"4", b"3", b"1", b"3"]
    cursor.next()
    cursor.next()
    assert not cursor.is_valid()
    cursor.prev()
    assert cursor.key() == b"4"
    cursor.seek(b"2")
    assert (cursor.key(), cursor.value()) == (b"3", b"value3")
    cursor.seek(b"5")
    assert not cursor.is_valid()
    back = read.Cursor(read.scan(frame, reverse=True), reverse=True)
    back.seek(b"3")
    assert back.key() == b"3"
    back.prev()
    assert back.key() == b"4"


def test_lru_hits_against_one_cache(spark):
    rng = random.Random(4)
    rows = [(i, i % 3, rng.randrange(30)) for i in range(600)]
    got = {r.access_id: r.hit for r in cache.lru_hits(spark.createDataFrame(rows, "access_id int, sst_id int, block_index int"), 10).collect()}
    held = [cache.LruCache(10) for _ in range(3)]
    for i, t, b in rows:
        assert got[i] == (held[t].get(b) is not None)
        held[t].put(b, True)


def test_policy():
    options = StoreOptions(l0_trigger=2, size_ratio=2.0, max_levels=3)
    assert policy.pick([[1, 2], [3]], options) == policy.Task(0, 1, (1, 2), (3,), True)
    assert policy.pick([[1], [], []], options) is None  # empty levels give no task
    assert policy.pick([[1], [2], [3], [4]], options).bottom is False
    task = policy.pick([[1, 2], [3], [4]], options)
    assert not task.bottom and policy.apply([[1, 2, 9], [3], [4]], task, [5]) == [[9], [5], [4]]


def test_lru():
    held = cache.LruCache(3)
    for k in (1, 2, 3):
        held.put(k, k)
    for k in (3, 1, 2):
        assert held.get(k) == k
    held.put(4, 4)
    assert held.get(3) is None and len(held) == 3


@pytest.mark.parametrize("bad", [{"memtable_limit": 1}, {"max_levels": 0}, {"bloom_fpr": 1.0}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        StoreOptions(**bad)
