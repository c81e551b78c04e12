"""Queries over the driver's tables, and the same in SQL.

The log of most of them is the events table: the key is the user, the value the event (empty, so a
deletion, for errors), seq the event's id, and every thousand events are a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bloom, codec
from ..model import StoreOptions, tombstone
from ..operators import cache, layout, policy, prune, ranges, read, resolve
from ..sources.manifest import live_runs

RUN = 1000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value, is_deleted, seq, run_id; keys and values as strings."""
    value = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.concat_ws("#", "event_type", F.col("event_id").cast("string")))
    log = _table(spark, sf_dir, "events").select(F.format_string("u%08d", "user_id").alias("key"), value.alias("value"), F.col("event_id").alias("seq"))
    return log.select("key", "value", tombstone(F.col("value")).alias("is_deleted"), "seq", F.floor(F.col("seq") / RUN).cast("long").alias("run_id"))


def orders_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select(F.format_string("%08d", "o_orderkey").alias("key"), F.format_string("%08d", "o_custkey").alias("value"))


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in files of 1000 keys, each packed into blocks of 4096 bytes (8 + 8 bytes an entry)."""
    entries = orders_entries(spark, sf_dir).withColumn("file", F.floor(F.col("key").cast("long") / RUN).cast("long"))
    return layout.zone_map(layout.fixed_blocks(entries, "file", 4096, 16), "file", "block")


def runs_of(log: DataFrame) -> DataFrame:
    return resolve.newest_per_key(log.withColumn("k", F.concat_ws("|", "key", F.col("run_id").cast("string"))), key="k").drop("k")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LOG_SQL = """WITH log AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key,
    CASE WHEN event_type = 'error' THEN '' ELSE event_type || '#' || event_id END AS value, event_id AS seq, event_id // 1000 AS run_id FROM events),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)
"""
ORDERS_SQL = """WITH e AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS key, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS value, o_orderkey // 1000 AS file FROM orders),
b AS (SELECT *, (row_number() OVER (PARTITION BY file ORDER BY key) - 1) // 186 AS block FROM e),
z AS (SELECT file, block, min(key) AS first_key, max(key) AS last_key, count(*) AS n_entries, CAST(sum(length(key) + length(value)) AS BIGINT) AS n_bytes FROM b GROUP BY 1, 2)
"""


def query(name: str, sql: str | None = None, head: str = LOG_SQL):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = head + sql
        return f

    return put


@query("snapshot", "SELECT key, value, seq FROM newest WHERE value <> ''")
def snapshot(spark, d):
    return resolve.live(resolve.newest_per_key(events_log(spark, d))).select("key", "value", "seq")


@query("snapshot_narrow", "SELECT key, value, seq FROM newest WHERE value <> ''")
def snapshot_narrow(spark, d):
    return resolve.live(resolve.newest_narrow(events_log(spark, d))).select("key", "value", "seq")


@query("tombstones", "SELECT key, seq FROM newest WHERE value = ''")
def tombstones(spark, d):
    return resolve.newest_per_key(events_log(spark, d)).filter("is_deleted").select("key", "seq")


@query("point_get", "SELECT key, value FROM newest WHERE key = 'u00000007' AND value <> ''")
def point_get(spark, d):
    return read.get(events_log(spark, d), "u00000007").select("key", "value")


@query("multi_get", "SELECT p.key, n.value FROM (SELECT 'u' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer) p LEFT JOIN (SELECT * FROM newest WHERE value <> '') n ON p.key = n.key")
def multi_get(spark, d):
    probes = _table(spark, d, "customer").select(F.format_string("u%08d", "c_custkey").alias("key"))
    return read.multi_get(events_log(spark, d), probes)


@query("range_scan", "SELECT key, value FROM newest WHERE key >= 'u00000020' AND key < 'u00000040' AND value <> ''")
def range_scan(spark, d):
    return read.scan(events_log(spark, d), "u00000020", "u00000040").select("key", "value")


@query("reverse_scan", "SELECT key, value FROM newest WHERE key >= 'u00000020' AND key < 'u00000040' AND value <> ''")
def reverse_scan(spark, d):
    return read.scan(events_log(spark, d), "u00000020", "u00000040", reverse=True).select("key", "value")


@query("keys_only_scan", "SELECT key FROM newest WHERE value <> ''")
def keys_only_scan(spark, d):
    return read.scan(events_log(spark, d)).select("key")


@query("prefix_scan", "SELECT key, value FROM newest WHERE key LIKE 'u0000001%' AND value <> ''")
def prefix_scan(spark, d):
    return read.scan(events_log(spark, d), "u0000001", "u0000002").select("key", "value")


@query("seek_ge", "SELECT key, value FROM newest WHERE key >= 'u00000033' AND value <> '' ORDER BY key LIMIT 1")
def seek_ge(spark, d):
    return read.seek(events_log(spark, d), "u00000033").select("key", "value")


@query("shadowed_versions", "SELECT key, count(*) AS n_shadowed FROM log ANTI JOIN newest USING (key, seq) GROUP BY key")
def shadowed_versions(spark, d):
    return resolve.shadowed(events_log(spark, d)).groupBy("key").agg(F.count("*").alias("n_shadowed"))


@query("two_way_merge_whole", """, h AS (SELECT *, row_number() OVER (PARTITION BY run_id > (SELECT max(run_id) // 2 FROM log), key ORDER BY seq DESC) AS r2, run_id > (SELECT max(run_id) // 2 FROM log) AS newer FROM log)
SELECT coalesce(a.key, b.key) AS key, coalesce(a.value, b.value) AS value FROM (SELECT * FROM h WHERE newer AND r2 = 1) a FULL JOIN (SELECT * FROM h WHERE NOT newer AND r2 = 1) b ON a.key = b.key""")
def two_way_merge_whole(spark, d):
    """The newer half of all runs with the older half, each resolved."""
    log = events_log(spark, d)
    log = log.crossJoin(F.broadcast(log.agg(F.floor(F.max("run_id") / 2).alias("half"))))  # one row
    newer, older = (resolve.newest_per_key(log.filter(side)).select("key", "value") for side in ("run_id > half", "run_id <= half"))
    return resolve.two_way_merge(newer, older)


@query("kway_merge", "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run_id DESC) AS r2 FROM run) WHERE r2 = 1")
def kway_merge(spark, d):
    """Four sources, a quarter of all runs each, the newest first."""
    runs = runs_of(events_log(spark, d))
    runs = runs.crossJoin(F.broadcast(runs.agg(F.max("run_id").alias("most"))))  # one row
    quarter = lambda k: runs.filter(F.floor(F.col("run_id") * 4 / (F.col("most") + 1)) == k)
    sources = [resolve.newest_per_key(quarter(k)).select("key", "value", "is_deleted", "seq") for k in (3, 2, 1, 0)]
    return resolve.kway_merge(sources).select("key", "value").orderBy("key")


@query("level_merge", """SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run_id % 4, run_id DESC) AS r2 FROM run) WHERE r2 = 1 AND value <> ''""")
def level_merge(spark, d):
    runs = runs_of(events_log(spark, d)).withColumn("level", F.col("run_id") % 4)
    return resolve.live(resolve.newest_per_key(runs, F.col("level").asc(), F.col("run_id").desc())).select("key", "value")


@query("concat_runs", "SELECT key, value FROM e ORDER BY key", ORDERS_SQL)
def concat_runs(spark, d):
    entries = orders_entries(spark, d)
    return resolve.concat_runs([entries.filter(F.col("key") < "00001000"), entries.filter(F.col("key") >= "00001000")]).orderBy("key")


@query("compact_keep", "SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run_id DESC) AS r2 FROM run) WHERE r2 = 1")
def compact_keep(spark, d):
    return resolve.compact(runs_of(events_log(spark, d)), False, F.col("run_id").desc()).select("key", "value", "seq")


@query("compact_drop", "SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run_id DESC) AS r2 FROM run) WHERE r2 = 1 AND value <> ''")
def compact_drop(spark, d):
    return resolve.compact(runs_of(events_log(spark, d)), True, F.col("run_id").desc()).select("key", "value", "seq")


@query("zone_map", "SELECT run_id, min(key) AS first_key, max(key) AS last_key, count(*) AS n_entries, CAST(sum(length(key) + length(value)) AS BIGINT) AS n_bytes FROM run GROUP BY run_id")
def zone_map(spark, d):
    return layout.zone_map(runs_of(events_log(spark, d)), "run_id")


@query("block_pack_fixed", "SELECT * FROM z", ORDERS_SQL)
def block_pack_fixed(spark, d):
    return order_blocks(spark, d)


@query("zone_prune", "SELECT file, block FROM z WHERE last_key >= '00001000' AND first_key < '00003000'", ORDERS_SQL)
def zone_prune(spark, d):
    return prune.overlapping(order_blocks(spark, d), "00001000", "00003000").select("file", "block")


@query("find_block", """SELECT p.key, coalesce(min(z.file * 1000000 + z.block), -1) AS block FROM (SELECT lpad(CAST(c_custkey * 13 AS VARCHAR), 8, '0') AS key FROM customer) p
LEFT JOIN z ON z.last_key >= p.key GROUP BY p.key""", ORDERS_SQL)
def find_block(spark, d):
    probes = _table(spark, d, "customer").select(F.format_string("%08d", F.col("c_custkey") * 13).alias("key"))
    zones = order_blocks(spark, d).withColumn("block", F.col("file") * 1_000_000 + F.col("block"))
    return prune.find_block(probes, zones).select("key", F.coalesce("block", F.lit(-1)).cast("long").alias("block"))


@query("split_by_size", "SELECT file, min(key) AS first_key, max(key) AS last_key, count(*) AS n FROM (SELECT key, (row_number() OVER (ORDER BY key) - 1) * 16 // 65536 AS file FROM e) GROUP BY file", ORDERS_SQL)
def split_by_size(spark, d):
    files = ranges.with_rank(orders_entries(spark, d), "key").withColumn("file", F.floor(F.col("rank") * 16 / 65536).cast("long"))
    return files.groupBy("file").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"))


@query("memtable_size", "SELECT run_id, count(DISTINCT key) AS n_keys FROM log GROUP BY run_id")
def memtable_size(spark, d):
    return layout.memtable_size(events_log(spark, d), "run_id")


@query("freeze_fold", """, s AS (SELECT run_id, seq, length(key) + length(value) AS size, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i FROM log),
f AS (SELECT run_id, i, seq, size AS used, 0 AS memtable_id FROM s WHERE i = 1 UNION ALL
      SELECT s.run_id, s.i, s.seq, CASE WHEN used + size > 128 THEN size ELSE used + size END, memtable_id + CASE WHEN used + size > 128 THEN 1 ELSE 0 END
      FROM fr JOIN s ON s.run_id = fr.run_id AND s.i = fr.i + 1)
SELECT seq, CAST(memtable_id AS BIGINT) AS memtable_id FROM f""")
def freeze_fold(spark, d):
    return layout.freeze_layout(events_log(spark, d).select("key", "value", "seq", "run_id"), "run_id", 128).select("seq", "memtable_id")


ORACLES["freeze_fold"] = ORACLES["freeze_fold"].replace("WITH log", "WITH RECURSIVE log", 1).replace("FROM fr JOIN s ON s.run_id = fr.run_id AND s.i = fr.i + 1", "FROM f JOIN s ON s.run_id = f.run_id AND s.i = f.i + 1")


@query("block_pack", """, s AS (SELECT run_id, key, value, length(key) + length(value) + 6 AS size, row_number() OVER (PARTITION BY run_id ORDER BY key) AS i FROM run),
f AS (SELECT run_id, i, key, value, 2 + size AS used, 0 AS block FROM s WHERE i = 1 UNION ALL
      SELECT s.run_id, s.i, s.key, s.value, CASE WHEN used + size > 256 THEN 2 + size ELSE used + size END, block + CASE WHEN used + size > 256 THEN 1 ELSE 0 END
      FROM f JOIN s ON s.run_id = f.run_id AND s.i = f.i + 1)
SELECT run_id, CAST(block AS BIGINT) AS block, min(key) AS first_key, max(key) AS last_key, count(*) AS n_entries, CAST(sum(length(key) + length(value)) AS BIGINT) AS n_bytes FROM f GROUP BY run_id, block""", LOG_SQL.replace("WITH log", "WITH RECURSIVE log", 1))
def block_pack(spark, d):
    runs = runs_of(events_log(spark, d)).select("key", "value", "run_id")
    return layout.zone_map(layout.block_layout(runs, "run_id", 256), "run_id", "block")


@query("lru_hits", """, t AS (SELECT event_id AS access_id, event_id % 4 AS sst_id, user_id AS block_index FROM events),
p AS (SELECT *, lag(access_id) OVER (PARTITION BY sst_id, block_index ORDER BY access_id) AS before FROM t),
c AS (SELECT p.access_id, count(DISTINCT q.block_index) AS between_ FROM p JOIN t q ON q.sst_id = p.sst_id AND q.access_id > p.before AND q.access_id < p.access_id GROUP BY p.access_id)
SELECT p.access_id, p.sst_id, p.block_index, p.before IS NOT NULL AND coalesce(c.between_, 0) < 64 AS hit FROM p LEFT JOIN c USING (access_id)""")
def lru_hits(spark, d):
    trace = _table(spark, d, "events").select(F.col("event_id").alias("access_id"), (F.col("event_id") % 4).alias("sst_id"), F.col("user_id").alias("block_index"))
    return cache.lru_hits(trace, 64)


def _hex16(c: str) -> str:
    return f"lpad(hex({c} % 256), 2, '0') || lpad(hex({c} // 256), 2, '0')"


@query("entry_encode", f"SELECT key, {_hex16('length(key)')} || hex(key) || {_hex16('length(value)')} || hex(value) AS entry FROM newest")
def entry_encode(spark, d):
    return resolve.newest_per_key(events_log(spark, d)).select("key", F.hex(codec.encode_entry(F.col("key"), F.col("value"))).alias("entry"))


@query("wal_replay_whole", "SELECT key, value, seq FROM newest")
def wal_replay_whole(spark, d):
    """No run is flushed, so the whole log is replayed."""
    return resolve.newest_per_key(events_log(spark, d)).select("key", "value", "seq")


@query("manifest_live", "SELECT user_id AS run_id, event_id AS version FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'signup'", "")
def manifest_live(spark, d):
    action = F.when(F.col("event_type") == "signup", "remove").otherwise("add")
    return live_runs(_table(spark, d, "events").select(F.col("event_id").alias("version"), action.alias("action"), F.col("user_id").alias("run_id")))


@query("space_amp", "SELECT CAST(sum(length(key) + length(value)) AS BIGINT) AS written, (SELECT CAST(sum(length(key) + length(value)) AS BIGINT) FROM newest WHERE value <> '') AS live FROM log")
def space_amp(spark, d):
    log = events_log(spark, d)
    size = lambda df, name: df.agg(F.sum(layout.entry_bytes(F.col("key"), F.col("value"))).cast("long").alias(name))
    return size(log, "written").crossJoin(size(resolve.live(resolve.newest_per_key(log)), "live"))  # one row each


@query("write_amp", """, r AS (SELECT run_id, sum(length(key) + length(value)) AS b FROM run GROUP BY run_id)
SELECT run_id, CAST(b AS BIGINT) AS written, CAST(sum(b) OVER (PARTITION BY run_id // 8 ORDER BY run_id) AS BIGINT) AS rewritten FROM r""")
def write_amp(spark, d):
    sizes = layout.zone_map(runs_of(events_log(spark, d)), "run_id").select("run_id", F.col("n_bytes").alias("written"))
    group = Window.partitionBy(F.floor(F.col("run_id") / 8)).orderBy("run_id")
    return sizes.withColumn("rewritten", F.sum("written").over(group))


@query("semi_probe", "SELECT key FROM (SELECT 'u' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer) SEMI JOIN run USING (key)")
def semi_probe(spark, d):
    probes = _table(spark, d, "customer").select(F.format_string("u%08d", "c_custkey").alias("key"))
    return probes.join(events_log(spark, d).select("key").distinct(), "key", "left_semi")


@query("compaction_pick", """, c AS (SELECT CAST(CASE WHEN run_id % 7 = 0 THEN 0 WHEN run_id % 7 < 3 THEN 1 ELSE 2 END AS INT) AS level, run_id FROM (SELECT DISTINCT run_id FROM log)),
n AS (SELECT level, count(*) AS runs FROM c GROUP BY level),
f AS (SELECT level, runs, CASE WHEN lead(level) OVER (ORDER BY level) = level + 1 THEN lead(runs) OVER (ORDER BY level) ELSE 0 END AS nx FROM n)
SELECT min(level) AS upper_level FROM f WHERE (level = 0 AND runs >= 8) OR (level > 0 AND level < 8 AND nx / runs < 8.0) HAVING min(level) IS NOT NULL""")
def compaction_pick(spark, d):
    level = F.when(F.col("run_id") % 7 == 0, 0).when(F.col("run_id") % 7 < 3, 1).otherwise(2).cast("int")
    runs = events_log(spark, d).select("run_id").distinct().select(level.alias("level"), "run_id")
    return policy.pick_query(runs, StoreOptions())


@query("bloom_params", "SELECT fpr, CAST(ceil(-ln(fpr) / (ln(2) * ln(2))) AS INT) AS bits_per_key, CAST(ceil(ceil(-ln(fpr) / (ln(2) * ln(2))) * ln(2)) AS INT) AS hashes FROM (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.01 AS DOUBLE)), (CAST(0.001 AS DOUBLE))) t(fpr)", "")
def bloom_params(spark, d):
    rows = [(p, bloom.bits_per_key(p), bloom.n_hashes(bloom.bits_per_key(p))) for p in (0.1, 0.01, 0.001)]
    return spark.createDataFrame(rows, "fpr double, bits_per_key int, hashes int")


@query("bloom_bits", "SELECT run_id, CAST(ceil(count(DISTINCT key) * 10 / 8) * 8 AS BIGINT) AS m, true AS plausible FROM log GROUP BY run_id")
def bloom_bits(spark, d):
    """Each run's filter size, and whether about as many of its bits are set as its keys set by chance (0.503 in large runs)."""
    keys = events_log(spark, d).select("run_id", "key").distinct()
    n_set = F.aggregate(F.sequence(F.lit(1), F.length("bits")), F.lit(0), lambda n, i: n + F.bit_count(F.conv(F.hex(F.substring("bits", i, F.lit(1))), 16, 10).cast("int")))
    return bloom.build(keys, "run_id", 0.01).select("run_id", "m", bloom.plausible(F.col("m"), n_set, 0.01).alias("plausible"))


@query("bloom_probe", """, n AS (SELECT max(run_id) + 1 AS runs FROM log),
a AS (SELECT c_custkey % runs AS run_id, 'u' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer, n),
m AS (SELECT a.run_id, a.key, r.key IS NOT NULL AS member FROM a LEFT JOIN (SELECT DISTINCT run_id, key FROM log) r ON r.run_id = a.run_id AND r.key = a.key)
SELECT run_id, count(*) AS n_asked, CAST(sum(CASE WHEN member THEN 1 ELSE 0 END) AS BIGINT) AS n_members, 0 AS n_missed, true AS few_false FROM m GROUP BY run_id""")
def bloom_probe(spark, d):
    """Each customer is asked for in one run. Every member passes its filter, and few others do."""
    held = events_log(spark, d).select("run_id", "key").distinct()
    runs = held.agg((F.max("run_id") + 1).alias("runs"))
    asked = _table(spark, d, "customer").crossJoin(F.broadcast(runs)).select((F.col("c_custkey") % F.col("runs")).alias("run_id"), F.format_string("u%08d", "c_custkey").alias("key"))  # one row
    passed = bloom.probe(asked, bloom.build(held, "run_id", 0.01), "run_id", 0.01).withColumn("passed", F.lit(True))
    rows = asked.join(held.withColumn("member", F.lit(True)), ["run_id", "key"], "left").join(passed, ["run_id", "key"], "left")
    count = lambda c: F.count(F.when(c, 1))
    member, got = F.col("member").isNotNull(), F.col("passed").isNotNull()
    return rows.groupBy("run_id").agg(
        F.count("*").alias("n_asked"), count(member).alias("n_members"), count(member & ~got).cast("int").alias("n_missed"),
        (count(~member & got) <= 3 + 0.03 * count(~member)).alias("few_false"),
    )


@query("block_crc", "SELECT run_id, key, seq % 5 <> 0 AS ok FROM run")
def block_crc(spark, d):
    """Entries with their checksums, of which every fifth is damaged afterwards."""
    runs = runs_of(events_log(spark, d)).withColumn("entry", codec.encode_entry(F.col("key"), F.col("value")))
    damaged = F.when(F.col("seq") % 5 == 0, F.concat("entry", F.lit(b"!"))).otherwise(F.col("entry"))
    return runs.select("run_id", "key", codec.checksum_ok(damaged, F.crc32("entry")).alias("ok"))
