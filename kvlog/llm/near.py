"""Near-duplicate groups by Jaccard similarity of five-word shingles: operator 8's anchors, and what they can't reach.

A text's node is the hash of its set of shingles (lower case; a shorter text is one shingle), so equal
sets are one node. Candidates come from two sources: operator 8's anchors over SimHash fingerprints of
these shingles, and MinHash bands. Fingerprints alone don't do: texts at 0.8 differ in about ten of 64
bits, far beyond what anchors cover. Of 16 bands of 4 rows a pair at 0.8 shares one with a chance of
0.9998. Each candidate's similarity is estimated by 1024 one-bit MinHashes: those that are FAR apart are
left, those that are CLOSE are taken, each with an error below one in a million, and all between are
checked exactly on their whole texts.

Large groups don't give all pairs. Each node meets its band's least node first. Then, in bands that still
hold several groups, each node meets that of another group that differs least from it in its block of CELL
rows. At last, nodes of groups that are still apart meet, in cells of CELL by CELL rows; of these only
pairs that aren't FAR apart leave the join. The last two steps take time in the square of a band's rows,
and the last one gives as many pairs, only where many texts of a band are just below the similarity.

Edge cases: a null or empty text has the empty set, alike to itself alone. A null doc_id takes part and
gets the group's smallest id (null if there is none). Repeated rows are repeated. Texts of any length are
taken whole. An empty table gives an empty result. Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, text_bytes
from .components import components
from .simhash import near_links as anchor_links

SHINGLE, JACCARD = 5, 0.8
BANDS, ROWS, BITS = 16, 4, 1024
#: Of 1024 bits a pair at 0.8 differs in 102.4, deviation 9.6: these are 4.8 deviations off.
FAR, CLOSE = 148, 56
#: Rows of a band on each side of a cell, and texts that one task compares with one other.
CELL, AT_ONCE = 2000, 500
BITS_OF = [f"s{i}" for i in range(BITS // 64)]


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of Murmur3."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(42).integers(0, 1 << 32, (2, BITS), np.uint32)
    return made[0] | np.uint32(1), made[1]


def hashes(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of each word shingle, in order."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    k = min(shingle, len(own))
    total = np.full(len(own) - k + 1, k, np.uint64)
    for i in range(k):
        total = _mix(total ^ own[i : i + len(total)])
    return total


def shingles(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the word shingles."""
    return np.unique(hashes(data, shingle))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the bands and the one-bit MinHashes as 64-bit numbers."""
    a, b = _factors()
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BITS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), 64):
        np.minimum(least, (short[at : at + 64, None] * a + b).min(axis=0), out=least)
    values = _mix(least.astype(np.uint64) << np.uint64(10) | np.arange(BITS, dtype=np.uint64))
    rows, key = values[: BANDS * ROWS].reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key ^ rows[:, i])
    return key.view(np.int64), np.packbits((values >> np.uint64(63)).astype(np.uint8)).view(np.int64)


def simhash_of(found: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        total += np.unpackbits(found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(found)).tobytes(), "big", signed=True) if len(found) else 0


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, th (xxhash64 of the text), node, n (shingles), fp (SimHash), s0.. (one-bit MinHashes) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, fps, bits, bands = [], [], [], [], []
            for x in batch.column(2):
                every = hashes(x.as_py())
                found = np.unique(every)
                keys, marks = signature(found)
                node.append(xxhash.xxh64_intdigest(found.tobytes()))
                n.append(len(found))
                fps.append(simhash_of(every))
                bits.append(marks)
                bands.append(keys)
            columns = [np.array(node, np.uint64).view(np.int64), np.array(n, np.int64), np.array(fps, np.int64), *np.array(bits, np.int64).reshape(-1, len(BITS_OF)).T]
            flat = pa.array(np.array(bands, np.int64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(n) + 1, BANDS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns), lists], ["key", "th", "node", "n", "fp", *BITS_OF, "bands"])

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("key"), text_hash(text).alias("th"), text_bytes(text).alias("t"))
    return given.mapInArrow(run, f"key {kind}, th bigint, node bigint, n bigint, fp bigint, {', '.join(f'{m} bigint' for m in BITS_OF)}, bands array<bigint>")


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _differ(a: str, b: str) -> Column:
    return reduce(add, (F.bit_count(F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}"))) for m in BITS_OF))


def _plausible(a: str, b: str) -> Column:
    return (F.least(f"{a}.n", f"{b}.n") >= JACCARD * F.greatest(f"{a}.n", f"{b}.n")) & (_differ(a, b) <= FAR)


def _marks(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("node").alias(name), F.struct("n", *BITS_OF).alias(f"x{name}"))


def sifted(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, close) of the pairs (a, b) that aren't far apart."""
    both = pairs.join(_marks(nodes, "a").hint("merge"), "a").join(_marks(nodes, "b").hint("merge"), "b")
    return both.filter(_plausible("xa", "xb")).select("a", "b", (_differ("xa", "xb") <= CLOSE).alias("close"))


def checked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity. A node's text is read once, and each b is compared
    with its a, whose text leads a part of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            alike = []
            for b, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = shingles(x.as_py())
                if b is None:
                    own = found
                alike.append(b is not None and jaccard(own, found) >= JACCARD)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    used = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct().join(nodes.select("node", "th"), "node")
    # Copies meet before they are dealt out, so that a text goes over the network once a task.
    one = docs.select(text_hash(text).alias("th"), text_bytes(text).alias("t")).groupBy("th").agg(F.first("t").alias("t"))
    texts = materialise(one.join(used.hint("merge"), "th").select("node", "t"), "texts")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / AT_ONCE).cast("long").alias("parts"))
    each = pairs.join(parts.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    each = each.join(texts.withColumnRenamed("node", "b").hint("merge"), "b").select("a", "b", "t", "part")
    leads = parts.join(texts.withColumnRenamed("node", "a").hint("merge"), "a").select("a", F.lit(None).cast("long").alias("b"), "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dealt = leads.unionAll(each).repartition(partitions(docs.sparkSession), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.select("a", "b", "t").mapInArrow(run, "a bigint, b bigint")


def settled(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, name: str) -> DataFrame:
    """The links (a, b) among sifted pairs."""
    exact = materialise(checked(pairs.filter("NOT close").select("a", "b"), nodes, docs, text), name)
    return pairs.filter("close").select("a", "b").unionAll(exact)


def nearest(rows: DataFrame) -> DataFrame:
    """(a, b): each row's node and the node of another root that differs least from it, of the rows with its
    band and block, if they aren't far apart."""

    def pairs(band: np.ndarray, root: np.ndarray, node: np.ndarray, n: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        a, b = [node[:0]], [node[:0]]
        starts = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]).any(axis=1)]))
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(band)], strict=True):
            own = slice(low, high)
            for at in range(low, high, 256):
                part = slice(at, min(at + 256, high))
                differ = np.zeros((part.stop - at, high - low), np.int32)
                for w in range(bits.shape[1]):
                    differ += np.bitwise_count(bits[part, w, None] ^ bits[None, own, w])
                small, large = np.minimum(n[part, None], n[None, own]), np.maximum(n[part, None], n[None, own])
                differ[(root[part, None] == root[None, own]) | (small < JACCARD * large)] = BITS
                best = differ.argmin(axis=1)
                good = np.flatnonzero(differ[np.arange(len(best)), best] <= FAR)
                a.append(node[at + good])
                b.append(node[low + best[good]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            part = [np.stack(columns[:2], axis=1), *columns[2:5], np.stack(columns[5:], axis=1).view(np.uint64)]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            # The last group may go on.
            cut = int((held[0] != held[0][-1]).any(axis=1).sum()) if len(held[0]) else 0
            if cut:
                yield pairs(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield pairs(*held)

    block = F.pmod(F.xxhash64("node"), "blocks").alias("block")
    dealt = rows.select("band", block, "root", "node", "x.n", *(f"x.{m}" for m in BITS_OF)).repartition(partitions(rows.sparkSession), "band", "block").sortWithinPartitions("band", "block")
    found = dealt.mapInArrow(run, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_links(nodes: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Links (a, b) that connect all candidates with the similarity, from distinct nodes."""
    # Operator 8: nodes of one fingerprint, and fingerprints that meet at an anchor.
    fps = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    first = fps.toDF("fp", "a")
    same = nodes.join(first.hint("merge"), "fp").filter("node <> a").select("a", F.col("node").alias("b"))
    ends = anchor_links(fps).toDF("fa", "fb").join(fps.toDF("fa", "a").hint("merge"), "fa").join(fps.toDF("fb", "b").hint("merge"), "fb").select("a", "b")
    # Every node and its bands' least ones.
    rows = nodes.select(F.explode("bands").alias("band"), "node")
    heads = rows.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("high")).filter("a < high").drop("high")
    stars = rows.join(heads.hint("merge"), "band").filter("node <> a").select("a", F.col("node").alias("b"))
    pairs = same.unionAll(ends).unionAll(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = materialise(sifted(pairs, nodes), "stars")
    linked = settled(met, nodes, docs, text, "linked")
    roots = materialise(components(linked).toDF("node", "root"), "firstroots")

    # Bands that still hold several groups, in blocks: each row and its nearest one.
    own = nodes.select("node", "bands").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = own.select(F.explode("bands").alias("band"), "root", "node")
    mixed = rows.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("c")).filter("low <> high")
    rows = rows.join(mixed.select("band", F.ceil(F.col("c") / CELL).cast("long").alias("blocks")).hint("merge"), "band")
    rows = materialise(rows.join(nodes.select("node", F.struct("n", *BITS_OF, "bands").alias("x")).hint("merge"), "node"), "mixed")
    close = materialise(sifted(nearest(rows).join(met.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), nodes), "nearest")
    linked = materialise(linked.unionAll(settled(close, nodes, docs, text, "closer")), "linked")
    roots = materialise(components(linked).toDF("node", "root"), "secondroots")

    # All pairs of groups that are still apart, in cells.
    rows = rows.drop("root").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    block, every = F.pmod(F.xxhash64("node"), "blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = rows.select("band", block.alias("i"), every.alias("j"), F.col("root").alias("ra"), F.col("node").alias("a"), F.col("x").alias("xa"))
    right = rows.select("band", every.alias("i"), block.alias("j"), F.col("root").alias("rb"), F.col("node").alias("b"), F.col("x").alias("xb"))
    # A pair leaves the join in the least of its common bands alone, so each one once.
    least = F.array_min(F.array_intersect("xa.bands", "xb.bands")) == F.col("band")
    crossed = left.hint("merge").join(right, ["band", "i", "j"]).filter((F.col("ra") < F.col("rb")) & _plausible("xa", "xb") & least)
    crossed = crossed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (_differ("xa", "xb") <= CLOSE).alias("close"))
    known = met.select("a", "b").unionAll(close.select("a", "b")).hint("merge")
    rest = materialise(crossed.join(known, ["a", "b"], "left_anti"), "rest")
    return linked.unionAll(settled(rest, nodes, docs, text, "more"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, th (xxhash64 of the text), root (the group) and component_id (the group's smallest key) of every row."""
    rows = materialise(features(docs, key, text), "shingles")
    # Rows of one node differ in key, th and fingerprint (by repeated shingles) alone.
    nodes = materialise(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ["n", *BITS_OF, "bands"]), F.min("fp").alias("fp"), F.min("th").alias("th"), F.min("key").alias("least")), "nodes")
    roots = materialise(components(near_links(nodes, docs, text)).toDF("node", "root"), "roots")
    found = materialise(nodes.select("node", "least").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = found.drop("least").join(least, "root")
    return rows.select(F.col("key").alias(key), "th", "node").join(groups, "node").drop("node")
