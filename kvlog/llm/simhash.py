"""Operator 8: SimHash near-duplicate groups by anchor points of a covering code.

A fingerprint's 64 bits are three segments (21, 21 and 22 bits); two fingerprints that differ in at
most 4 bits differ in at most 1 bit of some segment. The anchors of a segment are the words of a
covering code of radius 1: a perfect Hamming(15, 11) code on 15 bits, all values on the others. A
fingerprint's home is its nearest anchor; it is also sent to each anchor within radius plus threshold
that is the home of some value one bit away. So of two linked fingerprints, one meets the other at its
home. Distinct fingerprints alone are sent, so exact copies cost nothing, and each anchor's matches
leave it as the stars of a forest, so large groups of near copies give no pairs. A hot anchor, with
more rows than an even partition, is a square of cells: its rows are dealt over blocks, and cell (i, j)
compares the homes of block i with the rows of block j, so no task holds the anchor whole. Which anchors
are hot comes from a sample of the distinct fingerprints and decides only where rows are sent.

Edge cases: a null or empty text has fingerprint 0, which links like any other. A null doc_id takes
part and gets the group's smallest id (null if there is none). Repeated rows are repeated. Texts of any
length are taken whole, a block of words at a time. An empty table gives an empty result. Columns other
than key and text, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions, table, text_bytes
from .components import components, merge_labels

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: First bit and bits of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
BLOCK = 1 << 20
#: One distinct fingerprint in SAMPLE is read for hot anchors, of which a block has LEAST sampled rows at least.
SAMPLE, LEAST = 64, 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, about ``block`` bytes at a time."""
    at = 0
    while at < len(data):
        stop = len(data)
        if stop - at > block:
            cut = _SPACE.search(data, at + block)
            stop = cut.start() if cut else stop
        yield data[at:stop].split()
        at = stop


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if set in over half the XXH64 of the word shingles, repeats included."""
    digest, total, n, carry = xxhash.xxh64_digest, np.zeros(64, np.int64), 0, []
    for words in word_blocks(data.lower()):
        words = carry + words
        carry = words
        if len(words) < shingle:
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
        joined = b" ".join(words)
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(starts)
        carry = words[1 - shingle :] if shingle > 1 else []
    if not n and carry:
        return int.from_bytes(digest(b" ".join(carry), seed), "big")
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint (64 bits as bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text_bytes(text).alias("t")).mapInArrow(run, f"key {kind}, fp bigint")


@lru_cache(maxsize=1)
def code_homes() -> np.ndarray:
    """The nearest word of the Hamming(15, 11) code for each 15-bit value: the sum of the numbers of its
    set bits names the bit to flip."""
    values = np.arange(1 << 15, dtype=np.int32)
    syndrome = np.zeros_like(values)
    for bit in range(15):
        syndrome ^= np.where(values >> bit & 1, bit + 1, 0).astype(np.int32)
    return np.where(syndrome, values ^ (1 << np.maximum(syndrome - 1, 0)), values).astype(np.int32)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of all anchors that the fingerprints are sent to."""
    homes, found = code_homes(), []
    for k, (first, bits) in enumerate(SEGMENTS):
        value = (fps >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)
        code, rest = value & 0x7FFF, value >> 15
        home = homes[code].astype(np.int64)
        near = np.stack([home, *(homes[code ^ (1 << i)].astype(np.int64) for i in range(15))], axis=1)
        near = np.sort(near, axis=1)
        fresh = np.concatenate([np.ones((len(fps), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        row, column = np.nonzero(fresh)
        word = near[row, column]
        found.append((row, k << 22 | rest[row] << 15 | word, word == home[row]))
        every = np.arange(len(fps))
        found += [(every, k << 22 | (rest ^ (1 << i)) << 15 | home, np.zeros(len(fps), bool)) for i in range(bits - 15)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _compare(threshold: int, at_once: int = 2_000_000):
    """Rows (anchor, fp, home) sorted by anchor -> links (a, b), a forest's stars for each block."""

    def links(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(starts, append=len(key))
        group = np.repeat(np.arange(len(starts)), sizes)
        own = np.flatnonzero(home)
        first, count = starts[group[own]], sizes[group[own]]
        upto = np.cumsum(count)
        at = 0
        while at < len(own):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + at_once, "right")))
            a, n = own[at:stop], count[at:stop]
            left = np.repeat(a, n)
            right = np.arange(n.sum()) + np.repeat(first[at:stop] - (np.cumsum(n) - n), n)
            near = np.bitwise_count(fp[left] ^ fp[right]) <= threshold
            x, y = fp[left[near]], fp[right[near]]
            x, y = x[x != y], y[x != y]
            if len(x):
                nodes, both = np.unique(np.concatenate([x, y]), return_inverse=True)
                label = merge_labels(len(nodes), both[: len(x)], both[len(x) :])
                tied = label != np.arange(len(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[label[tied]].view(np.int64)), pa.array(nodes[tied].view(np.int64))], ["a", "b"])
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
            held.append(part)
            if held[0][0][0] == part[0][-1] or sum(len(x[0]) for x in held) < 100_000:
                continue  # one anchor goes on, or there is little yet
            key, fp, home = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            yield from links(key[:cut], fp[:cut], home[:cut])
            held = [(key[cut:], fp[cut:], home[cut:])]
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def hot_anchors(fps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted anchors with more rows than an even partition, and the blocks of each: as many as even
    partitions it has. There are at most as many hot anchors as partitions."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(anchors(batch.column(0).to_numpy().view(np.uint64))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["anchor", "n"])

    some = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).select("fp")
    sent = 45 * some.count()  # about 45 anchors each
    even = max(sent / partitions(fps.sparkSession), LEAST)
    got = some.mapInArrow(count, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") > even).orderBy("anchor").collect()
    return np.array([r["anchor"] for r in got], np.int64), np.array([-(-r["n"] // even) for r in got], np.int64)


def cells(fps: np.ndarray, anchor: np.ndarray, home: np.ndarray, blocks: np.ndarray, at_once: int = 500_000) -> Iterator[tuple]:
    """(key, fingerprint, is home) of rows of hot anchors in all cells that they are sent to; the key is
    the anchor and the cell. Row i has ``blocks[i]`` blocks at its anchor."""
    own = ((fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks
    step = max(1, at_once // (2 * int(blocks.max(initial=1))))
    for at in range(0, len(fps), step):
        part = slice(at, at + step)
        n = blocks[part]
        row = np.repeat(np.arange(at, at + len(n)), n)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        # As a row of block j, in the cells (0..n, j); as a home of block i, in the cells (i, 0..n).
        as_row, as_home = ~(home[row] & (turn == own[row])), home[row]
        cell = np.concatenate([(turn * blocks[row] + own[row])[as_row], (own[row] * blocks[row] + turn)[as_home]])
        row, is_home = np.concatenate([row[as_row], row[as_home]]), np.repeat([False, True], [as_row.sum(), as_home.sum()])
        yield anchor[row] << 32 | cell, fps[row], is_home


def near_links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all that differ in at most
    ``threshold`` (4) bits."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            row, anchor, home = anchors(own)
            split = np.isin(anchor, hot)
            parts = [(anchor[~split] << 32, own[row[~split]], home[~split])]
            blocks = counts[np.searchsorted(hot, anchor[split])]
            for key, fp, first in chain(parts, cells(own[row[split]], anchor[split], home[split], blocks)):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)), pa.array(first)], ["anchor", "fp", "home"])

    if threshold > 4:
        raise ValueError("the segments cover thresholds up to 4")
    hot, counts = hot_anchors(fps)
    sent = fps.select("fp").mapInArrow(send, "anchor bigint, fp bigint, home boolean")
    dealt = sent.repartition(partitions(fps.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compare(threshold), "a bigint, b bigint")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp and component_id (the group's smallest key) of every row."""
    prints = materialise(fingerprints(docs, key, text), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    roots = materialise(components(near_links(distinct)).toDF("fp", "root"), "roots")
    least = roots.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(least, "root").select("fp", "component_id")
    groups = materialise(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "groups")
    return prints.join(groups, "fp").select(F.col("key").alias(key), "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}
