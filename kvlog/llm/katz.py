"""Operator 1: a Katz backoff bigram model, trained and evaluated over partitioned tables of counts.

P(w | h) = d(c) * c / c(h) if the bigram was seen c > 0 times, else alpha(h) * P(w); with h unseen, P(w).
P(w) = d(c) * c / N if the word was seen, else what the discounts leave, for the one unknown word.
d is Katz's Good-Turing discount for counts up to K; alpha(h) is what the bigrams of h leave over, by
what the lower order gives to words not seen after h, so every distribution sums to one exactly.

Data flow, by RDDs of packed arrays (a row per token would be several times the input):

1. Each chunk of texts is cut into words once. Its bigram occurrences go to the bucket of their history
   (of the history and the word, if the history is hot; of one of several parts, chosen by the chunk, if
   the bigram is hot itself), its distinct words with their training counts and the buckets they occur
   in to the bucket of the word. Counts are summed in the chunk first.
2. Word buckets sum the counts and send each history bucket the counts of the words it holds.
3. History buckets hold all occurrences of a bigram that isn't hot, so its count and its history's sums
   are local to them. A first run writes the tables of counts and sums, by kind and bucket, with counts of
   counts, sums over hot histories and the parts' counts of hot bigrams, which the driver adds up.
4. With the discounts known, the table of backoff weights is written from the sums. Each history bucket
   reads its histories' weights from it, scores its occurrences by the counts that stand beside them, and
   sends each chunk its texts' sums. What is hot is in bucket -1 of the tables, and goes to all buckets.

The shuffle files of step 1 and 2 serve steps 3 and 4; a lost executor's part is made again from
the same rows. Hot histories and bigrams come from a sample of rows, which decides only where rows are
sent. A history or bigram is hot with HOT of an even bucket, and a bigram has a part for each such share,
so both lists and all parts together number a few times the buckets.

Words are known by 64-bit hashes. Edge cases: a null or empty text is its end alone. A null id takes
part and counts as an empty one for the held-out rule. Repeated rows are trained on and scored each.
Texts of any length are taken whole. Columns other than key and text, whatever their names, are not read.
An empty table gives an empty result. Without training texts N and V are 0 and every token is unknown with probability 1. Where discounts
leave nothing over (no count up to K), seen probabilities are scaled by c(h) / (c(h) + 1).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table
from .langid import remainder

K = 5
#: Hashes of the begin and the end of a text.
BEGIN, END = 1, 2
#: Bytes of text in a chunk, and of Parquet for each bucket.
CHUNK, BUCKET = 16 << 20, 16 << 20
#: One row in SAMPLE is read for hot histories and bigrams; these have this share of an even bucket.
SAMPLE, HOT = 64, 0.25


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers as compressed byte planes; ``rising``: of their differences."""
    values = np.diff(values, prepend=values.dtype.type(0)) if rising and len(values) else np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T if len(values) else values.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes, kind: type, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if rising else values


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


class Hot(NamedTuple):
    """Sorted hashes of hot histories and of hot bigrams, and the parts that each of these has."""

    histories: np.ndarray
    bigrams: np.ndarray
    parts: np.ndarray

    def bucket_of(self, history: np.ndarray, word: np.ndarray, at: int, buckets: int) -> np.ndarray:
        """The history bucket of each token of chunk ``at``."""
        key = history.copy()
        split = np.isin(history, self.histories)
        key[split] = bigram_of(history[split], word[split])
        own = split & np.isin(key, self.bigrams)
        part = mix(np.array([at], np.uint64)) % self.parts[np.searchsorted(self.bigrams, key[own])]
        key[own] = mix(key[own]) + part
        return (mix(key) % np.uint64(buckets)).astype(np.int64)


def bigram_of(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return history ^ mix(word)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, code of each word, words in each text); A-Z in lower case."""
    column = pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string()))
    pieces = pc.ascii_split_whitespace(column)
    flat = pieces.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    upto = np.concatenate([[0], np.cumsum(real)])
    counts = np.diff(upto[ends])
    coded = flat.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(w) for w in coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()], np.uint64)
    return hashes, coded.indices.to_numpy()[real], counts


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes, code of each token's history, code of each token, text of each token)."""
    hashes, codes, counts = words_of(texts)
    names, place = np.unique(np.concatenate([hashes, np.array([BEGIN, END], np.uint64)]), return_inverse=True)
    place = place.astype(np.int32)
    begin, end = place[-2], place[-1]
    n, m = len(texts), len(codes)
    doc = np.repeat(np.arange(n, dtype=np.int32), counts + 1)
    last = np.cumsum(counts + 1) - 1
    word = np.full(m + n, end, np.int32)
    inner = np.ones(m + n, bool)
    inner[last] = False
    word[inner] = place[codes] if m else 0
    history = np.concatenate([place[-2:-1], word[:-1]])[: m + n]
    history[(last - counts)] = begin
    return names, history, word, doc


def by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) of each distinct key in order, the places rising; one sort for all."""
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return zip(found.tolist(), np.split(order, first[1:]), strict=False)


def chunk_records(at: int, rows: list[tuple], hot: Hot, buckets: int) -> Iterator[tuple[int, tuple]]:
    """What a chunk (rows of id, text, training) sends: keys below ``buckets`` are history buckets,
    those from there on word buckets."""
    names, history, word, doc = tokens_of([r[1] for r in rows])
    train = np.array([r[2] for r in rows], bool)
    held = np.packbits(train).tobytes()
    own = hot.bucket_of(names[history], names[word], at, buckets)
    # The words' side: training counts, and the history buckets in which each word occurs.
    counts = np.bincount(word[train[doc]], minlength=len(names))
    pairs = np.unique(word.astype(np.int64) * buckets + own)
    w, b = pairs // buckets, pairs % buckets
    home = (mix(names) % np.uint64(buckets)).astype(np.int64)
    places = np.bincount(w, minlength=len(names))
    used = np.flatnonzero(places)
    for (k, mine), (_, pair) in zip(by_key(home[used]), by_key(home[w]), strict=True):
        mine = used[mine]
        yield buckets + k, ("words", pack(names[mine], True), pack(counts[mine].astype(np.uint32)), pack(places[mine].astype(np.uint32)), pack(b[pair].astype(np.uint32)))
    # The histories' side: occurrences by history, in the order of the texts.
    by_history = np.argsort(history, kind="stable")
    for k, part in by_key(own[by_history]):
        part = by_history[part]
        h = history[part]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        seen, index = np.unique(word[part], return_inverse=True)
        yield k, ("pairs", at, len(rows), held, pack(names[h[first]], True), pack(np.diff(first, append=len(h)).astype(np.uint32)), pack(names[seen], True), pack(index.astype(np.uint32)), pack(doc[part].astype(np.uint32), True))
    tokens = np.bincount(doc, minlength=len(rows))
    yield at % buckets, ("texts", at, [r[0] for r in rows], held, tokens.astype(np.int64).tobytes())


def sent(hot: Hot, buckets: int):
    def run(index: int, rows: Iterator) -> Iterator[tuple[int, tuple]]:
        held, size, part = [], 0, 0
        for row in rows:
            held.append(tuple(row))
            size += len(row[1] or "")
            if size >= CHUNK:
                yield from chunk_records(index << 20 | part, held, hot, buckets)
                pa.default_memory_pool().release_unused()
                held, size, part = [], 0, part + 1
        if held:
            yield from chunk_records(index << 20 | part, held, hot, buckets)
            pa.default_memory_pool().release_unused()

    return run


def word_counts(records: Iterator[tuple[int, tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A word bucket's (hash, count) table and the (word, history bucket) pairs that ask for it."""
    names, counts, pair_names, pair_buckets = [], [], [], []
    for _, record in records:
        if record[0] != "words":
            continue
        _, raw, c, n, b = record
        name = unpack(raw, np.uint64, True)
        names.append(name)
        counts.append(unpack(c, np.uint32).astype(np.int64))
        pair_names.append(np.repeat(name, unpack(n, np.uint32)))
        pair_buckets.append(unpack(b, np.uint32))
    if not names:
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty, empty, empty
    every, place = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(every)).astype(np.int64)
    return every, total, np.searchsorted(every, np.concatenate(pair_names)), np.concatenate(pair_buckets).astype(np.int64)


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts[counts > 0], K + 2), minlength=K + 3)[: K + 2].astype(np.int64)


def word_stats(index: int, records: Iterator, buckets: int) -> Iterator[tuple]:
    if index % (2 * buckets) >= buckets:
        _, counts, _, _ = word_counts(records)
        yield int(counts.sum()), int((counts > 0).sum()), counts_of_counts(counts)


def word_replies(index: int, records: Iterator, buckets: int) -> Iterator[tuple[int, tuple]]:
    """To each history bucket the counts of the words it holds; to itself the table, for writing."""
    if index % (2 * buckets) < buckets:
        return
    names, counts, word, bucket = word_counts(records)
    pairs = np.unique(bucket * max(1, len(names)) + word)
    word, bucket = pairs % max(1, len(names)), pairs // max(1, len(names))
    for k, mine in by_key(bucket):
        mine = word[mine]
        yield k, ("counts", pack(names[mine], True), pack(counts[mine].astype(np.uint64)))
    known = counts > 0
    if known.any():
        yield index, ("table", pack(names[known], True), pack(counts[known].astype(np.uint64)))


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0..K+1 from counts of counts n[1..K+1]; the last holds for all larger counts. Where
    Good-Turing gives no value in (0, 1), an absolute discount from n[1] and n[2] stands in."""
    d = np.ones(K + 2)
    least = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    over = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        turing = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        d[r] = (turing - over) / (1 - over) if over < 1 else 0.0
        if not 0 < d[r] < 1:
            d[r] = (r - least) / r
    return d


class Lower:
    """The unigram distribution."""

    def __init__(self, total: int, kinds: int, n: np.ndarray):
        self.total, self.kinds, self.d = total, kinds, discounts(n)
        seen = sum(int(n[r]) * r for r in range(1, K + 1))
        kept = sum(int(n[r]) * r * self.d[r] for r in range(1, K + 1)) + (total - seen)
        self.scale = 1.0 if kept < total else total / (total + 1)
        self.unknown = 1 - kept * self.scale / total if total else 1.0

    def prob(self, counts: np.ndarray) -> np.ndarray:
        known = self.d[np.minimum(counts, K + 1)] * counts * (self.scale / max(1, self.total))
        return np.where(counts > 0, known, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.kinds + 1))


class Bucket:
    """All bigrams of a history bucket: types in the order of (history, word), and their occurrences.
    ``split`` tells the types that are hot bigrams, of which other buckets may hold parts."""

    def __init__(self, records: Iterator[tuple[int, tuple]], hot: Hot):
        pairs, replies, self.texts, self.weight_rows = [], [], [], []
        for _, record in records:
            {"pairs": pairs, "counts": replies, "texts": self.texts, "weight": self.weight_rows}.get(record[0], []).append(record[1:])
        names = [unpack(r[0], np.uint64, True) for r in replies]
        counts = [unpack(r[1], np.uint64).astype(np.int64) for r in replies]
        order = np.argsort(np.concatenate(names)) if names else np.zeros(0, np.int64)
        self.words = np.concatenate(names)[order] if names else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts)[order] if names else np.zeros(0, np.int64)
        hashes = [unpack(p[3], np.uint64, True) for p in pairs]
        self.histories = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.chunks, keys, docs, train, first = [], [], [], [], 0
        for (at, n, held, _, runs, seen, index, doc), h in zip(pairs, hashes, strict=True):
            ids = np.searchsorted(self.words, unpack(seen, np.uint64, True)).astype(np.uint64)
            own = np.repeat(np.searchsorted(self.histories, h).astype(np.uint64), unpack(runs, np.uint32))
            where = unpack(doc, np.uint32, True)
            keys.append(own << np.uint64(32) | ids[unpack(index, np.uint32)])
            docs.append(where + np.uint32(first))
            train.append(np.unpackbits(np.frombuffer(held, np.uint8))[where])
            self.chunks.append((at, first, n))
            first += n
        self.n_texts = first
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        del keys, pairs, hashes
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.history = (key[starts] >> np.uint64(32)).astype(np.int64)
        self.word = (key[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.sizes = np.diff(starts, append=len(key))
        self.doc = (np.concatenate(docs) if docs else np.zeros(0, np.uint32))[order]
        learnt = (np.concatenate(train) if train else np.zeros(0, np.uint8))[order]
        self.c = np.add.reduceat(learnt, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        self.bigrams = bigram_of(self.histories[self.history], self.words[self.word])
        self.split = np.isin(self.bigrams, hot.bigrams) & np.isin(self.histories, hot.histories)[self.history]

    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(c(h), scale of seen probabilities, alpha(h)) of each history, from the table of weights; a history
        that it doesn't have was not seen in training."""
        n = len(self.histories)
        total, scale, alpha = np.zeros(n), np.zeros(n), np.ones(n)
        for raw, totals, both in self.weight_rows:
            place = np.searchsorted(self.histories, unpack(raw, np.uint64, True))
            total[place] = unpack(totals, np.float64)
            scale[place], alpha[place] = unpack(both, np.float64).reshape(2, -1)
        return total, scale, alpha

    def sums(self, lower: Lower) -> np.ndarray:
        """For each history the sums over its bigrams that aren't hot."""
        own = ~self.split
        return history_sums(self.history[own], self.c[own], lower.prob(self.counts[self.word[own]]), len(self.histories))


def history_sums(history: np.ndarray, c: np.ndarray, lower: np.ndarray, n: int) -> np.ndarray:
    """For each of n histories: n[1..K], the sum of larger counts, and the lower order's sum over seen words."""
    out, large, seen = np.zeros((n, K + 2)), c > K, c > 0
    for r in range(1, K + 1):
        out[:, r - 1] = np.bincount(history[c == r], minlength=n)
    out[:, K] = np.bincount(history[large], c[large], n)
    out[:, K + 1] = np.bincount(history[seen], lower[seen], n)
    return out


def weights(sums: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c(h), scale of seen probabilities, alpha(h)) from rows of ``Bucket.sums``."""
    r = np.arange(1, K + 1)
    total = sums[:, :K] @ r + sums[:, K]
    kept = sums[:, :K] @ (r * d[1 : K + 1]) + sums[:, K]
    scale = np.where(kept < total * (1 - 1e-12), 1.0, total / (total + 1))
    left = 1 - kept * scale / np.maximum(total, 1)
    return total, scale, np.where(total > 0, left / np.maximum(1 - sums[:, K + 1], 1e-300), 1.0)


def bigram_row(bucket: int, history: np.ndarray, word: np.ndarray, c: np.ndarray) -> tuple:
    """A row of the table of bigrams, which are in the order of their histories."""
    every, first = np.unique(history, return_index=True)
    head = pack(every, True)
    runs = pack(np.diff(first, append=len(history)).astype(np.uint32))
    return "bigram", bucket, bytearray(len(head).to_bytes(8, "little") + head + runs), bytearray(pack(word)), bytearray(pack(c.astype(np.uint64)))


def weight_row(bucket: int, histories: np.ndarray, total: np.ndarray, scale: np.ndarray, alpha: np.ndarray) -> tuple:
    """A row of the table of weights, whose histories are sorted."""
    return "weight", bucket, bytearray(pack(histories, True)), bytearray(pack(total)), bytearray(pack(np.concatenate([scale, alpha])))


def model_rows(index: int, records: Iterator, buckets: int, lower: Lower, hot: Hot) -> Iterator[tuple]:
    """Rows (kind, bucket, data...) of the count tables, and what the driver needs of this bucket."""
    if index % (2 * buckets) >= buckets:
        for _, record in records:
            if record[0] == "table":
                yield "unigram", index - buckets, bytearray(record[1]), None, bytearray(record[2])
        return
    own = Bucket(records, hot)
    if own.split.any():
        # A hot bigram's part: the words' counts in all training texts, then the bigrams' in this part.
        both = np.concatenate([own.counts[own.word[own.split]], own.c[own.split]])
        yield "part", index, bytearray(own.histories[own.history[own.split]].tobytes()), bytearray(own.words[own.word[own.split]].tobytes()), bytearray(both.tobytes())
    seen = (own.c > 0) & ~own.split
    if seen.any():
        yield bigram_row(index, own.histories[own.history[seen]], own.words[own.word[seen]], own.c[seen])
    sums, hottest = own.sums(lower), np.isin(own.histories, hot.histories)
    learnt = ~hottest & (sums[:, : K + 1] > 0).any(axis=1)
    if learnt.any():
        yield "sums", index, bytearray(pack(own.histories[learnt], True)), bytearray(pack(sums[learnt].T.reshape(-1))), None
    yield "stats", index, bytearray(counts_of_counts(own.c[~own.split]).tobytes()), bytearray(own.histories[hottest].tobytes()), bytearray(sums[hottest].tobytes())


def scores(index: int, records: Iterator, buckets: int, lower: Lower, d: np.ndarray, hot: Hot, hot_weights: np.ndarray, hot_counts: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """To each chunk the sums over its texts' tokens that belong here: (chunk, arrays of base and model
    log10 probabilities and of known tokens)."""
    if index % (2 * buckets) >= buckets:
        return
    own = Bucket(records, hot)
    total, scale, alpha = own.weights()
    place = np.searchsorted(hot.histories, own.histories)
    split = np.isin(own.histories, hot.histories)
    for values, k in ((total, 0), (scale, 1), (alpha, 2)):
        values[split] = hot_weights[place[split], k]
    h, c, counts = own.history, own.c, own.counts[own.word]
    c[own.split] = hot_counts[np.searchsorted(hot.bigrams, own.bigrams[own.split])]
    seen = c > 0
    prob = alpha[h] * lower.prob(counts)
    prob[seen] = d[np.minimum(c[seen], K + 1)] * c[seen] * scale[h[seen]] / total[h[seen]]
    per = lambda values: np.bincount(own.doc, np.repeat(values, own.sizes), own.n_texts)
    model, base, known = per(np.log10(prob)), per(lower.base(counts)), per((counts > 0).astype(np.float64))
    for at, first, n in own.chunks:
        part = slice(first, first + n)
        yield at, ("sums", base[part].tobytes(), model[part].tobytes(), pack(known[part].astype(np.uint32)))
    for at, *rest in own.texts:
        yield at, ("texts", *rest)


def result_rows(records: Iterator[tuple[int, tuple]], total: int) -> Iterator[tuple]:
    texts: dict[int, tuple] = {}
    sums: dict[int, list] = {}
    for at, record in records:
        if record[0] == "texts":
            texts[at] = record[1:]
            continue
        base, model, known = np.frombuffer(record[1]), np.frombuffer(record[2]), unpack(record[3], np.uint32).astype(np.int64)
        if at in sums:
            for mine, more in zip(sums[at], (base, model, known), strict=True):
                mine += more
        else:
            sums[at] = [base.copy(), model.copy(), known]
    for at, (ids, held, tokens) in texts.items():
        base, model, known = sums[at]
        train = np.unpackbits(np.frombuffer(held, np.uint8))[: len(ids)]
        yield from zip(ids, (train == 0).tolist(), np.frombuffer(tokens, np.int64).tolist(), known.tolist(), [total] * len(ids), base.tolist(), model.tolist(), strict=True)


def _same(key: int) -> int:
    return key


def hot_keys(rows: DataFrame, buckets: int) -> Hot:
    """Histories and bigrams with a large share in a sample of rows (key, text): copies of a text are
    taken or not one by one. The begin is always among the histories."""
    part = rows.filter(F.pmod(F.xxhash64("key", "text"), F.lit(SAMPLE)) == 0).select("text")
    share = HOT / buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names, history, word, _ = tokens_of(batch.column(0).to_pylist())
            pairs, times = np.unique(history.astype(np.int64) * len(names) + word, return_counts=True)
            keys = [(names, np.bincount(history, minlength=len(names))), (bigram_of(names[pairs // len(names)], names[pairs % len(names)]), times)]
            least = max(1, share * len(word) / 2)
            kinds, values, counts = [np.zeros(1, np.int32)], [np.zeros(1, np.uint64)], [np.array([len(word)])]
            for kind, (own, c) in enumerate(keys, 1):
                large = c >= least
                for x, more in ((kinds, np.full(large.sum(), kind, np.int32)), (values, own[large]), (counts, c[large])):
                    x.append(more)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(values).view(np.int64)), pa.array(np.concatenate(counts))], ["kind", "key", "c"])

    counts = part.mapInArrow(run, "kind int, key bigint, c bigint").groupBy("kind", "key").agg(F.sum("c").alias("c"))
    counts = materialise(counts, "hot")
    total = counts.filter("kind = 0").agg(F.sum("c")).first()[0] or 0
    least = share * total
    # At most buckets / HOT of each kind.
    got = [(r.kind, r.key % (1 << 64), r.c) for r in counts.filter((F.col("kind") > 0) & (F.col("c") >= least)).collect()]
    histories = {k for kind, k, _ in got if kind == 1} | {BEGIN}
    bigrams = sorted((k, math.ceil(c / least)) for kind, k, c in got if kind == 2)
    return Hot(np.array(sorted(histories), np.uint64), np.array([k for k, _ in bigrams], np.uint64), np.array([p for _, p in bigrams], np.uint64))


def score_texts(docs: DataFrame, train, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row. ``train`` is a
    column that tells the rows to learn from. The tables of counts and weights stay in the shared folder."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(8, -(-size // BUCKET))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), train.alias("train"))
    hot = hot_keys(rows, buckets)
    first = rows.rdd.mapPartitionsWithIndex(sent(hot, buckets)).partitionBy(2 * buckets, _same)
    total, kinds, n = 0, 0, np.zeros(K + 2, np.int64)
    for a, b, c in first.mapPartitionsWithIndex(lambda i, r: word_stats(i, r, buckets)).collect():
        total, kinds, n = total + a, kinds + b, n + c
    lower = Lower(total, kinds, n)
    replies = first.mapPartitionsWithIndex(lambda i, r: word_replies(i, r, buckets)).partitionBy(2 * buckets, _same)
    both = first.union(replies)
    tables = f"{shared_dir(spark)}/katz-{uuid.uuid4().hex}"
    schema = "kind string, bucket int, histories binary, words binary, counts binary"
    spark.createDataFrame(both.mapPartitionsWithIndex(lambda i, r: model_rows(i, r, buckets, lower, hot)), schema).write.partitionBy("kind").parquet(tables)
    n, sums = np.zeros(K + 2, np.int64), np.zeros((len(hot.histories), K + 2))
    stored = spark.read.schema(schema).parquet(tables)
    for r in stored.filter("kind = 'stats'").collect():
        n = n + np.frombuffer(r["histories"], np.int64)
        sums[np.searchsorted(hot.histories, np.frombuffer(r["words"], np.uint64))] += np.frombuffer(r["counts"]).reshape(-1, K + 2)
    parts = {}
    for r in stored.filter("kind = 'part'").collect():
        counts = np.frombuffer(r["counts"], np.int64).reshape(2, -1)
        for h, w, times, c in zip(np.frombuffer(r["histories"], np.uint64), np.frombuffer(r["words"], np.uint64), *counts, strict=True):
            parts[h, w] = (times, parts.get((h, w), (0, 0))[1] + c)
    hot_counts, hottest = np.zeros(len(hot.bigrams), np.int64), []
    if parts:
        (h, w), (times, c) = np.array(list(parts), np.uint64).T, np.array(list(parts.values()), np.int64).T
        sums += history_sums(np.searchsorted(hot.histories, h), c, lower.prob(times), len(hot.histories))
        n = n + counts_of_counts(c)
        hot_counts[np.searchsorted(hot.bigrams, bigram_of(h, w))] = c
        order = np.lexsort((w, h))
        hottest = [bigram_row(-1, h[order], w[order], c[order])]
    d = discounts(n)
    hot_weights = np.stack(weights(sums, d), axis=1)
    hottest.append(weight_row(-1, hot.histories, *hot_weights.T))
    alphas = stored.filter("kind = 'sums'").rdd.map(lambda r: weight_row(r["bucket"], unpack(r["histories"], np.uint64, True), *weights(unpack(r["words"], np.float64).reshape(K + 2, -1).T, d)))
    spark.createDataFrame(alphas, schema).unionAll(spark.createDataFrame(hottest, schema)).write.mode("append").partitionBy("kind").parquet(tables)
    model = spark.read.schema(schema).parquet(tables).filter("kind = 'weight' AND bucket >= 0").rdd
    model = model.map(lambda r: (r["bucket"], (r["kind"], bytes(r["histories"]), bytes(r["words"]), bytes(r["counts"])))).partitionBy(2 * buckets, _same)
    scored = both.union(model).mapPartitionsWithIndex(lambda i, r: scores(i, r, buckets, lower, d, hot, hot_weights, hot_counts))
    made = scored.partitionBy(buckets, _same).mapPartitions(lambda r: result_rows(r, total))
    kind = docs.schema[key].dataType.simpleString()
    return spark.createDataFrame(made, f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)


QUERIES = {"op1_katz": op1_katz}
ORACLES: dict[str, str] = {}
