"""Operator 4: byte-level BPE encoding and decoding with the tokenizers library.

Texts are cut where a space precedes a character that is no white space. The split pattern always
has a boundary there, so the parts can be encoded apart, and each distinct part of an Arrow batch is
encoded once. Parts that begin with one space and a character that is no white space are joined to texts
of a few KB for the library and told apart again by the tokens' byte lengths (the offsets of a
byte-level vocabulary); others are texts of their own. Texts that hold a special token of a tokenizer
file go to the library as they are.

Edge cases: a null text counts as empty (no ids; digests of the empty string). Rows that repeat give
rows that repeat. Texts of any length are encoded whole. An empty table gives an empty result. Other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of distinct parts that one call of the library gets, and of one text in it.
CALL_BYTES, TEXT_BYTES = 1 << 19, 1 << 12
#: Bytes of text that are encoded at once.
SLICE_BYTES = 4 << 20
#: Distinct parts whose ids a worker keeps between batches.
KEEP = 150_000


@lru_cache(maxsize=1)
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in vocabularies of this kind."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token: what is left when a token's bytes are merged with the ranks
    below its own."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = min(found)
            if best >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


def build_tokenizer(path: str):
    """A tokenizers.Tokenizer of a rank file (.tiktoken), without special tokens, or of a tokenizer file
    (.json) as it is: its special tokens are known where a text holds them."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    if path.endswith(".json"):
        return Tokenizer.from_file(path)
    ranks, chars = read_ranks(path), byte_chars()
    show = lambda token: "".join(chars[b] for b in token)
    made = Tokenizer(models.BPE({show(t): r for t, r in ranks.items()}, [(show(a), show(b)) for a, b in merges_of(ranks)]))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return made


class Codec:
    """Encodes Arrow arrays of texts and decodes ids. One per worker and path."""

    def __init__(self, path: str):
        self.tokenizer = build_tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        back = {c: b for b, c in enumerate(byte_chars())}
        self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, at in vocabulary.items():
            if all(c in back for c in token):
                self.token_bytes[at] = bytes(back[c] for c in token)
        self.lengths = np.array([len(t) for t in self.token_bytes], np.int64)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}

    def _encode_parts(self, parts: list[str], counts: list[int]) -> list[bytes]:
        """The ids of each part as 32-bit numbers. Those that come often are kept for later batches."""
        kept = self.kept
        out = [kept.get(p) for p in parts]
        missing = [i for i, ids in enumerate(out) if ids is None]
        at, n = 0, len(missing)
        while at < n:
            texts, call, size = [], [], 0
            while at < n and size < CALL_BYTES:
                text, text_size = [], 0
                while at < n and text_size < TEXT_BYTES:
                    part = parts[missing[at]]
                    # Only before one space and no more white space is there always a boundary.
                    if text and (part[:1] != " " or part[1:2].isspace() or len(part) < 2):
                        break
                    text.append(part)
                    text_size += len(part)
                    at += 1
                texts.append("".join(text))
                call += text
                size += text_size
            sizes = np.fromiter(map(len, map(str.encode, call)), np.int64, len(call))
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            flat = np.fromiter(chain.from_iterable(ids), np.uint32)
            ends = np.searchsorted(np.cumsum(self.lengths[flat]), np.cumsum(sizes)) + 1
            ends[sizes == 0] = 0
            raw, ends = flat.tobytes(), (np.maximum.accumulate(ends) * 4).tolist()
            begin = 0
            for i, end in zip(missing[at - len(call) : at], ends, strict=True):
                out[i] = raw[begin:end]
                begin = end
        often = {parts[i]: out[i] for i in missing if counts[i] > 2}
        if len(kept) + len(often) > KEEP:
            kept.clear()
        if len(often) <= KEEP:
            kept.update(often)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one array of 32-bit numbers, and where each text's ids begin (and the end)."""
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not special.any():
            return self._encode_plain(texts)
        ids, starts = self._encode_plain(texts.filter(pa.array(~special)))
        lists, plain = [], iter(zip(starts, starts[1:], strict=False))
        for x, whole in zip(texts, special.tolist(), strict=True):
            if whole:
                lists.append(np.array(self.tokenizer.encode(x.as_py(), add_special_tokens=False).ids, np.uint32))
            else:
                a, b = next(plain)
                lists.append(ids[a:b])
        return np.concatenate(lists), np.cumsum([0, *map(len, lists)])

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        pieces = pc.split_pattern(texts, " ")
        starts = pieces.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        coded = pieces.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        first = np.zeros(len(codes), bool)
        first[starts[:-1]] = True
        opens = np.array([w != "" and not w[0].isspace() for w in words], bool)[codes] | first
        heads = np.flatnonzero(opens)
        spans = np.diff(heads, append=len(codes))
        # Most parts are one piece after a space: told apart by the piece's code. Others are built.
        plain = (spans == 1) & ~first[heads]
        counts = np.bincount(codes[heads[plain]], minlength=len(words))
        used = np.flatnonzero(counts)
        where = np.cumsum(counts > 0) - 1
        parts = [" " + words[c] for c in used.tolist()]
        often = counts[used].tolist()
        slot = np.empty(len(heads), np.int64)
        slot[plain] = where[codes[heads[plain]]]
        odd: dict[str, int] = {}
        rest = np.flatnonzero(~plain)
        slots = []
        for a, b, start in zip(heads[rest].tolist(), (heads + spans)[rest].tolist(), first[heads[rest]].tolist(), strict=True):
            part = ("" if start else " ") + " ".join([words[c] for c in codes[a:b].tolist()])
            slots.append(odd.setdefault(part, len(parts) + len(odd)))
        slot[rest] = slots
        raw = self._encode_parts(parts + list(odd), often + [1] * len(odd))
        flat = np.frombuffer(b"".join(raw), np.uint32)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        begin = np.cumsum(sizes) - sizes
        got = sizes[slot]
        upto = np.cumsum(got)
        ids = flat[np.arange(upto[-1]) + np.repeat(begin[slot] - (upto - got), got)] if upto[-1] else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], upto])[np.searchsorted(heads, starts)]

    def decode(self, ids) -> bytes:
        """The bytes of the ids. A character split over tokens comes together here, as only bytes are joined."""
        names = self.token_bytes
        return b"".join([names[i] for i in ids])

    def decode_text(self, ids) -> str:
        """The text; bytes that are no UTF-8 (ids cut inside a character) become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def slices(batch: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about SLICE_BYTES of text, which bounds the encoder's memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def sliced(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text):
            yield part
            pa.default_memory_pool().release_unused()


def texts_of(column: pa.Array) -> pa.Array:
    """Texts without nulls, as strings with 64-bit offsets."""
    return pc.fill_null(column, "").cast(pa.large_string())


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int> and the byte offsets [start of each token] of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in sliced(batches):
            ids, starts = coder.encode(texts_of(batch.column(1)))
            lists = [ids[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            offsets = [np.cumsum(coder.lengths[x]) - coder.lengths[x] for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64()))], ["key", "ids", "offsets"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>, offsets array<bigint>").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        decimal = [str(i) for i in range(len(coder.token_bytes))]
        for batch in sliced(batches):
            ids, starts = coder.encode(texts_of(batch.column(1)))
            counts, written, decoded = np.diff(starts), [], []
            for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                own = ids[a:b].tolist()
                written.append(hashlib.sha256(" ".join([decimal[i] for i in own]).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(written), pa.array(decoded)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
ORACLES: dict[str, str] = {}
