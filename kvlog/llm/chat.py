"""Operator 5: conversations as token sequences with a loss mask.

A turn is START role SEPARATOR text END, each a reserved id beyond the vocabulary; role and text are
encoded apart by the ordinary vocabulary, so no text yields a reserved id. In roles and texts, strings
that look like control strings are escaped: ``<``, any backslashes and ``|`` get one more backslash,
which is undone by taking one off. The loss mask is one on the ids of assistant texts, derived by a
prefix sum over +1 where such a text begins and -1 where it ends.

Turns are sorted by (turn, role, text) within a conversation and read as a stream, so that a hot
conversation needs no more memory than one turn: digests and sums are carried along.

Edge cases: a null text is empty, a null role is empty, null turns come first. A null conv_id is a
conversation of its own. Repeated rows are repeated turns. Long turns are encoded whole, a few MB of
others beside them at most. Columns other than these four are not read. An empty table gives an empty
result (the query: its own conversation alone). The query's conversation -1 joins a given one of that id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec, sliced
from .common import partitions, table

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, SEPARATOR, END)
_ESCAPE, _BACK = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"<\1|", text)


class Template:
    """Writes turns as ids with a loss mask, and reads them back."""

    def __init__(self, path: str):
        self.codec = codec(path)
        first = max(50_257, len(self.codec.token_bytes))
        self.ids = dict(zip(CONTROL, range(first, first + len(CONTROL)), strict=True))
        self.first = first

    def write(self, roles: list[str], texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, mask) of each turn."""
        parts = [escape(x) for pair in zip(roles, texts, strict=True) for x in pair]
        ids, at = self.codec.encode(pa.array(parts, pa.large_string()))
        out = []
        for i, role in enumerate(roles):
            head, body = ids[at[2 * i] : at[2 * i + 1]], ids[at[2 * i + 1] : at[2 * i + 2]]
            turn = np.concatenate([[self.ids[START]], head, [self.ids[SEPARATOR]], body, [self.ids[END]]]).astype(np.int32)
            step = np.zeros(len(turn) + 1, np.int8)
            if role == "assistant":
                step[len(head) + 2] += 1
                step[len(head) + 2 + len(body)] -= 1
            out.append((turn, np.cumsum(step[:-1]).astype(np.int8)))
        return out

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """(role, text, text under the mask, characters as formatted) of a turn's ids."""
        special = np.flatnonzero(ids >= self.first)
        if [int(x) for x in ids[special]] != [self.ids[x] for x in CONTROL] or special[0] or special[2] != len(ids) - 1:
            raise ValueError("not a turn")
        head = self.codec.decode(ids[1 : special[1]].tolist()).decode("utf-8", "surrogateescape")
        body = self.codec.decode(ids[special[1] + 1 : special[2]].tolist()).decode("utf-8", "surrogateescape")
        under = self.codec.decode(ids[mask == 1].tolist()).decode("utf-8", "surrogateescape")
        return unescape(head), unescape(body), unescape(under), len(head) + len(body) + sum(map(len, CONTROL))


def _sorted_turns(turns: DataFrame) -> DataFrame:
    named = turns.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return named.repartition(partitions(turns.sparkSession), "conv").sortWithinPartitions("conv", "turn", "role", "text")


def format_turns(turns: DataFrame, path: str) -> DataFrame:
    """conv_id, turn, ids and mask: one row per turn; a conversation's sequence is its rows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(path)
        for batch in sliced(batches, 3):
            made = template.write(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in made], pa.list_(pa.int32())), pa.array([m for _, m in made], pa.list_(pa.int8()))], ["conv", "turn", "ids", "mask"])

    kinds = [turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    return _sorted_turns(turns).mapInArrow(run, f"conv {kinds[0]}, turn {kinds[1]}, ids array<int>, mask array<tinyint>").withColumnRenamed("conv", "conv_id")


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """Digests of each conversation, from rows as ``format_turns`` gives them: a partition holds whole
    conversations, their turns in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, rows, now = Template(path), [], None

        def close() -> None:
            key, turns, digest, loss_chars, loss, chars = now
            rows.append((key, turns, digest.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def batch_of() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            rows.clear()
            return out

        for batch in batches:
            kind = batch.column(0).type
            for key, ids, mask in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if now is None or now[0] != key:
                    if now is not None:
                        close()
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, under, chars = template.read(ids.values.to_numpy(), mask.values.to_numpy())
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogateescape"))
                now[3] += len(under)
                now[4].update(under.encode("utf-8", "surrogateescape"))
                now[5] += chars
            if len(rows) >= 10_000:
                yield batch_of()
        if now is not None:
            close()
            yield batch_of()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "turn", "ids", "mask").mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = END + START + "assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    given = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    own = given.select(*(F.col(f.name).cast(f.dataType) for f in turns.schema))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return read_back(format_turns(turns.unionAll(own), path), path)


QUERIES = {"op5_chat": op5_chat}
ORACLES: dict[str, str] = {}
