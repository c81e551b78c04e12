"""Operator 2: language ID by string kernels, Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the mean, over byte n-grams of length 1 to 3, of the cosine between the sets
of n-grams present (one and two bytes exactly, three hashed). Landmarks are sample texts; the Nyström map
sends a text to its kernels with the landmarks times the inverse root of the landmarks' own kernel
matrix; ridge regression on that gives one score a language. As the kernel is a product of explicit
presence vectors, landmarks and regression fold into one matrix, and texts are scored by products of
batches of presence vectors with it.

The model is fitted on at most ``per_language`` labelled texts of each language (the bound on the
sample; the first by a hash of the id), which the driver holds as packed bits, 13 KB each. The first of
them in that order are the landmarks, so that they are a sample of the sample.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is everything if no text is
labelled. Equal scores go to the first language in order. A null id counts as an empty one, and is not
learnt from. Repeated rows get a row each; those of an id that is learnt from count by their texts. Texts
are taken whole, a block at a time. An empty table gives an empty result. Names may clash: columns other
than key, text and language are carried along by place, or not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PER_LANGUAGE, LANDMARKS, RIDGE, SHARP = 300, 32, 1e-3, 2.0
#: N-grams of each length from 1: bytes and pairs as they are, triples hashed.
WIDTHS = (256, 1 << 16, 1 << 15)
WIDTH = sum(WIDTHS)
BLOCK, ROWS = 1 << 20, 64
#: Parts of a language, of which each gives its first ids.
PARTS = 64
_LETTER = regex.compile(r"\p{L}")
#: ASCII without letters counts as white space.
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def presence(text: str, row: np.ndarray) -> None:
    """Mark a text's n-grams in a row of WIDTH zeros."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace").translate(_TABLE), np.uint8)
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK + 2].astype(np.uint32)
        row[block] = 1
        two = block[:-1] << 8 | block[1:]
        row[WIDTHS[0] + two] = 1
        three = two[:-1] << 8 | block[2:]
        row[WIDTHS[0] + WIDTHS[1] + (three * np.uint32(2654435761) >> 17)] = 1


def scaled(rows: np.ndarray) -> np.ndarray:
    """Presence rows scaled so that their products are kernels."""
    out, at = rows.astype(np.float32), 0
    for width in WIDTHS:
        part = out[:, at : at + width]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1) * len(WIDTHS))
        at += width
    return out


def fit(rows: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """The languages, and the matrix that sends a scaled row to their scores. ``rows`` are packed bits, a
    language's first ones its landmarks."""
    names = sorted(set(labels))
    own = np.array([names.index(x) for x in labels])
    chosen = np.concatenate([np.flatnonzero(own == k)[:landmarks] for k in range(len(names))])
    open_ = lambda part: scaled(np.unpackbits(part, axis=1)[:, :WIDTH])
    z = open_(rows[chosen])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    kept = values > 1e-8 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    psi = np.concatenate([open_(rows[i : i + ROWS]) @ z.T for i in range(0, len(rows), ROWS)]) @ root
    weight = (1 / np.bincount(own, minlength=len(names)))[own] / len(names)
    target = np.where(own[:, None] == np.arange(len(names)), 1.0, -1.0)
    solved = np.linalg.solve(psi.T @ (psi * weight[:, None]) + ridge * np.eye(psi.shape[1]), psi.T @ (target * weight[:, None]))
    return names, (z.T @ (root @ solved)).astype(np.float32)


def least_score(languages: int, share: float) -> float:
    """The score that is ``share`` times an even one, or half the best that there can be if that is less,
    so that clear answers pass however many languages there are."""
    best = np.exp(2 * SHARP) / (np.exp(2 * SHARP) + max(languages - 1, 0))
    return min(share / max(languages, 1), best / 2)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def predict(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if names and has_letter(t)]
    for at in range(0, len(known), ROWS):
        part = known[at : at + ROWS]
        rows = np.zeros((len(part), WIDTH), np.uint8)
        for row, i in zip(rows, part, strict=True):
            presence(texts[i], row)
        found = scaled(rows) @ matrix
        grown = np.exp(SHARP * (found - found.max(axis=1, keepdims=True)).astype(np.float64))
        sure = grown.max(axis=1) / grown.sum(axis=1)
        for i, k, s in zip(part, found.argmax(axis=1).tolist(), sure.tolist(), strict=True):
            langs[i], scores[i] = names[k], s
    return langs, scores


def remainder(key: str, by: int):
    """crc32 of the id as text, modulo ``by``; of the empty text if null."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """key, lang, bits (packed presence) of at most ``per_language`` labelled texts of each language whose
    remainder by 3 is not 1, even where ids repeat."""

    def first(df: DataFrame, key: str, *by) -> DataFrame:
        order = [F.xxhash64(key), F.col(key), *([F.col("bits")] if "bits" in df.columns else [])]
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= per_language).drop("rank")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for t in batch.column(2).to_pylist():
                row = np.zeros(WIDTH, np.uint8)
                presence(t, row)
                packed.append(np.packbits(row).tobytes() if has_letter(t) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["key", "lang", "bits"])

    labelled = docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & (remainder(key, 3) != 1))
    # Ids first, without texts: the first by hash of each part of a language, then of the language, so that
    # a task meets PARTS times per_language ids at most, or a PARTS-th of what the scan's tasks send.
    named = labelled.select(F.col(key).alias("key"), F.col(lang).alias("lang"))
    ids = first(first(named, "key", "lang", F.pmod(F.xxhash64("key"), F.lit(PARTS))), "key", "lang").select("key").distinct()
    # At most per_language ids a language: small enough to broadcast.
    chosen = labelled.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter("text IS NOT NULL").join(F.broadcast(ids), "key", "left_semi")
    kinds = [docs.schema[x].dataType.simpleString() for x in (key, lang)]
    return first(chosen.mapInArrow(bits, f"key {kinds[0]}, lang {kinds[1]}, bits binary").filter("bits IS NOT NULL"), "key", "lang")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Fit on a bounded sample of labelled texts whose remainder by 3 is not 1."""
    got = sample(docs, key, text, lang, per_language).select("lang", F.xxhash64("key").alias("h"), "bits").collect()
    if not got:
        return [], np.zeros((WIDTH, 0), np.float32)
    got.sort(key=lambda r: (r["lang"], r["h"], bytes(r["bits"])))
    rows = np.stack([np.frombuffer(r["bits"], np.uint8) for r in got])
    return fit(rows, [r["lang"] for r in got])


def _rows(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str, least: float | None) -> DataFrame:
    """All columns by number, so that names may clash, then language and score; with ``least``, only
    the columns of rows whose language is known with that score."""
    names, matrix = model
    at = docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kinds = [f.dataType.simpleString() for f in docs.schema] + (["string", "double"] if least is None else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(batch.column(at).to_pylist(), names, matrix)
            if least is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [f"c{i}" for i in range(batch.num_columns + 2)])
            else:
                yield batch.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return plain.mapInArrow(run, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """All columns, then lang_pred and score."""
    return _rows(docs, model, text, None).toDF(*docs.columns, "lang_pred", "score")


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is recognised with at least this score."""
    return _rows(docs, model, text, least).toDF(*docs.columns)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language": op2_language}
ORACLES: dict[str, str] = {}
