"""Operator 3: fuzzy search for licence notices.

Texts are brought to lower-case words (runs of ASCII letters and digits and of any other characters
beyond ASCII) joined by single spaces. Base phrases are found exactly, word by word. For notices up to
``errors`` edits away, each notice is split into errors + 1 seeds: by the pigeonhole principle one of
them stands unchanged in any match. Seeds are found exactly by one automaton, and the regex library's
bounded-error matching verifies a window around each and gives the span and the edits. The score is 1
for an exact phrase, else the best share of a notice's characters that stand unedited, else 0.

Edge cases: a null or empty text has no words, empty labels, null first_word and last_word, score 0.
Repeated rows are repeated. Long texts are searched whole: memory is a few times the text. An empty
table gives an empty result. Columns other than key and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes

#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices for fuzzy search, their labels and the edits allowed.
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("apache license", "apache", 1),
    ("mit license", "mit", 1),
    ("gnu lesser general public license", "lgpl", 3),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc-by", 3),
    ("bsd 3 clause license", "bsd", 2),
    ("bsd 2 clause license", "bsd", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("this program is free software you can redistribute it and or modify it", "gpl", 6),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("released into the public domain", "public-domain", 3),
    ("all rights reserved", "all-rights-reserved", 1),
)
#: All ASCII but letters and digits as a space, capitals as small letters.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def normalise(data: bytes) -> bytes:
    """The words of a text, joined by single spaces."""
    return b" ".join(data.translate(_TABLE).split())


def base_places(norm: bytes) -> list[tuple[int, str]]:
    """(word number, label) of each place where a phrase's words stand consecutively, in order."""
    found = []
    for phrase, label in PHRASES:
        raw, at = phrase.encode(), norm.find(phrase.encode())
        while at >= 0:
            end = at + len(raw)
            if (at == 0 or norm[at - 1] == 32) and (end == len(norm) or norm[end] == 32):
                found.append((at, label))
            at = norm.find(raw, at + 1)
    found.sort()
    words, counted, out = 0, 0, []
    for at, label in found:
        words += norm.count(b" ", counted, at)
        counted = at
        out.append((words, label))
    return out


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, seed): errors + 1 parts of near equal length."""
    n = errors + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=1)
def _search():
    """The automaton of all seeds, and each notice's pattern, compiled."""
    by_seed: dict[str, list] = {}
    patterns = []
    for k, (notice, label, errors) in enumerate(NOTICES):
        patterns.append((regex.compile(rf"(?b)(?<= )(?:{regex.escape(notice)}){{e<={errors}}}(?= )"), notice, label, errors))
        for offset, seed in seeds(notice, errors):
            by_seed.setdefault(seed, []).append((k, offset))
    automaton = ahocorasick.Automaton()
    for seed, uses in by_seed.items():
        automaton.add_word(seed, (len(seed), uses))
    automaton.make_automaton()
    return automaton, patterns


def fuzzy_matches(norm: bytes) -> list[tuple[str, int, int, int, str]]:
    """(label, begin, end, edits, notice) of the best match about each candidate; positions in ``norm``."""
    automaton, patterns = _search()
    # A byte is a character, so positions are those of the bytes; a space on each side bounds all words.
    text = f" {norm.decode('latin-1')} "
    found, reached = {}, {}
    for last, (size, uses) in automaton.iter(text):
        for k, offset in uses:
            pattern, notice, label, errors = patterns[k]
            start = last + 1 - size - offset
            # With the bounding space, and so that the match may begin and end ``errors`` aside.
            window = max(0, start - errors - 1), start + len(notice) + errors + 1
            if reached.get(k) == window:
                continue
            reached[k] = window
            got = pattern.search(text[window[0] : window[1]])
            if got is not None:
                a = window[0] + got.start() - 1
                found[k, a] = (label, a, a + got.end() - got.start(), sum(got.fuzzy_counts), notice)
    return sorted(found.values())


def scan_text(data: bytes) -> dict:
    norm = normalise(data)
    places = base_places(norm)
    fuzzy = fuzzy_matches(norm)
    base = {label for _, label in places}
    # Word numbers by one running count over the places in order.
    word, words, counted = {}, 0, 0
    for at in sorted({x for _, a, b, *_ in fuzzy for x in (a, b)}):
        words += norm.count(b" ", counted, at)
        word[at], counted = words, at
    spans = [{"label": x, "begin_word": word[a], "end_word": word[b] + 1, "edits": e} for x, a, b, e, _ in fuzzy]
    score = 1.0 if places else max([0.0, *(1 - e / len(notice) for *_, e, notice in fuzzy)])
    return {
        "n_words": norm.count(b" ") + 1 if norm else 0, "n_base": len(places), "first_word": places[0][0] if places else None, "last_word": places[-1][0] if places else None,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {x[0] for x in fuzzy})), "score": score, "spans": spans,
    }


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, begin_word: bigint, end_word: bigint, edits: int>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("begin_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())]))
_ARROW = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _SPANS}


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts, labels, score and the spans of fuzzy matches of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[n] for x in found], kind) for n, kind in _ARROW.items())], ["key", *_ARROW])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text_bytes(text).alias("t")).mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op3_licenses": op3_licenses}
ORACLES: dict[str, str] = {}
