"""Near-dedup of the pipeline: five-word shingles with a Jaccard similarity of 0.8."""

import random

import corpus_pipeline
import pytest

from kvlog.llm import near, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def rows():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 250))) for _ in range(40)]
    for i in range(120):  # some words changed, one after the other, so that many pairs lie near 0.8
        words = texts[rng.randrange(len(texts))].split()
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"z{i}"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), "", "few words", "Few  words", "other few words"]
    return [(i, t, None, None, len(t)) for i, t in enumerate(texts)]


def brute(made):
    sets, label = [shingles(t) for _, t, *_ in made], list(range(len(made)))
    alike = [(i, j) for i in range(len(made)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in alike:
        label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return alike, label


def test_similarity_against_brute_force(spark):
    made = rows()
    alike, label = brute(made)
    found = near.near_groups(spark.createDataFrame(made, SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == list(enumerate(label))
    prints = [simhash.fingerprint(t.encode()) for _, t, *_ in made]
    assert sum((prints[i] ^ prints[j]).bit_count() > 4 for i, j in alike) > 20  # op8's distance misses these


def test_stage_keeps_the_least_of_each_group(spark):
    made = rows()
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(made, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute(made)[1]))


@pytest.mark.parametrize(("a", "b", "want"), [(b"a b c d e", b"A  B c d e", 1.0), (b"", b"", 1.0), (b"", b"a", 0.0), (b"a b c d e f", b"a b c d e g", 1 / 3)])
def test_jaccard(a, b, want):
    assert near.jaccard(near.shingles(a), near.shingles(b)) == want


def test_ids_that_are_null_or_shared(spark):
    text = [" ".join(f"{x}{i}" for i in range(80)) for x in "abcdef"]
    made = [(None, text[0]), (None, text[1]), (None, text[2]), (5, text[2]), (7, text[3]), (7, text[4]), (8, text[4]), (9, text[5]), (9, text[5])]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in made], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, text[0]), (0, text[1]), (5, text[2]), (7, text[3]), (7, text[4]), (9, text[5])]
