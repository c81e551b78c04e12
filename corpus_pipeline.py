"""A pipeline over the documents table: language ID, quality rules, near-dedup by Jaccard similarity, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of documents. Rows that repeat (same id and text) are decided on alike; of each
group of near-duplicates one row stays in near-dedup. A null text is rejected by the first stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.llm import langid, near, packing, quality
from kvlog.llm.common import materialise, table

#: A language is rejected if its share of the scores' softmax is below this multiple of an even share.
LEAST_SHARE = 1.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised."""
    model = langid.train(docs)
    return langid.accepted(docs, model, langid.least_score(len(model[0]), LEAST_SHARE))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, matched by id and the text's hash."""
    kept = quality.rules(docs).filter("kept").select(F.col("doc_id").alias("own_id"), F.col("th").alias("own_th")).distinct()
    match = docs["doc_id"].eqNullSafe(kept["own_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["own_th"])
    return docs.join(kept.hint("merge"), match, "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id, of those that share it the
    one with the least hash of its text; one without an id only if its group has none with an id."""
    rows = near.near_groups(docs).groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "th", "n")).alias("m")
    # Joined by merging at every size: ids grow with the documents.
    kept = rows.groupBy("root").agg(least).select(F.col("m.doc_id").alias("own_id"), F.col("m.th").alias("own_th"), (F.col("m.n") > 1).alias("repeated"))
    kept = materialise(kept, "kept").hint("merge")
    same = docs["doc_id"].eqNullSafe(kept["own_id"]) & (near.text_hash() == kept["own_th"])
    once = docs.join(kept.filter("NOT repeated"), same, "left_semi")
    if kept.filter("repeated").isEmpty():
        return once
    again = docs.join(kept.filter("repeated"), same, "left_semi").withColumn("own_th", near.text_hash())
    return once.unionAll(again.dropDuplicates(["doc_id", "own_th"]).drop("own_th"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("quality", quality_rules), ("near_dedup", near_dedup), ("packing", pack)]
#: No SQL expresses language ID, fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
