"""The pipeline's stages on a table with hard cases."""

import corpus_pipeline
from test_text_operators import SCHEMA, empty, got, rows, table  # noqa: F401

from kvlog.llm import near, quality


def test_stages(spark, table):  # noqa: F811
    docs = spark.read.parquet(f"{table}/documents.parquet")
    start, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = docs
        docs = stage(spark, before, table)
        assert docs.columns == columns and docs.count() <= before.count()
        if name == "language":
            assert before.count() - docs.count() >= 4 and docs.filter("text IS NULL").count() == 0
        if name == "quality":
            kept = {str((r.doc_id, r.th)) for r in quality.rules(before).filter("kept").collect()}
            assert {str((r.doc_id, r.th)) for r in docs.selectExpr("doc_id", "xxhash64(text) AS th").collect()} == kept
        if name == "near_dedup":
            groups = {r.component_id for r in near.near_groups(before).collect()}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(groups)
    assert 0 < docs.count() < start
    assert sorted({r.doc_id for r in corpus_pipeline.run(spark, table).collect()}) == sorted(r.doc_id for r in docs.collect())


def test_empty(spark, empty):  # noqa: F811
    assert corpus_pipeline.run(spark, empty).count() == 0
