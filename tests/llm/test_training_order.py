"""The pipeline's output lies in training order."""

import corpus_pipeline

from .cases import FOLDER


def test_output_is_in_training_order(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    mixed = corpus_pipeline.source_mixing(spark, docs, FOLDER).cache()
    rows = corpus_pipeline.token_output(spark, mixed, FOLDER).orderBy("start").collect()
    want = [r.doc_id for r in mixed.orderBy("training_position", "doc_id", "text").collect()]
    assert [r.doc_id for r in rows] == want
    assert want != sorted(want)
    ends = [r.start + r.n_tokens for r in rows]
    assert [r.start for r in rows] == [0, *ends[:-1]]
    mixed.unpersist()
