"""The pipeline's stages, each over all that its predecessor kept."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, odd, small, tmp_path):
    docs = odd
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd.columns, name
            out.write.parquet(str(tmp_path / str(i)))
            docs = spark.read.parquet(str(tmp_path / str(i)))
            assert docs.count() <= odd.count()
    texts = [r["text"] or "" for r in docs.collect()]
    assert not any("hunter2hunter2" in t for t in texts) and any("[SECRET]" in t for t in texts)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_empty_input(spark, none, small):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0, name


def test_run(spark, small):
    packed = corpus_pipeline.run(spark, small).toPandas()
    assert len(packed) and (packed.groupby("sequence_id")["length"].sum() <= 2048).all()
