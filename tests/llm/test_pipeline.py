import corpus_pipeline
from pyspark.sql import functions as F

from fixtures import odd_documents


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.schema == docs.schema and out.join(docs, "doc_id", "left_anti").count() == 0
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    assert docs.where(F.col("text").contains("AKIA")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == counts[-1] and last.where("not exact or n_tokens != size(ids)").count() == 0


def test_run_equals_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).where("exact").count() > 100


def test_stages_take_odd_documents(spark, sf_dir):
    docs = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        assert stage(spark, docs, sf_dir).count() >= 1
    assert corpus_pipeline.without_near_copies(spark, docs, sf_dir).where("doc_id = 6").count() == 0
