import corpus_pipeline
from wavemill.llm import jaccard

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns and after.count() <= before.count(), name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.count() == before.count()


def test_no_two_similar_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    again = jaccard.similar_classes(kept).collect()
    assert len({r["component_id"] for r in again}) == len(again) == len({r["component_id"] for r in jaccard.similar_classes(docs).collect()})
