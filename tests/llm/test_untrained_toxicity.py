"""Without usable labels nothing is called toxic and the stage keeps every document."""

import pytest

import corpus_pipeline
from wavemill.llm import toxicity

TEXTS = [(1, "some words here"), (2, "other idiot words"), (3, ""), (4, None)]


def tables(spark, path, labels, texts=TEXTS):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("labels", [[], [(1000, 1, 1), (1001, 1, 0)], [(1, 1, None), (None, 1, 1)]])
def test_no_usable_label(spark, tmp_path, labels):
    sf = tables(spark, tmp_path, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()} == {1, 2, 3, 4}
    got = toxicity.op6_toxicity(spark, sf).collect()
    assert len(got) == 4 and all(r["predicted"] == 0 and r["score"] < 0.05 for r in got)


def test_all_labelled_rows_held_out(spark, tmp_path):
    held = [r["doc_id"] for r in spark.range(200).withColumnRenamed("id", "doc_id").where(toxicity.held_out()).collect()]
    sf = tables(spark, tmp_path, [(i, 1, k % 2) for k, i in enumerate(held)], [(i, f"text {i}") for i in held])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(held) > 10 and corpus_pipeline.drop_toxic(spark, docs, sf).count() == len(held)
