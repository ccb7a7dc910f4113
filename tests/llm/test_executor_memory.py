"""The executors hand back the heap that a stage of the pipeline has filled before the next one."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_a_filled_heap_goes_back(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "let_go", lambda spark: None)  # on one machine the driver's would do for both
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    least = jvm.java.lang.Runtime.getRuntime().totalMemory()
    long = F.length(F.repeat(F.lit("x"), (F.col("id") + 200_000_000).cast("int")))
    assert spark.range(0, 8, 1, 4).select(F.sum(long)).first()[0] > 1_600_000_000
    filled = jvm.java.lang.Runtime.getRuntime().totalMemory()
    assert filled > least + (200 << 20)
    corpus_pipeline.rows_of(spark, docs)
    assert jvm.java.lang.Runtime.getRuntime().totalMemory() < filled - (200 << 20)


def test_each_stage_asks_the_executors_first(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "executors_let_go", calls.append)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        docs = stage(spark, docs, SF)
        assert calls == [spark] * n
