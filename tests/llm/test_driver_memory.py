"""The driver hands back the memory outside its heap that it has freed, in near duplicates and before each stage of the pipeline."""

import os

import corpus_pipeline
import pytest

from wavemill.llm import common

SF = "/root/testdata/sf0.001"


def test_freed_memory_goes_back(spark):
    jvm = spark.sparkContext._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status"
    if not os.path.exists(status) or not common.hand_back(spark):
        pytest.skip("this JVM has no such command")

    def resident():
        return next(int(x.split()[1]) for x in open(status) if x.startswith("VmRSS")) >> 10

    common.let_go(spark)
    made = [jvm.java.util.zip.Deflater() for _ in range(500)]  # each takes some 200 kB outside the heap
    for d in made[:-1]:  # the last keeps the C library from giving the end back by itself
        d.end()
    jvm.System.gc()
    before = resident()
    common.let_go(spark)
    assert resident() < before - 30
    made[-1].end()


def test_each_stage_lets_go_first(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "let_go", calls.append)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        docs = stage(spark, docs, SF)
        assert calls == [spark] * n
