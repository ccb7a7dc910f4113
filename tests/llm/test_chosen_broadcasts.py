"""Near duplicates broadcast what they ask for only: each broadcast stays in the driver's heap for a while."""

import pytest

from wavemill.llm import jaccard

SF = "/root/testdata/sf0.001"
SETTING = "spark.sql.autoBroadcastJoinThreshold"


def test_no_other_broadcasts(spark, monkeypatch):
    before, plain, seen = spark.conf.get(SETTING), jaccard.checkpointed, []

    def look(df):
        out, run = plain(df), df._jdf.queryExecution()
        seen.append(("strategy=broadcast" in run.analyzed().toString(), "BroadcastHashJoin" in run.executedPlan().toString()))
        return out

    monkeypatch.setattr(jaccard, "checkpointed", look)
    jaccard.similar_classes(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(seen) > 10 and any(made for _, made in seen)
    assert not [1 for asked, made in seen if made and not asked]
    assert spark.conf.get(SETTING) == before


def test_setting_comes_back_after_an_error(spark):
    before = spark.conf.get(SETTING)
    with pytest.raises(Exception):
        jaccard.similar_classes(spark.range(3))
    assert spark.conf.get(SETTING) == before


def test_garbage_is_collected_between_steps(spark, monkeypatch):
    """Says just that it is asked for; what it frees shows in a driver whose heap is small."""
    calls = []
    monkeypatch.setattr(jaccard, "let_go", calls.append)
    jaccard.similar_classes(spark.read.parquet(f"{SF}/documents.parquet"))
    assert len(calls) >= 5 and set(calls) == {spark}
