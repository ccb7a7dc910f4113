"""Plug-ins that fail, hang or end their process cost their row only; batches go to plug-ins whole."""

import os
import sys
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from wavemill.config import PROFILES
from wavemill.models import registry as R
from wavemill.plans import jobs

RATE = 16000
RAISES, HANGS, DIES = 5, 6, 7


def trouble(x):
    """By the length of the samples."""
    if len(x) == RAISES:
        raise ValueError("bad row")
    if len(x) == HANGS:
        while True:
            time.sleep(1)
    if len(x) == DIES:
        os._exit(3)


def checked(f):
    def model(x, *rest):
        trouble(x)
        return f(x, *rest)

    return lambda: model


@pytest.fixture(scope="module", autouse=True)
def models():
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    R.register("denoiser", "run_half", checked(lambda x, rate: x / 2))
    R.register("separator", "run_split", checked(lambda x, reference, rate: [x[:2], x[2:]]))
    R.register("extractor", "run_sums", checked(lambda x, rate: [x.sum(), len(x)]))
    R.register("recogniser", "run_length", checked(lambda x, rate, language: f"Länge {len(x)}!"))


def frame(spark, lengths):
    return spark.createDataFrame([(n, [float(n)] * n) for n in lengths], "n int, x array<double>").coalesce(1)


@pytest.mark.parametrize("seconds, bad", [(None, {RAISES}), (0.5, {RAISES, HANGS, DIES})])
def test_each_kind_loses_its_row_only(spark, seconds, bad):
    lengths = [n for n in (3, 4, 5, 6, 7, 8, 9) if seconds or n not in (HANGS, DIES)]
    d, x, rate = frame(spark, lengths), F.col("x"), F.lit(RATE)
    got = {r["n"]: r for r in d.select("n", R.denoise("run_half", x, rate, seconds).alias("y")).collect()}
    assert {n: r["y"] for n, r in got.items()} == {n: None if n in bad else [n / 2] * n for n in lengths}
    got = {r["n"]: r["y"] for r in d.select("n", R.separate("run_split", x, F.lit(None).cast("array<double>"), rate, seconds).alias("y")).collect()}
    assert got == {n: None if n in bad else [[float(n)] * 2, [float(n)] * (n - 2)] for n in lengths}
    got = {r["n"]: r["y"] for r in d.select("n", R.extract("run_sums", x, rate, seconds).alias("y")).collect()}
    assert got == {n: None if n in bad else [float(n * n), float(n)] for n in lengths}
    tracks = F.array(F.slice("x", 1, 2), x)
    got = {r["n"]: r["y"] for r in d.select("n", R.extract_tracks("run_sums", tracks, rate, seconds).alias("y")).collect()}
    assert got == {n: None if n in bad else [[2.0 * n, 2.0], [float(n * n), float(n)]] for n in lengths}
    got = {r["n"]: r["y"] for r in d.select("n", R.recognise("run_length", x, rate, F.lit("de"), seconds).alias("y")).collect()}
    assert got == {n: "" if n in bad else f"länge{n}" for n in lengths}


def children():
    me = os.getpid()
    out = []
    for p in filter(str.isdigit, os.listdir("/proc")):
        try:
            with open(f"/proc/{p}/stat") as f:
                if int(f.read().rpartition(")")[2].split()[1]) == me:
                    out.append(int(p))
        except OSError:
            pass
    return out


def test_nothing_is_left_running(spark):
    import threading

    @F.udf("struct<threads: int, children: array<int>>")
    def left(_):
        return threading.active_count(), children()

    def look():
        found = [r["l"] for r in spark.range(8).select(left("id").alias("l")).collect()]
        return max(r["threads"] for r in found), {c for r in found for c in r["children"]}

    threads, before = look()
    d = frame(spark, [HANGS] * 3).select("n", R.separate("run_split", F.col("x"), F.lit(None).cast("array<double>"), F.lit(RATE), 0.3).alias("y"))
    assert [r["y"] for r in d.collect()] == [None] * 3
    again, after = look()
    assert again <= threads and after <= before


def test_batches_go_whole_and_in_one_pass(spark, tmp_path):
    calls = str(tmp_path / "calls")

    class Many:
        def __init__(self, k):
            self.k = k

        def __call__(self, x, rate):
            raise AssertionError("one row")

        def many(self, rows):
            with open(calls, "a") as f:
                f.write(f"{self.k} {len(rows)}\n")
            return [[float(self.k), *map(float, x[:1])] for x, _ in rows]

    for k in range(3):
        R.register("extractor", f"run_many{k}", lambda k=k: Many(k))
    d = frame(spark, [1, 2, 3, 4]).withColumn("rate", F.lit(RATE)).withColumn("z", F.when(F.col("n") > 1, F.col("x")))
    v = d.withColumn("v", R.ensemble(["run_many0", "run_many1", "run_many2"], F.col("rate"), F.col("x"), F.col("z")))
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    for r in v.collect():
        assert [r["v"]["c0"][f"m{k}"] for k in range(3)] == [[float(k), float(r["n"])] for k in range(3)]
        assert [r["v"]["c1"][f"m{k}"] for k in range(3)] == [[float(k), float(r["n"])] if r["n"] > 1 else None for k in range(3)]
    assert sorted(open(calls).read().split("\n")) == ["", *sorted(f"{k} {n}" for k in range(3) for n in (3, 4))]
    sims = jobs.similarities(d.withColumn("kws", F.col("x")).withColumn("cmd", F.col("x")), "kws", "cmd")
    assert sims._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_a_failing_batch_is_done_row_by_row(spark):
    class Touchy:
        def __call__(self, x, rate):
            trouble(x)
            return [float(len(x))]

        def many(self, rows):
            return [self(*r) for r in rows]

    R.register("extractor", "run_touchy", Touchy)
    got = {r["n"]: r["y"] for r in frame(spark, [3, 5, 6, 8]).select("n", R.extract("run_touchy", F.col("x"), F.lit(RATE), 0.4).alias("y")).collect()}
    assert got == {3: [3.0], 5: None, 6: None, 8: [8.0]}


def test_a_new_registration_counts_in_old_workers(spark):
    for k in (1.0, 2.0):
        R.register("extractor", "run_again", lambda k=k: lambda x, rate: [k])
        assert {tuple(r["y"]) for r in frame(spark, [1, 2]).select(R.extract("run_again", F.col("x"), F.lit(RATE)).alias("y")).collect()} == {(k,)}


def test_scoring_with_models_that_hang(spark):
    """One clip on which the denoiser hangs, one on which the extractor raises: both fail, the others are scored."""
    R.register("denoiser", "run_slow", lambda: lambda x, rate: time.sleep(60) if len(x) == 40 else x)
    R.register("extractor", "run_weak", lambda: lambda x, rate: 1 / 0 if len(x) == 41 else np.abs(np.fft.rfft(x, 64))[:32])
    R.register("recogniser", "run_said", lambda: lambda x, rate, language: "打开")
    wave = lambda n: [((i * 5) % 17 - 8) / 8 for i in range(n)]
    rows = [("pos", i, str(i), "打开", wave(n + (n == 40)), wave(n)) for i, n in enumerate((42, 40, 41, 43))]
    d = spark.createDataFrame(rows, "split string, idx long, id string, label string, kws array<double>, cmd array<double>").withColumn("rate", F.lit(RATE))
    p = replace(PROFILES["default"], denoiser="run_slow", model_seconds=1.0, separate=False)
    got = {r["id"]: r for r in jobs.score_dataset(d, p, main="run_said", extractors=("run_weak",) * 3).collect()}
    assert {k: (r["failed"], r["cer"]) for k, r in got.items() if r["failed"]} == {"1": (True, 1.0), "2": (True, 1.0)}
    assert not got["0"]["failed"] and not got["3"]["failed"]
