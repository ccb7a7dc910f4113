"""Runs that go on where they stopped, moments that merge, numbers in an order, records with absent and null keys."""

import json
import math
import random
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wavemill.config import PROFILES
from wavemill.models import registry
from wavemill.operators import fuse, gate, sampling, sets
from wavemill.plans import jobs
from wavemill.sources.batchlog import BatchLog, in_batches
from wavemill.sources import scratch


def test_log_reads_what_is_finished(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "run"))
    assert log.entries() == [] and log.read() is None
    log.append(spark.range(3))
    log.append(spark.range(0))
    log.append(spark.range(10, 12))
    (tmp_path / "run/data/half").mkdir()
    spark.range(99).write.parquet(str(tmp_path / "run/data/half/x"))  # written, never finished
    assert [(e["batch"], e["rows"]) for e in log.entries()] == [(0, 3), (1, 0), (2, 2)]
    assert sorted((r["id"], r["batch"]) for r in log.read().collect()) == [(0, 0), (1, 0), (2, 0), (10, 2), (11, 2)]
    with pytest.raises(FileExistsError):
        log.append(spark.range(1), 2)
    assert log.read().count() == 5


class Stop(Exception):
    pass


@pytest.mark.parametrize("again", [5, 3])
def test_an_ended_run_goes_on(spark, tmp_path, again):
    log, seen = BatchLog(spark, str(tmp_path)), []

    def work(d):
        ids = [r["id"] for r in d.collect()]
        if len(seen) == 2:
            raise Stop
        seen.append(ids)
        return d.withColumn("y", F.col("id") * 2)

    rows = spark.range(100)
    with pytest.raises(Stop):
        in_batches(rows, log, "id", 5, work)
    assert len(log.entries()) == 2
    first = [i for ids in seen for i in ids]
    more = []
    out = in_batches(rows, log, "id", again, lambda d: (more.extend(r["id"] for r in d.collect()), d.withColumn("y", F.col("id") * 2))[1])
    assert sorted(first + more) == list(range(100))  # each once, even if the parts are others now
    assert sorted((r["id"], r["y"]) for r in out.collect()) == [(i, 2 * i) for i in range(100)]
    assert in_batches(rows, log, "id", again, lambda d: pytest.fail("nothing is left")).count() == 100


def wave(k, n=64):
    return [((i * (k + 3)) % 17 - 8) / 8 for i in range(n)]


def test_scoring_goes_on(spark, tmp_path, monkeypatch):
    calls = str(tmp_path / "calls")

    def hears(x, rate, language):
        with open(calls, "a") as f:
            f.write(f"{len(x)}\n")
        return "打开空调"

    registry.register("recogniser", "batch_main", lambda: hears)
    rows = [("pos" if i % 3 else "neg", i, str(i), f"pos_{i}", "打开空调" if i % 3 else None, wave(i % 5, 40 + i), wave((i + i % 2) % 5, 40 + i)) for i in range(24)]
    d = spark.createDataFrame(rows, "split string, idx long, id string, ckpt_key string, label string, kws array<double>, cmd array<double>").withColumn("rate", F.lit(16000))
    p = replace(PROFILES["default"], denoiser="default", separate=False)
    columns = ["ckpt_key", "is_target", "content", "cer", "failed"]
    tell = lambda out: {r["ckpt_key"]: (round(r["fused"], 9), *(r[c] for c in columns)) for r in out.collect()}
    want = tell(jobs.score_dataset(d, p, main="batch_main"))
    assert {v[2] for v in want.values()} == {True, False}

    done, real = [], jobs.phase_one

    def ends(x, *rest):
        if len(done) == 1:
            raise Stop
        done.append(1)
        return real(x, *rest)

    folder = str(tmp_path / "run")
    monkeypatch.setattr(jobs, "phase_one", ends)
    with pytest.raises(Stop):
        jobs.score_in_batches(spark, d, folder, p, main="batch_main", batches=3)
    monkeypatch.setattr(jobs, "phase_one", real)
    kept = {r["ckpt_key"] for r in BatchLog(spark, f"{folder}/similarities").read().collect()}
    assert 0 < len(kept) < 24

    ran = []
    monkeypatch.setattr(jobs, "phase_one", lambda x, *rest: (ran.extend(r["ckpt_key"] for r in x.select("ckpt_key").collect()), real(x, *rest))[1])
    assert tell(jobs.score_in_batches(spark, d, folder, p, main="batch_main", batches=3)) == want
    assert set(ran) == {r[3] for r in rows} - kept and len(ran) == len(set(ran))
    # A third run has nothing to do; no model is asked again.
    open(calls, "w").close()
    assert tell(jobs.score_in_batches(spark, d, folder, p, main="batch_main", batches=3)) == want and open(calls).read() == ""


def test_moments_merge(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcd"), rng.choice([None, 1e9 + rng.random(), 1e9 + 5 * rng.random()]), rng.gauss(0, 3)) for _ in range(500)] + [("e", None, 1.0)]
    d = spark.createDataFrame(rows, "part string, x double, y double")
    parts = fuse.partial_moments(d, ["x", "y"], ["part"])
    got = fuse.as_statistics(fuse.merged_moments(parts), ["x", "y"]).first()
    for k, c in enumerate("xy", 1):
        v = [r[k] for r in rows if r[k] is not None]
        assert math.isclose(got[f"{c}_mean"], statistics.fmean(v), rel_tol=1e-12) and math.isclose(got[f"{c}_std"], statistics.pstdev(v), rel_tol=1e-6)
    # Merged step by step they are the same.
    steps = fuse.merged_moments(parts.where("part in ('a', 'b')")).withColumn("part", F.lit("ab")).unionByName(parts.where("part not in ('a', 'b')"))
    again = fuse.as_statistics(fuse.merged_moments(steps), ["x", "y"]).first()
    assert all(math.isclose(again[c], got[c], rel_tol=1e-6) for c in got.asDict())
    assert fuse.as_statistics(fuse.merged_moments(parts.limit(0)), ["x"]).first()["x_mean"] is None


def test_numbers_in_an_order(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1.5, 1.5, 1.5, 2.0, -1.0]), i) for i in range(400)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "a double, b long").repartition(7)
    got = sampling.numbered_in_order(d, [F.desc_nulls_last("a"), "b"], "rn", 1)
    assert got.where("rn is null").isEmpty()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r["a"], r["b"]) for r in sorted(got.collect(), key=lambda r: r["rn"])] == want and sorted(r["rn"] for r in got.collect()) == list(range(1, 401))
    assert sampling.numbered_in_order(d.limit(0), ["b"]).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_join_by_position(spark):
    a = spark.createDataFrame([(x,) for x in "dacb"], "x string").repartition(3)
    b = spark.createDataFrame([(k,) for k in (3, 1, 2)], "y long").repartition(2)
    got = sets.by_position(a, b, ["x"], [F.desc("y")])
    assert sorted((r["position"], r["x"], r["y"]) for r in got.collect()) == [(0, "a", 3), (1, "b", 2), (2, "c", 1)]


def test_last_rows_without_a_shuffle(spark):
    rows = [(i % 10, "x" if i % 3 else None) for i in range(90)] + [(9, "x")] * 20
    d = spark.createDataFrame(rows, "a int, b string").repartition(5)
    for n in (0, 1, 7, 25, 40, 500):
        got = [tuple(r) for r in sampling.last_n_split(d, n, [F.desc("a"), "b"]).collect()]
        want = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or ""))
        assert sorted(map(repr, got)) == sorted(map(repr, [(*r, k < n) for k, r in enumerate(want)]))


RECORDS = [
    {}, {"sim_abs": None, "sim_abs_weighted": 0.5}, {"sim_abs_weighted": "0.25"}, {"sim_abs": 1, "sim_abs_weighted": 2}, {"sim_abs": "abc", "sim_abs_weighted": 2}, {"sim_abs": True}, {"sim_abs": False},
    {"sim_abs": [1]}, {"sim_abs": {"a": 1}}, {"sim_abs": " -1.5e3 "}, {"sim_abs": "nan"}, {"sim_abs": "-inf"}, {"sim_abs": ""}, {"sim_abs": 12345678901234567890}, {"sim_abs": 0.1}, {"sim_abs": "1f"}, {"sim_abs": "."},
    {"sep_best_sim": None}, {"sep_best_sim": "0.75"}, {"sep_best_sim": 3}, {"sep_triggered": None, "cmd_separated": True}, {"cmd_separated": True}, {"cmd_separated": "YES"}, {"sep_triggered": "no", "cmd_separated": True},
    {"sep_triggered": 0}, {"sep_triggered": 2}, {"sep_triggered": 0.0}, {"sep_triggered": []}, {"sep_triggered": [0]}, {"sep_triggered": {}}, {"sep_triggered": {"a": 0}}, {"sep_triggered": "1"}, {"sep_triggered": ""},
    {"识别文本": None}, {"识别文本": ""}, {"识别文本": "x"}, {"识别文本": False},
]


def plain_record(r):
    def number(v):
        try:
            return None if v is None else float(v)
        except (TypeError, ValueError):
            return None

    flag = r.get("sep_triggered", r.get("cmd_separated", False))
    flag = flag.lower() in ("true", "1", "yes") if isinstance(flag, str) else bool(flag)
    return r.get("识别文本") is not None, number(r.get("sim_abs", r.get("sim_abs_weighted"))), number(r.get("sep_best_sim")), flag


def test_records_keep_absent_and_null_apart(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join([json.dumps(r | {"n": i}, ensure_ascii=False) for i, r in enumerate(RECORDS)] + ["", "  "]))
    d = gate.tidy_records(gate.read_records(spark, str(tmp_path / "r.jsonl"))).withColumn("n", F.variant_get("record", "$.n", "int"))
    got = {r["n"]: repr((r["positive"], r["sim"], r["best"], r["triggered"])) for r in d.collect()}
    assert got == {i: repr(plain_record(r)) for i, r in enumerate(RECORDS)}


def test_a_cluster_needs_a_shared_folder(spark):
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]", "k8s://x"):
        assert scratch.chosen_folder("hdfs://x/y", master) == "hdfs://x/y"
        with pytest.raises(ValueError):
            scratch.chosen_folder("", master)
    assert scratch.chosen_folder("", "local[4]")
    assert scratch.checkpoint_folder(spark) == scratch.checkpoint_folder(spark) and scratch.new_folder(spark, "a") != scratch.new_folder(spark, "a")
