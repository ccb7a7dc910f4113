import json

from pyspark.sql import functions as F

from wavemill.config import PROFILES, load_yaml
from wavemill.models import registry
from wavemill.operators import cascade, detect, fuse, gate, metrics, sampling, sets
from wavemill.plans import jobs
from wavemill.sources import manifests
from wavemill.streaming import manifests as streams


def test_fusion_of_constant_and_empty_columns(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    got = sorted(r["fused"] for r in fuse.zscore_fuse(d, ["a", "b"], (0.5, 0.5)).collect())
    assert abs(got[0] + 0.5) < 1e-6 and abs(got[1] - 0.5) < 1e-6
    assert fuse.zscore_fuse(d.limit(0), ["a", "b"], (0.5, 0.5)).count() == 0


def test_predicates(spark):
    d = spark.createDataFrame([(None,), ("",), ("null",), ("x",)], "l string")
    got = d.select(metrics.truthy(F.col("l")), metrics.present(F.col("l")), metrics.is_negative(F.col("l")), metrics.rejected(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [(False, False, True, True), (False, True, True, True), (True, True, True, True), (True, True, False, False)]


def test_gate_edges(spark):
    rows = [(False, 0.55, None, False), (False, 0.56, None, False), (True, 0.9, 0.3, False), (True, None, 0.29, True), (True, 0.1, 0.41, True), (True, 0.1, 0.39, True)]
    d = spark.createDataFrame(rows, "p boolean, s double, b double, t boolean")
    hits = [r[0] for r in d.select(gate.rule_hits(F.col("p"), F.col("s"), F.col("b"), F.col("t"))).collect()]
    assert hits == [[], ["G1_neg_high_sim"], [], ["G2_pos_low_sim"], ["G3_jump_artifact"], []]


def test_min_half_total_error(spark):
    d = spark.createDataFrame([(0.1, False), (0.2, False), (0.5, True), (0.3, True)], "s double, p boolean")
    assert tuple(metrics.min_half_total_error(d, "s", "p").first()) == (0.0, 0.205)


def test_choose_track_first_wins_under_cap(spark):
    d = spark.createDataFrame([(0.1, [0.3, 0.3, 0.9]), (0.5, [0.4]), (0.1, [])], "b double, s array<double>")
    got = [tuple(r[0]) for r in d.select(detect.choose_track(F.col("b"), F.col("s"), 0.25)).collect()]
    assert got == [(0, 0.3, True), (-1, 0.5, False), (-1, 0.1, False)]


def test_cascade_runs_costly_stage_on_the_rest_only(spark):
    seen = spark.sparkContext.accumulator(0)

    def costly(d):
        def count(parts):
            for p in parts:
                seen.add(len(p))
                yield p.assign(value="main", done=True)

        return d.mapInPandas(count, "id long, value string, done boolean")

    quick = lambda d: d.withColumn("value", F.lit("quick")).withColumn("done", F.col("id") % 2 == 0)
    got = cascade.cascade(spark.range(10), [("quick", quick), ("main", costly)]).collect()
    assert sorted((r["id"], r["stage"]) for r in got) == [(i, "quick" if i % 2 == 0 else "main") for i in range(10)] and seen.value == 5


def test_sampling_and_sets(spark):
    d = spark.createDataFrame([("pos", 0), ("neg", 0), ("neg", 1), ("neg", 2)], "split string, idx long")
    assert sampling.balanced(d, 4).count() == 4
    assert sampling.full_batches(spark.range(10), 4, ["id"]).count() == 8
    rows = [(g, k) for g, n in ((None, 3), ("a", 70), ("b", 1)) for k in range(n)]
    groups = {}
    for r in sampling.numbered_spread(spark.createDataFrame(rows + rows[5:7], "g string, k long"), "g", "k", buckets=8).collect():
        groups.setdefault(r["g"], []).append(r["rn"])
    assert {g: sorted(v) for g, v in groups.items()} == {None: [1, 2, 3], "a": list(range(1, 73)), "b": [1]}
    pairs = sets.pool_pairs(spark.range(20).withColumn("g", F.col("id") % 2), "g", "id", 2).collect()
    assert len(pairs) == 40 and all(r["pool_id"] != r["id"] and r["pool_id"] % 2 == r["g"] for r in pairs)


def test_manifest(spark, tmp_path):
    lines = [{"id": 7, "唤醒音频": "a.wav", "识别音频": "b.wav", "识别文本": None}, None, {"唤醒音频": "c.wav", "识别音频": "d.wav", "识别文本": "开"}]
    (tmp_path / "neg.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) if x else "" for x in lines))
    got = sorted(manifests.read_manifest(spark, str(tmp_path)).collect(), key=lambda r: r["idx"])
    assert [(r["idx"], r["id"], r["label"], r["ckpt_key"]) for r in got] == [(0, "7", None, "neg_0"), (2, "2", "开", "neg_2")]


def test_profiles_and_yaml(tmp_path):
    assert PROFILES["renoise_optimal"].separate is False and PROFILES["default"].weights == (0.4, 0.35, 0.25)
    bad = tmp_path / "c.yaml"
    bad.write_text("a: 1\na: 2\n")
    try:
        load_yaml(str(bad))
    except ValueError as e:
        assert "repeated key" in str(e)
    else:
        raise AssertionError


def test_score_dataset_end_to_end(spark):
    registry.register("recogniser", "twelve", registry.table_recogniser({12: "打开 空调 26度"}))
    up, down = [0.1 * (i + 1) for i in range(12)], [0.1 * (12 - i) * (-1) ** i for i in range(12)]
    rows = [("pos", 0, "a", "打开空调二十六度", up, up), ("neg", 0, "b", None, up, down)]
    d = spark.createDataFrame(rows, "split string, idx long, id string, label string, kws array<double>, cmd array<double>").withColumn("rate", F.lit(16000))
    got = {r["id"]: r for r in jobs.score_dataset(d, PROFILES["default"], main="twelve").collect()}
    assert got["a"]["is_target"] and got["a"]["content"] == "打开空调二十六度" and got["a"]["cer"] == 0
    assert not got["b"]["is_target"] and got["b"]["content"] == ""


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "1", "sim_abs": "0.7"}\n{"id": "2", "sim_abs": "0.2"}\n')
    s = streams.stream_processed(spark, str(tmp_path / "in"))
    work = lambda b: gate.tidy(b).withColumn("hits", gate.rule_hits(metrics.present(F.col("label")), F.col("sim"), F.col("best"), F.col("triggered"))).select("id", "hits")
    streams.run_batches(s, work, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["id"]: r["hits"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": ["G1_neg_high_sim"], "2": []}
