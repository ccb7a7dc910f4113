"""Sources, sinks, streams and numeric functions that have no query, on files and against direct formulas."""

import io
import json
import tarfile
import zipfile

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wavemill.functions import spectral
from wavemill.functions import text as X
from wavemill.operators import sampling, sets
from wavemill.sources import manifests, media, sinks
from wavemill.streaming import manifests as streams


def test_submission_and_back(spark, tmp_path):
    rows = [(1, 0, "c", "", None, None), (0, 1, "b", "y", "y", 0.0), (0, 0, "a", "x", "xz", 0.5)]
    d = spark.createDataFrame(rows, "split_order int, idx long, id string, content string, label string, cer double")
    one = sinks.submission(d, 0.25, 1.5)
    doc = json.loads(one.first()["value"])["result"]
    assert [list(r.values()) for r in doc["results"]] == [["a", "x", "xz", "0.5000"], ["b", "y", "y", "0.0000"], ["c", "", "", ""]] and (doc["final_cer"], doc["duration"]) == ("0.2500", "1.50")
    sinks.write_text(one.coalesce(1), str(tmp_path / "s"))
    got = manifests.read_results(spark, str(tmp_path / "s")).orderBy("id").collect()
    assert [(r["id"], r["content"], r["cer"]) for r in got] == [("a", "x", "0.5000"), ("b", "y", "0.0000"), ("c", "", "")]
    other = json.loads(sinks.alternative_submission(d, 0.25, 0.75, 1.5).first()["value"])
    assert len(other["results"]) == 3 and other["summary"] == {"avg_cer": "0.2500", "avg_rr": "0.7500", "duration": 1500}
    (tmp_path / "b.json").write_text('{"result": {"results": [{"id": 1, "label": true}, {"id": 2, "label": "x"}]}}')
    assert sorted((r["id"], r["label"]) for r in manifests.read_results(spark, str(tmp_path / "b.json")).collect()) == [("1", "true"), ("2", "x")]


def test_reports(spark, tmp_path):
    sinks.write_distribution(spark.createDataFrame([("a", 0.12345, None), ("b", None, "x")], "id string, sim double, note string").coalesce(1), str(tmp_path / "csv"))
    data = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert data.startswith(b"\xef\xbb\xbfid,sim,note") and b"a,0.1235," in data or b"a,0.1234," in data
    sinks.write_json(spark.createDataFrame([("all", 3, None)], "language string, total long, rate double"), str(tmp_path / "json"))
    assert [json.loads(x) for p in (tmp_path / "json").glob("part-*") for x in p.read_text().splitlines()] == [{"language": "all", "total": 3, "rate": None}]
    counts, shown = spark.createDataFrame([("r", 2)], "rule string, n long"), spark.createDataFrame([("r", 1, "a", 0.5, None), ("r", 2, "b", 0.7, 0.1)], "rule string, rn int, id string, sim double, best double")
    coverage = spark.createDataFrame([(5, 4, 1)], "total long, has_gate_fields long, missing_gate_fields long")
    doc = json.loads(sinks.gate_report(counts, shown, coverage, {"jump_cap": 0.3}).first()["value"])
    assert doc["config"] == {"jump_cap": 0.3} and doc["rule_hits"] == {"r": 2} and [e["id"] for e in doc["detail"]["r"]] == ["a", "b"] and doc["total"] == 5


def test_jsonl_keeps_nulls_and_keys(spark, tmp_path):
    d = spark.createDataFrame([("1", "a.wav", None)], "id string, kws_path string, label string")
    sinks.write_jsonl(d, str(tmp_path / "m"), manifest_keys=True)
    lines = [json.loads(x) for p in (tmp_path / "m").glob("part-*") for x in p.read_text().splitlines()]
    assert lines == [{"id": "1", "唤醒音频": "a.wav", "识别文本": None}]
    assert [(r["kws_path"], r["label"]) for r in manifests.read_processed(spark, str(tmp_path / "m")).collect()] == [("a.wav", None)]
    assert [tuple(r) for r in manifests.read_pairs(spark, str(tmp_path / "m")).collect()] == [("a.wav", None, 0)]


def test_test_manifest_and_paths(spark, tmp_path):
    (tmp_path / "test.jsonl").write_text('{"唤醒音频": "a\\\\b.wav"}\n\n{"id": 9}\n', encoding="utf-8")
    got = sorted(manifests.read_test_manifest(spark, str(tmp_path / "test.jsonl")).collect(), key=lambda r: r["idx"])
    assert [(r["idx"], r["id"], r["base"]) for r in got] == [(0, "0", str(tmp_path)), (2, "9", str(tmp_path))]
    d = spark.createDataFrame([("a\\b/../c.wav",), ("/x/./y",), ("C:\\d\\e",), (None,)], "p string")
    assert [r["p"] for r in sinks.absolute_paths(d, "/root/", ["p"]).collect()][:3] == ["/root/a/c.wav", "/x/y", "C:/d/e"]


def test_checkpoint(spark, tmp_path):
    path = str(tmp_path / "ck")
    assert manifests.read_checkpoint(spark, path) is None
    rows = spark.createDataFrame([("pos_0", "1", "x", None, 0.5, None), (None, "2", "y", None, 0.5, None)], "ckpt_key string, id string, content string, label string, cer double, similarity double")
    sinks.append_checkpoint(rows, path)
    done = manifests.read_checkpoint(spark, path)
    assert {r["ckpt_key"] for r in done.collect()} == {"pos_0", "2"}
    left = sets.resume(spark.createDataFrame([("pos_0",), ("neg_0",)], "ckpt_key string"), done)
    assert [r[0] for r in left.collect()] == ["neg_0"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet at all, but long enough")
    assert manifests.read_checkpoint(spark, str(tmp_path / "bad")) is None


def test_cached_and_checked(spark, tmp_path):
    calls = []
    compute = lambda: calls.append(1) or spark.range(3)
    assert [manifests.cached(spark, str(tmp_path / "c"), compute).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    import hashlib

    d = spark.createDataFrame([(bytearray(b"abc"), 3), (bytearray(b"abc"), 4), (bytearray(b"abd"), 3)], "c binary, n long")
    good = F.lit(hashlib.sha256(b"abc").hexdigest().upper())
    assert [r[0] for r in d.select(media.checked(F.col("c"), F.col("n"), good)).collect()] == [True, False, False]


def test_waves_and_archives(spark, tmp_path):
    d = spark.createDataFrame([("a.wav", [0.5, -0.5] * 800), ("b.wav", [0.25] * 400)], "name string, samples array<double>")
    media.write_wavs(d, str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    assert sorted((r["name"], round(r["s"], 6)) for r in packed.select("name", media.wav_duration(F.col("content")).alias("s")).collect()) == [("a.wav", 0.1), ("b.wav", 0.025)]
    assert media.unpack(packed, str(tmp_path / "waves")) == 2
    (tmp_path / "waves" / "bad.wav").write_bytes(b"RIFFnothing")
    got = {r["path"].rsplit("/", 1)[1]: r for r in media.read_wavs(spark, str(tmp_path / "waves"), 8000).collect()}
    assert len(got["a.wav"]["samples"]) == 800 and got["b.wav"]["error"] is None and got["bad.wav"]["samples"] is None and got["bad.wav"]["error"]
    cut = media.segment_table(media.read_wavs(spark, str(tmp_path / "waves")), 0.03, 16000, 0.05)
    assert sorted((r["segment"], len(r["samples"])) for r in cut.collect()) == [(0, 480), (1, 480), (2, 480)]
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "z.zip", "w") as z:
        z.writestr("d/x.txt", "one")
    with tarfile.open(tmp_path / "in" / "t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("y.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"two"))
    assert sorted((r["member"], bytes(r["content"])) for r in media.read_archives(spark, str(tmp_path / "in")).collect()) == [("d/x.txt", b"one"), ("y.txt", b"two")]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"a": 1.0, "at": "2024-01-01T00:01:00", "k": "x"}\n{"a": 3.0, "at": "2024-01-01T00:04:59", "k": "x"}\n{"a": 2.0, "at": "2024-01-01T00:05:00", "k": "x"}\n')
    raw = spark.readStream.schema("a double, at timestamp, k string").json(str(tmp_path / "in"))
    stats = spark.createDataFrame([(2.0, 1.0)], "a_mean double, a_std double")

    def run(stream, name, mode):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name).collect()

    got = run(streams.score_stream(raw, ["a"], (1.0,), stats, 0.5), "scored", "append")
    assert sorted((r["a"], r["is_target"]) for r in got) == [(1.0, False), (2.0, False), (3.0, True)]
    got = run(streams.windowed_counts(raw, "at", "k"), "counted", "update")
    assert sorted(r["n"] for r in got) == [1, 2]


def hashed(*values, seed=42):
    for v, size in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_hash_choices(spark):
    ids = list(range(200))
    order = sorted(ids, key=lambda i: (hashed((i, 8), (0, 4)), i))
    assert {r["id"] for r in sampling.hashed_sample(spark.range(200), 64, ["id"]).collect()} == set(order[:64])
    assert {r["id"]: r["f"] for r in spark.range(200).select("id", sampling.folds("id").alias("f")).collect()} == {i: hashed((i, 8)) % 5 for i in ids}
    pool = spark.range(7).select(F.col("id").alias("n"), (F.col("id") * 10).alias("noise"))
    got = sampling.hashed_partner(spark.range(200), pool, "id", "n", 7, seed=3).collect()
    assert {r["id"]: r["noise"] for r in got} == {i: hashed((i, 8), (3, 4)) % 7 * 10 for i in ids}


def slow_stft(x, n, hop):
    x = [0.0] * (n // 2) + list(x) + [0.0] * (n // 2)
    x += [0.0] * (-(len(x) - n) % hop)
    w = [0.5 - 0.5 * np.cos(2 * np.pi * i / n) for i in range(n)]
    return np.array([[sum(x[s + i] * w[i] * np.exp(-2j * np.pi * k * i / n) for i in range(n)) / sum(w) for s in range(0, len(x) - n + 1, hop)] for k in range(n // 2 + 1)])


@pytest.mark.parametrize("stationary", [True, False])
def test_spectral_gate_values(stationary):
    x = np.random.default_rng(3).normal(0, 0.1, 40)
    x[10:20] += 0.8
    z = slow_stft(x, 40, 10)
    assert np.allclose(z, spectral.stft(x, 40, 10))
    bins, frames = z.shape
    db = [[20 * np.log10(abs(z[k, t]) + 1e-10) for t in range(frames)] for k in range(bins)]
    gain = np.ones((bins, frames))
    for k in range(bins):
        floor, spread = (np.mean(abs(z[k])), np.std(db[k])) if stationary else (np.percentile(abs(z[k]), 15), 6.0)
        for t in range(frames):
            under = db[k][t] - 20 * np.log10(floor + 1e-10) - 1.5 * spread
            gain[k, t] = 1 if under >= 0 else 10 ** (0.8 * under / 20)
    at = lambda k, t: gain[min(max(k, 0), bins - 1), min(max(t, 0), frames - 1)]
    smooth = np.array([[sum(at(k + a, t + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9 for t in range(frames)] for k in range(bins)])
    want = spectral.istft(z * smooth, 40, 10)[:40]
    assert np.allclose(spectral.gate(x, stationary=stationary), want, atol=1e-6)


@pytest.mark.parametrize("rates", [(16000, 24000), (48000, 16000), (8000, 44100)])
def test_polyphase_values(rates):
    x = np.random.default_rng(4).normal(0, 1, 50)
    k = np.gcd(*rates)
    up, down = rates[1] // k, rates[0] // k
    half = 10 * max(up, down)
    taps = np.array([np.sinc(i / max(up, down)) for i in range(-half, half + 1)]) * np.kaiser(2 * half + 1, 5)
    taps *= up / taps.sum()
    n = -(-len(x) * up // down)
    want = [sum(x[j] * taps[m * down - j * up + half] for j in range(len(x)) if 0 <= m * down - j * up + half < len(taps)) for m in range(n)]
    assert np.allclose(spectral.resample_poly(x, *rates), want, atol=1e-9)


def test_mel_bands_and_masks(spark):
    x = np.sin(2 * np.pi * 1000 * np.arange(800) / 16000)
    d = spark.createDataFrame([(x.tolist(),), ([0.0] * 10,), (None,)], "x array<double>")
    got = [r[0] for r in d.select(spectral.log_mel(F.col("x"), bins=40)).collect()]
    assert len(got[0]) == 3 and got[1] == [] and got[2] is None
    centres = 700 * np.expm1(np.linspace(1127 * np.log1p(20 / 700), 1127 * np.log1p(8000 / 700), 42)[1:-1] / 1127)
    assert abs(centres[int(np.argmax(got[0][1]))] - 1000) < 60
    frame = np.random.default_rng(5).uniform(0, 1, 257)
    rows = spectral.erb_matrix(65, 64)
    f = spark.createDataFrame([(frame.tolist(),)], "f array<double>").select(spectral.erb_bands(F.col("f"), 65, 64).alias("b")).select("b", spectral.erb_split(F.col("b"), 65, 64).alias("s")).first()
    bands = np.concatenate([frame[:65], rows @ frame[65:]])
    assert np.allclose(f["b"], bands) and np.allclose(f["s"], np.concatenate([bands[:65], bands[65:] @ rows])) and len(f["s"]) == 257
    a, b = spectral.complex_mask(np.array([1.0]), np.array([2.0]), np.array([3.0]), np.array([-1.0]))
    assert (a[0], b[0]) == (5.0, 5.0)


def test_mixing_matches_the_plain_version(spark):
    rng = np.random.default_rng(6)
    rows = [(rng.uniform(-1, 1, n).tolist(), rng.uniform(-1, 1, m).tolist(), s, k) for n, m, s, k in ((20, 7, 0.0, 3), (20, 20, 10.0, 9), (10, 35, -5.0, 30), (5, 9, 20.0, 2))]
    d = spark.createDataFrame(rows, "c array<double>, n array<double>, s double, k long")
    for r, (c, n, s, k) in zip(d.select(spectral.mix_at_snr(F.col("c"), F.col("n"), F.col("s"), F.col("k"))).collect(), rows):
        assert np.allclose(r[0], spectral.mix(np.array(c), np.array(n), s, k % max(1, len(n) - len(c) + 1)), atol=1e-6)
    odd = spark.createDataFrame([([], [1.0]), ([1.0], []), (None, [1.0])], "c array<double>, n array<double>")
    assert [r[0] for r in odd.select(spectral.mix_at_snr(F.col("c"), F.col("n"), F.lit(0.0), F.lit(0))).collect()] == [[], None, None]


def test_wake_words_by_sound(spark):
    sounds = {"你": "ni", "好": "hao", "号": "hao", "妮": "ni"}.get
    look = lambda c: sounds(c, c)
    d = spark.createDataFrame([("你好", "妮号"), ("Hey You", "x"), (None, "")], "k string, h string")
    got = d.select(X.wakeword_similarity("k", "h").alias("plain"), X.wakeword_similarity("k", "h", look).alias("sound"), X.phonetic_key("k", look).alias("key")).collect()
    assert [tuple(r) for r in got] == [(0.0, 1.0, "nihao"), (0.0, 0.0, "heyyou"), (0.0, 0.0, None)]


def test_small_text_functions(spark):
    d = spark.createDataFrame([("<|zh|><|SPEECH|> 打开 <a|b>", "abcd", "bcde", 0.00005), (None, "", None, None)], "r string, a string, b string, v double")
    got = d.select(X.rich_text(F.col("r")).alias("r"), X.sequence_ratio("a", "b").alias("q"), X.four_places(F.col("v")).alias("v"), X.preferred_text(F.lit(""), F.col("a")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("打开 <a|b>", 0.75, "0.0001", "abcd"), (None, 1.0, "", "")]
