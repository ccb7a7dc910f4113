"""Recordings in chunks against the same work on whole arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill import queries as Q
from wavemill.functions import spectral
from wavemill.operators import recordings


def waves(rng, lengths):
    out = []
    for k, n in enumerate(lengths):
        t = np.arange(n)
        x = 0.3 * np.sin(t * (0.05 + 0.01 * k)) * (np.sin(t * 0.002) > 0) + 0.02 * rng.standard_normal(n)
        out.append((f"r{k}", x.tolist()))
    return out


def test_gate_over_chunks_is_the_gate_on_the_whole(spark):
    rows = waves(np.random.default_rng(2), [0, 3, 4, 100, 127, 128, 129, 255, 256, 257, 700, 1000, 1023, 1280, 5000])
    d = spark.createDataFrame(rows, "path string, samples array<double>")
    for size, n in ((256, 128), (300, 128), (4096, 64)):
        chunks = recordings.chunked(d, size).repartition(5)
        got = {r["path"]: r["samples"] for r in recordings.whole(recordings.gate(chunks, size, n=n)).collect()}
        assert set(got) == {p for p, _ in rows}
        for path, x in rows:
            want = spectral.gate(np.array(x), n=n)
            assert len(got[path]) == len(x)
            assert np.allclose(got[path], want, rtol=0, atol=2e-7), (path, size, n)


def test_gate_leaves_out_nulls_and_keeps_keys(spark):
    x = waves(np.random.default_rng(3), [600])[0][1]
    d = spark.createDataFrame([(7, 0, x[:256], 1.0), (7, 1, x[256:512], 1.0), (7, 2, x[512:], 1.0), (8, 0, None, 1.0), (None, 0, x[:256], 1.0), (9, None, x[:5], 1.0)], "path long, chunk int, samples array<double>, total double")
    got = recordings.gate(d, 256, n=128)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "array<float>"]
    rows = got.collect()
    assert {r["path"] for r in rows} == {7} and np.allclose(np.concatenate([r["samples"] for r in sorted(rows, key=lambda r: r["chunk"])]), spectral.gate(np.array(x), n=128), atol=2e-7)
    assert recordings.gate(d.limit(0), 256, n=128).count() == 0
    with pytest.raises(ValueError):
        recordings.gate(d, 255, n=128)


def test_frames_across_borders(spark):
    rng = random.Random(5)
    rows = [(f"r{k}", [rng.random() for _ in range(n)]) for k, n in enumerate((0, 1, 9, 10, 11, 39, 40, 41, 95))]
    d = spark.createDataFrame(rows, "path string, samples array<double>")
    for size, n, hop in ((10, 10, 3), (10, 4, 7), (20, 21, 5), (100, 8, 8), (10, 2, 25)):
        got = {(r["path"], r["frame"]): r["samples"] for r in recordings.frames(recordings.chunked(d, size).repartition(4), size, n, hop).collect()}
        assert got == {(p, f): x[f * hop : f * hop + n] for p, x in rows for f in range((len(x) - n) // hop + 1) if len(x) >= n}, (size, n, hop)


def test_query_is_the_gate_on_one_array(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r["vec_id"] for r in rows] == list(range(len(rows)))
    want = spectral.gate(np.concatenate([np.array(r["embedding"], float) for r in rows]), n=32)
    got = Q.QUERIES["recording_gate"](spark, sf).orderBy("chunk").collect()
    assert np.allclose(np.concatenate([r["samples"] for r in got]), want, rtol=0, atol=2e-7)
