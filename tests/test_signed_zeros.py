"""Values that round to zero keep their sign, as in the SQL: rows equal DuckDB's bit by bit."""

import struct

import duckdb
import numpy as np
import pytest

from wavemill import queries as Q

NAMES = [
    "clip",
    "complex_mask",
    "crop_pad",
    "downmix",
    "mean_subtracted",
    "mix_at_snr",
    "peak_limit",
    "peak_norm",
    "resample_linear",
    "segment",
    "trim_silence",
]


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """Vectors of two loud values and others around 1e-7, of both signs."""
    folder = tmp_path_factory.mktemp("tiny")
    x = np.random.default_rng(3).normal(0, 1e-7, (6, 64))
    x[:, [3, 60]] = 0.5
    rows = [(i, row.tolist(), i % 2) for i, row in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def bits(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(bits, v))
    return struct.pack("<d", v) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_bits(spark, tiny, name):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tiny}/embeddings.parquet/*.parquet'")
    rel = duck.sql(Q.ORACLES[name])
    df = Q.QUERIES[name](spark, str(tiny)).select(*rel.columns)
    assert sorted(map(bits, df.collect())) == sorted(map(bits, rel.fetchall()))
