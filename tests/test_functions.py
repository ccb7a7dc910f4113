import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill.functions import arrays as A
from wavemill.functions import digits, spectral
from wavemill.functions import text as X
from wavemill.sources import media


@pytest.mark.parametrize("given_text, spelt", [
    ("空调调到26度", "空调调到二十六度"), ("百分之30", "百分之三十"), ("风量30%", "风量百分之三十"), ("温度3.5", "温度三点五"), ("打开4G", "打开四G"),
    ("W25型号", "W25型号"), ("W25度", "W二十五度"), ("100", "一百"), ("10001", "一万一"), ("20010", "二万十"), ("100000000", "100000000"), ("007", "七"),
    ("1010", "一千零一十"), ("0", "零"), ("百分之100000000", "百分之百分之100000000"), ("", ""),
])
def test_digits(given_text, spelt):
    assert digits.verbalise(given_text) == spelt


def test_chained_text_rules():
    assert [digits.verbalise(X.normalise(s)) for s in ("30%", "3.5", "4G")] == ["三十", "三十五", "四g"]


@given(st.text(st.characters(categories=("Ll", "Lu", "Nd", "Po", "Zs"), max_codepoint=0x24F), max_size=30))
def test_normalise_is_idempotent(s):
    assert X.normalise(X.normalise(s)) == X.normalise(s)


def test_wakeword():
    assert X.wakeword("hello", "say hello there") == 1.0
    assert X.wakeword("", "x") == X.wakeword("x", None) == 0.0
    assert 0 < X.wakeword("hey you", "hay yu") < 1


def test_error_rates(spark):
    rows = [("", ""), ("", "a"), ("a", ""), ("abc", "abd"), ("a", "abcd")]
    d = spark.createDataFrame(rows, "r string, h string")
    assert [x[0] for x in d.select(X.error_rate(F.col("r"), F.col("h"))).collect()] == [0, 1, 1, pytest.approx(1 / 3), 3]


def test_arrays(spark):
    d = spark.createDataFrame([([0.0, 0.5, -0.25, 0.0],), ([0.0, 0.0],), ([],), (None,)], "x array<double>")
    got = d.select(A.trim_silence(F.col("x")).alias("t"), A.peak_normalise(F.col("x")).alias("p"), A.fit_length(F.col("x"), 3).alias("f")).collect()
    assert got[0]["t"] == [0.5, -0.25] and got[0]["p"] == [0, 1, -0.5, 0] and got[0]["f"] == [0, 0.5, -0.25]
    assert got[1]["t"] == got[1]["p"] == [0, 0] and got[2]["t"] == [] and got[3]["t"] is None


def test_resample_round_trip_length(spark):
    d = spark.createDataFrame([([float(i) for i in range(10)],)], "x array<double>")
    up = d.select(A.resample_linear(F.col("x"), 16000, 48000).alias("y")).first()["y"]
    assert len(up) == 30 and up[0] == 0 and up[-1] == 9


def test_spectral_gate_keeps_length_and_reconstructs():
    x = np.random.default_rng(42).normal(0, 0.1, 5000)
    assert np.allclose(spectral.istft(spectral.stft(x, 1024, 256), 1024, 256)[:5000], x, atol=1e-9)
    assert len(spectral.gate(x)) == 5000 and len(spectral.gate(x[:50], stationary=False)) == 50 and len(spectral.gate(x[:0])) == 0


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_decoding(width):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2), w.setsampwidth(width), w.setframerate(8000)
        half = {1: bytes([192, 192]), 2: (16384).to_bytes(2, "little") * 2, 3: (1 << 22).to_bytes(3, "little") * 2, 4: (1 << 30).to_bytes(4, "little") * 2}[width]
        w.writeframes(half * 4)
    x, rate = media.decode_wav(out.getvalue())
    assert rate == 8000 and np.allclose(x, 0.5)


def test_wav_round_trip():
    x, rate = media.decode_wav(media.encode_wav(np.array([0, 0.5, -2, 1.0]), 16000))
    assert rate == 16000 and np.allclose(x, [0, 0.5, -1, 1], atol=1e-4)
