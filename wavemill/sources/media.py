"""WAV decoding and encoding, archives and segments.

8-bit WAV is read as unsigned and 24-bit as three bytes, as the format says.
A file that cannot be decoded gives a row with ``error`` and null samples.
"""

from __future__ import annotations

import io
import tarfile
import wave
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and the rate."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) - 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float64)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    return (x / 2 ** (8 * width - 1)).reshape(-1, channels).mean(1), rate


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono: clipped, times 32767, cut to whole numbers."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, np.float64), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def resampled(x: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    n = len(x) * rate_out // rate_in
    return x if rate_in == rate_out else np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x) if n and len(x) else x[:0]


def wav_duration(content: Column) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        def one(data):
            with wave.open(io.BytesIO(data)) as w:
                return w.getnframes() / w.getframerate()

        return s.map(one, na_action="ignore").astype("float64")

    return run(content)


def read_wavs(spark: SparkSession, path: str, rate: int = 16_000, pattern: str = "*.wav") -> DataFrame:
    """``path, sample_rate, samples, error``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for p, c in zip(rows["path"], rows["content"]):
                try:
                    x, own = decode_wav(bytes(c))
                    out.append((p, rate, resampled(x, own, rate).astype(np.float32), None))
                except Exception as e:  # one bad file must not end the job
                    out.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "sample_rate", "samples", "error"])

    return files.mapInPandas(run, "path string, sample_rate int, samples array<float>, error string")


def encoded(samples: Column, rate: int) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: encode_wav(v, rate), na_action="ignore")

    return run(samples)


def write_wavs(df: DataFrame, folder: str, name: str = "name", samples: str = "samples", rate: int = 16_000) -> None:
    """One WAV file per row in a folder that all executors reach, through Spark's own file system access.

    Files are written as a table of names and contents, so that a lost task
    leaves no half file; ``unpack`` turns them into files where wanted.
    """
    df.select(F.col(name).alias("name"), encoded(F.col(samples), rate).alias("content")).write.mode("overwrite").parquet(folder)


def unpack(df: DataFrame, local_folder: str) -> int:
    """Write ``name, content`` rows as files on the driver, one at a time."""
    import os

    n = 0
    for r in df.toLocalIterator():
        target = os.path.join(local_folder, r["name"])
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        with open(target, "wb") as f:
            f.write(r["content"])
        n += 1
    return n


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``archive, member, content`` of tar, tar.gz and zip files, one archive per task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for p, c in zip(rows["path"], rows["content"]):
                data = io.BytesIO(bytes(c))
                if zipfile.is_zipfile(data):
                    with zipfile.ZipFile(data) as z:
                        for m in z.infolist():
                            if not m.is_dir():
                                yield pd.DataFrame({"archive": [p], "member": [m.filename], "content": [z.read(m)]})
                else:
                    data.seek(0)
                    with tarfile.open(fileobj=data) as t:
                        for m in t:
                            if m.isfile():
                                yield pd.DataFrame({"archive": [p], "member": [m.name], "content": [t.extractfile(m).read()]})

    return files.mapInPandas(run, "archive string, member string, content binary")


def segment_table(waves: DataFrame, seconds: float = 3.0, rate: int = 48_000, least_seconds: float = 2.0) -> DataFrame:
    """``path, segment, samples``: fixed slices of waves of at least ``least_seconds``."""
    from ..functions.arrays import doubles, segments

    cut = segments(doubles("samples"), int(seconds * rate), int(least_seconds * rate))
    return waves.select("path", F.posexplode(cut).alias("segment", "samples"))


def checked(content: Column, size: Column, sha256: Column) -> Column:
    """Whether a downloaded file has the size and digest it should have."""
    return (F.octet_length(content) == size) & (F.sha2(content, 256) == F.lower(sha256))
