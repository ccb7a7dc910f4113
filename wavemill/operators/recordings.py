"""Recordings that are too long for one row: chunks with a key, a number and samples.

All chunks of a recording but the last have the same size.  What reaches over
the border of a chunk is worked on with halos, the neighbours' samples on either
side, so that no task holds a recording.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import spectral
from ..sources import scratch
from . import fuse, sets


def chunked(waves: DataFrame, size: int, key: str = "path", samples: str = "samples") -> DataFrame:
    """``key, chunk, samples`` of waves that are whole; an empty one has one empty chunk."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(samples) - 1, F.lit(0)), F.lit(size))
    return waves.select(key, samples, F.posexplode(starts).alias("chunk", "_at")).select(key, F.col("chunk").cast("long").alias("chunk"), F.slice(samples, F.col("_at") + 1, size).alias("samples"))


def with_halos(chunks: DataFrame, left: int, right: int, key: str = "path") -> DataFrame:
    """Adds ``before`` and ``after``: up to ``left`` and ``right`` samples of the chunks beside, by joins on key and number.

    A chunk has at least as many samples as a halo, unless it is the last.
    """
    none = F.array().cast("array<double>")
    part = lambda step, name, cut: chunks.select(key, (F.col("chunk") + step).alias("chunk"), cut.alias(name))
    tail = F.when(F.size("samples") > left, F.slice("samples", F.size("samples") - left + 1, left)).otherwise(F.col("samples"))
    out = chunks
    if left:
        out = out.join(part(1, "before", tail), [key, "chunk"], "left")
    if right:
        out = out.join(part(-1, "after", F.slice("samples", 1, right)), [key, "chunk"], "left")
    side = lambda n, name: F.coalesce(name, none) if n else none
    return out.select(*chunks.columns, side(left, "before").alias("before"), side(right, "after").alias("after"))


def frames(chunks: DataFrame, size: int, n: int, hop: int, key: str = "path") -> DataFrame:
    """``key, frame, samples``: the frames of ``n`` samples every ``hop`` of whole recordings, across the borders of chunks of ``size`` samples.

    A frame belongs to the chunk in which it begins.
    """
    if n > size + 1:
        raise ValueError("a frame may reach into one more chunk only")
    d = with_halos(chunks, 0, n - 1, key)
    first = F.ceil(F.col("chunk") * size / hop).cast("long")
    whole = A.doubles(F.concat("samples", "after"))
    last = F.least(F.col("chunk") * size + F.size("samples") - 1, F.col("chunk") * size + F.size("samples") + F.size("after") - n)
    number = F.when(last >= first * hop, F.sequence(first, F.floor(last / hop).cast("long")))
    return d.select(key, F.explode(number).alias("frame"), "chunk", whole.alias("_x")).select(key, "frame", F.slice("_x", (F.col("frame") * hop - F.col("chunk") * size + 1).cast("int"), n).alias("samples"))


class _Piece:
    """One chunk with its halos, in a recording of ``total`` samples."""

    def __init__(self, start: int, before: np.ndarray, own: np.ndarray, after: np.ndarray, total: int, n: int):
        self.start, self.stop, self.total = start, start + len(own), total
        self.low, self.x = start - len(before), np.concatenate([before, own, after])
        self.n = min(n, total)  # short recordings shorten the window
        self.hop, self.half = max(1, self.n // 4), self.n // 2
        padded = total + 2 * self.half
        self.count = (padded + (-(padded - self.n) % self.hop) - self.n) // self.hop + 1

    def spectra(self, first: int, stop: int) -> np.ndarray:
        """``[bins, frames]`` from frame ``first`` on; zeros stand beyond both ends of the recording."""
        low, high = first * self.hop - self.half, (stop - 1) * self.hop - self.half + self.n
        x = np.zeros(high - low)
        a, z = max(low, self.low), min(high, self.low + len(self.x))
        x[a - low : z - low] = self.x[a - self.low : z - self.low]
        w = spectral.hann(self.n)
        return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, self.n)[:: self.hop] * w, axis=1).T / w.sum()

    def own_frames(self) -> tuple[int, int]:
        """The frames that are counted with this chunk: each frame of the recording with one."""
        stop = self.count if self.stop == self.total else -(-self.stop // self.hop)
        return -(-self.start // self.hop), stop

    def gated(self, floor: np.ndarray, spread: np.ndarray, strength: float, deviations: float) -> np.ndarray:
        first, stop = max(0, -(-(self.start + self.half - self.n + 1) // self.hop)), min(self.count, (self.stop - 1 + self.half) // self.hop + 1)
        more = max(0, first - 1), min(self.count, stop + 1)
        z = self.spectra(*more)
        gain = spectral.smoothed_gain(np.abs(z), floor[:, None], spread[:, None], strength, deviations)
        z = (z * gain)[:, first - more[0] : stop - more[0]]
        w = spectral.hann(self.n)
        low = first * self.hop - self.half
        out, weight = np.zeros((stop - first - 1) * self.hop + self.n), np.zeros((stop - first - 1) * self.hop + self.n)
        for k, p in enumerate(np.fft.irfft(z.T, self.n, axis=1) * w.sum() * w):
            out[k * self.hop : k * self.hop + self.n] += p
            weight[k * self.hop : k * self.hop + self.n] += w * w
        out = np.where(weight > 1e-10, out / np.where(weight > 1e-10, weight, 1), out)
        return out[self.start - low : self.stop - low].astype(np.float32)


def _pieces(b: pa.RecordBatch, size: int, n: int) -> Iterator[_Piece | None]:
    for chunk, total, *parts in zip(*(b.column(c).to_pylist() for c in ("chunk", "total", "before", "samples", "after"))):
        yield _Piece(chunk * size, *(np.asarray(p, np.float64) for p in parts), total, n) if parts[1] else None


def gate(chunks: DataFrame, size: int, key: str = "path", strength: float = 0.8, deviations: float = 1.5, n: int = 1024) -> DataFrame:
    """``key, chunk, samples array<float>``: the stationary spectral gate over whole recordings in chunks of ``size`` samples (2 ``n`` at least).

    The noise floor and the spread of each frequency are moments over all frames
    of a recording, merged from those of the chunks; gains and samples of a chunk
    come from its own frames and those that reach into it.  The result is that of
    the gate on the whole recording.  Null samples, chunks and keys take no part.
    """
    if size < 2 * n:
        raise ValueError("chunks must have two windows at least")
    known = chunks.where(F.col(key).isNotNull() & F.col("chunk").isNotNull() & F.col("samples").isNotNull())
    known = known.select(F.col(key).alias("key"), F.col("chunk").cast("long").alias("chunk"), A.doubles("samples").alias("samples"))
    totals = known.groupBy("key").agg(F.sum(F.size("samples")).alias("total"), F.count(F.lit(1)).alias("chunks"))
    d = sets.joined_by_key(with_halos(known, 2 * n, 2 * n, "key"), scratch.checkpointed(totals), "key", "chunks")
    d = scratch.checkpointed(d)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, p in zip(b.column("key"), _pieces(b, size, n)):
                first, stop = p.own_frames() if p else (0, 0)
                if stop > first:
                    s = np.abs(p.spectra(first, stop))
                    level = 20 * np.log10(s + 1e-10)
                    m = len(s)
                    rows = [pa.array([name.as_py()] * (2 * m), b.schema.field("key").type), pa.array([f"{kind}{i:05}" for kind in "fl" for i in range(m)]), pa.array([stop - first] * (2 * m), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*rows, pa.array(np.concatenate([s.mean(1), level.mean(1)])), pa.array(np.concatenate([s.var(1), level.var(1)]) * (stop - first))], ["key", "column", "n", "mean", "m2"])

    kind = dict(d.dtypes)["key"]
    moments = fuse.merged_moments(d.mapInArrow(measure, f"key {kind}, column string, n long, mean double, m2 double"), ["key"])
    by_bin = F.array_sort(F.collect_list(F.struct("column", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"))))
    stats = moments.groupBy("key").agg(by_bin.alias("_s"))  # two rows for each frequency
    values = lambda letter, field: F.transform(F.filter("_s", lambda s: s["column"].startswith(letter)), lambda s: s[field])
    stats = stats.select("key", values("f", "mean").alias("floor"), values("l", "std").alias("spread")).join(totals.select("key", "chunks"), "key")
    d = sets.joined_by_key(d, scratch.checkpointed(stats), "key", "chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, floor, spread in zip(_pieces(b, size, n), b.column("floor").to_pylist(), b.column("spread").to_pylist()):
                out.append(p.gated(np.array(floor), np.array(spread), strength, deviations) if p else np.zeros(0, np.float32))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("chunk"), pa.array(out, pa.list_(pa.float32()))], ["key", "chunk", "samples"])

    return d.mapInArrow(run, f"key {kind}, chunk long, samples array<float>").withColumnRenamed("key", key)


def whole(chunks: DataFrame, key: str = "path") -> DataFrame:
    """``key, samples`` of recordings that fit a row, chunks in their order."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "samples")))
    return chunks.groupBy(key).agg(F.flatten(F.transform(parts, lambda p: p["samples"])).alias("samples"))
