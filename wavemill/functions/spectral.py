"""Spectral gate, short-time Fourier transform, polyphase resampling, mixing and mel features in numpy, as Arrow UDFs."""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stft(x: np.ndarray, n: int, hop: int) -> np.ndarray:
    """``[bins, frames]``: half a window of zeros at both ends, zeros up to whole hops, scaled by the window's sum."""
    n = int(n)
    x = np.concatenate([np.zeros(n // 2), x, np.zeros(n // 2)])
    x = np.concatenate([x, np.zeros(-(len(x) - n) % hop)])
    w = hann(n)
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, n)[::hop] * w, axis=1).T / w.sum()


def istft(z: np.ndarray, n: int, hop: int) -> np.ndarray:
    """Overlap-add with the squared window taken out again."""
    w = hann(n)
    parts = np.fft.irfft(z.T, n, axis=1) * w.sum() * w
    out, weight = np.zeros((len(parts) - 1) * hop + n), np.zeros((len(parts) - 1) * hop + n)
    for k, p in enumerate(parts):
        out[k * hop : k * hop + n] += p
        weight[k * hop : k * hop + n] += w * w
    out = np.where(weight > 1e-10, out / np.where(weight > 1e-10, weight, 1), out)
    return out[n // 2 : len(out) - n // 2]


def _three(x: np.ndarray, axis: int) -> np.ndarray:
    """Mean of three neighbours, the edge value repeated."""
    x = np.moveaxis(x, axis, 0)
    padded = np.concatenate([x[:1], x, x[-1:]])
    return np.moveaxis((padded[:-2] + padded[1:-1] + padded[2:]) / 3, 0, axis)


def smoothed_gain(size: np.ndarray, floor: np.ndarray, spread: np.ndarray | float, strength: float, deviations: float) -> np.ndarray:
    """The gain of each bin and frame from its magnitude and its frequency's noise floor (and spread in dB), smoothed over neighbours."""
    below = 20 * np.log10(size + 1e-10) - (20 * np.log10(floor + 1e-10) + deviations * spread)
    return _three(_three(np.where(below >= 0, 1.0, 10 ** (strength * below / 20)), 0), 1)


def gate(audio: np.ndarray, stationary: bool = True, strength: float = 0.8, deviations: float = 1.5, n: int = 1024) -> np.ndarray:
    """Lower what lies under a noise threshold per frequency, smooth the gains, keep the length; float32."""
    if not len(audio):
        return audio
    x = np.asarray(audio, np.float64)
    window = min(n, len(x))  # short signals shorten the window
    hop = max(1, window // 4)
    z = stft(x, window, hop)
    size = np.abs(z)
    level = 20 * np.log10(size + 1e-10)
    if stationary:
        floor, spread = size.mean(1, keepdims=True), level.std(1, keepdims=True)
    else:
        floor, spread = np.percentile(size, 15, axis=1, keepdims=True), 6.0
    y = istft(z * smoothed_gain(size, floor, spread, strength, deviations), window, hop)
    return np.pad(y[: len(x)], (0, max(0, len(x) - len(y)))).astype(np.float32)


def resample_poly(x: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    """Rational resampling with a windowed sinc of 10 periods to each side (Kaiser, beta 5)."""
    k = gcd(rate_in, rate_out)
    up, down = rate_out // k, rate_in // k
    if up == down or not len(x):
        return np.asarray(x, np.float64)
    widest = max(up, down)
    half = 10 * widest
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / widest) / widest * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    return np.convolve(spread, taps)[half : half + len(spread)][::down]


def mix(clean: np.ndarray, noise: np.ndarray, snr: float, start: int = 0) -> np.ndarray:
    """Noise cropped from ``start`` or repeated to the clean length and added at the ratio in dB; limited to 0.99."""
    n = len(clean)
    noise = noise[start : start + n] if len(noise) > n else np.resize(noise, n)
    level = lambda v: np.sqrt(np.mean(np.square(v, dtype=np.float64))) + 1e-12
    out = clean + noise * (level(clean) / (level(noise) * 10 ** (snr / 20)))
    top = np.abs(out).max(initial=0)
    return (out / top * 0.99 if top > 0.99 else out).astype(np.float32)


def mel_filters(bins: int, n: int, rate: int, low: float = 20.0) -> np.ndarray:
    mel = lambda f: 1127 * np.log1p(np.asarray(f) / 700)
    edges = np.linspace(mel(low), mel(rate / 2), bins + 2)
    at = mel(np.arange(n // 2 + 1) * rate / n)[None, :]
    up, down = (at - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None], (edges[2:, None] - at) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def fbank(x: np.ndarray, rate: int = 16_000, bins: int = 80) -> np.ndarray:
    """``[frames, bins]`` log mel energies: 25 ms windows every 10 ms, mean removed, pre-emphasis 0.97, Povey window."""
    size, hop = rate * 25 // 1000, rate // 100
    if len(x) < size:
        return np.zeros((0, bins), np.float32)
    f = np.lib.stride_tricks.sliding_window_view(np.asarray(x, np.float64), size)[::hop]
    f = f - f.mean(1, keepdims=True)
    f = f - 0.97 * np.concatenate([f[:, :1], f[:, :-1]], axis=1)
    n = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(f * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))) ** 0.85, n)) ** 2
    return np.log(np.maximum(power @ mel_filters(bins, n, rate).T, np.finfo(np.float32).eps)).astype(np.float32)


def erb_matrix(low: int, high: int, n: int = 512, rate: int = 16_000) -> np.ndarray:
    """Triangular filters on the equivalent rectangular bandwidth scale for bins from ``low`` on, ``high`` of them."""
    erb = lambda f: 24.7 * np.log10(0.00437 * np.asarray(f) + 1)
    inverse = lambda e: (10 ** (e / 24.7) - 1) / 0.00437
    points = np.round(inverse(np.linspace(erb(low * rate / n), erb(rate / 2), high)) * n / rate)
    at = np.arange(low, n // 2 + 1)
    out = np.array([np.interp(at, points, np.eye(high)[k]) for k in range(high)])
    return np.maximum(out, 0)


def complex_mask(real: np.ndarray, imag: np.ndarray, mask_real: np.ndarray, mask_imag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = (real + 1j * imag) * (mask_real + 1j * mask_imag)
    return z.real, z.imag


def spectral_gate(x: Column, **options) -> Column:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else gate(np.asarray(v), **options))

    return run(x)


def mix_at_snr(clean: Column, noise: Column, snr: Column, start: Column) -> Column:
    """``mix`` for columns, within the JVM; ``start`` is taken modulo the places where a crop can begin.  Null without noise or with a null on any side."""
    n, m = F.size(clean), F.size(noise)
    first = F.when(m > n, F.pmod(start.cast("long"), F.greatest(m - n + 1, F.lit(1)))).otherwise(F.lit(0))
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(noise, (F.pmod(first + i - 1, m) + 1).cast("int")))
    level = lambda x: F.sqrt(A.dot(x, x) / F.size(x)) + F.lit(1e-12)
    added = A.bound(F.struct(cut.alias("n"), clean.alias("c")), lambda p: A.bound(level(p["c"]) / (level(p["n"]) * F.pow(F.lit(10.0), snr / 20)), lambda k: F.zip_with(p["c"], p["n"], lambda a, b: a + b * k)))
    limited = A.peak_limit(added, 0.99, 0.99).cast("array<float>")
    return F.when(n == 0, F.array().cast("array<float>")).when(m > 0, limited)


def log_mel(x: Column, rate: int = 16_000, bins: int = 80) -> Column:
    @F.pandas_udf("array<array<float>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else [list(map(float, r)) for r in fbank(np.asarray(v), rate, bins)])

    return run(x)


def resample_polyphase(x: Column, rate_in: int, rate_out: int) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else resample_poly(np.asarray(v), rate_in, rate_out))

    return run(x)


def masked(real: Column, imag: Column, mask_real: Column, mask_imag: Column) -> Column:
    """``struct<real, imag>``: a spectrum of one frame times its complex mask."""
    z = F.arrays_zip(real.alias("a"), imag.alias("b"), mask_real.alias("c"), mask_imag.alias("d"))
    part = lambda f: F.transform(z, lambda v: f(v["a"], v["b"], v["c"], v["d"]))
    return F.struct(part(lambda a, b, c, d: a * c - b * d).alias("real"), part(lambda a, b, c, d: a * d + b * c).alias("imag"))


def erb_bands(frame: Column, low: int, high: int, n: int = 512, rate: int = 16_000) -> Column:
    """Merge the ``n // 2 + 1`` bins of a frame: the first ``low`` stay, the others are summed into ``high`` bands."""
    rows = erb_matrix(low, high, n, rate)
    bands = [A.dot(F.slice(frame, low + 1, rows.shape[1]), F.array(*[F.lit(float(v)) for v in r])) for r in rows]
    return F.concat(F.slice(frame, 1, low), F.array(*bands))


def erb_split(bands: Column, low: int, high: int, n: int = 512, rate: int = 16_000) -> Column:
    """Spread bands back over the bins with the transposed filters."""
    rows = erb_matrix(low, high, n, rate)
    bins = [A.dot(F.slice(bands, low + 1, high), F.array(*[F.lit(float(v)) for v in c])) for c in rows.T]
    return F.concat(F.slice(bands, 1, low), F.array(*bins))
