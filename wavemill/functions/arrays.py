"""Numeric arrays (waveforms, embeddings) as column expressions; all arithmetic is in double.

Null arrays give null.  Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def doubles(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def rounded(v: Column) -> Column:
    """To six places, half away from zero; what rounds to zero keeps its sign, which ``round`` drops."""
    return F.round(F.abs(v), 6) * F.signum(v)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def bound(value: Column, use) -> Column:
    """Evaluate ``value`` once for several uses inside an expression."""
    return F.transform(F.array(value), use)[0]


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / (norm(x) * norm(y) + EPS)


def l2_normalise(x: Column, zero_guard: bool = False) -> Column:
    """Divide by the norm: plus a small constant, or (``zero_guard``) not at all where it is tiny."""
    if zero_guard:
        return bound(norm(x), lambda n: F.when(n > EPS, F.transform(x, lambda v: v / n)).otherwise(x))
    return bound(norm(x), lambda n: F.transform(x, lambda v: v / (n + EPS)))


def weighted_concat(parts: list[Column], weights: list[float]) -> Column:
    """Unit vectors scaled by weights, side by side.  Its cosine weighs each part by the weight's square."""
    def scaled(part: Column, weight: float) -> Column:
        return F.transform(l2_normalise(part, zero_guard=True), lambda v: v * F.lit(weight))

    return F.concat(*map(scaled, parts, weights))


def weighted_sum(sims: list[Column], weights: list[float]) -> Column:
    out = sims[0] * F.lit(weights[0])
    for s, w in zip(sims[1:], weights[1:]):
        out = out + s * F.lit(w)
    return out


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def peak_normalise(x: Column) -> Column:
    return bound(peak(x), lambda p: F.when(p > 0, F.transform(x, lambda v: v / p)).otherwise(x))


def peak_limit(x: Column, above: float = 1.0, to: float = 0.99) -> Column:
    return bound(peak(x), lambda p: F.when(p > above, F.transform(x, lambda v: v / p * to)).otherwise(x))


def clip(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)))


def trim_silence(x: Column, threshold: float = 0.01) -> Column:
    """From the first to the last value whose size exceeds the threshold; all of it if none does."""
    loud = F.transform(x, lambda v: F.abs(v) > threshold)
    first, last = F.array_position(loud, True), F.size(x) - F.array_position(F.reverse(loud), True) + 1
    return F.when(first == 0, x).otherwise(F.slice(x, first.cast("int"), (last - first + 1).cast("int")))


def rms(x: Column) -> Column:
    """The constant alone for an empty array."""
    return F.sqrt(F.when(F.size(x) == 0, 0.0).otherwise(dot(x, x) / F.size(x))) + F.lit(1e-9)


def energy(x: Column) -> Column:
    return dot(x, x)


def single_speaker(tracks: Column, threshold: float = 0.15) -> Column:
    """Whether the quietest track is under ``threshold`` of the loudest; true for fewer than two tracks."""
    levels = F.transform(tracks, rms)
    return F.when(F.size(tracks) < 2, F.lit(True)).otherwise(F.array_min(levels) / F.array_max(levels) < threshold)


def argmax_energy(tracks: Column) -> Column:
    """Index from 0 of the first track with the most energy."""
    return bound(F.transform(tracks, energy), lambda e: F.array_position(e, F.array_max(e)) - 1)


def fit_length(x: Column, n: Column | int) -> Column:
    """Cut, or fill with zeros, to ``n`` values."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), n - F.size(x)))), F.lit(1), n)


def crop_or_tile(x: Column, n: int, start: Column | int = 0) -> Column:
    """``n`` values from ``start``, or the array repeated up to ``n``."""
    start = F.lit(start) if isinstance(start, int) else start
    tiled = F.flatten(F.array_repeat(x, F.ceil(F.lit(n) / F.size(x)).cast("int")))
    return F.when(F.size(x) >= n, F.slice(x, start + 1, F.lit(n))).when(F.size(x) > 0, F.slice(tiled, 1, n)).otherwise(x)


def downmix(channels: Column) -> Column:
    """Mean over the channels of ``array<array<double>>``."""
    n = F.size(channels)
    return F.transform(F.sequence(F.lit(0), F.size(channels[0]) - 1), lambda i: total(F.transform(channels, lambda c: c[i])) / n)


def resample_linear(x: Column, rate_in: int, rate_out: int) -> Column:
    """``floor(len * out / in)`` values interpolated at evenly spaced places from the first to the last value."""
    if rate_in == rate_out:
        return x
    n = F.floor(F.size(x) * F.lit(rate_out) / F.lit(rate_in)).cast("int")

    def at(i: Column) -> Column:
        pos = F.when(n > 1, i * (F.size(x) - 1) / (n - 1)).otherwise(F.lit(0.0))
        low = F.floor(pos).cast("int")
        return F.element_at(x, low + 1) + (pos - low) * (F.element_at(x, F.least(low + 2, F.size(x))) - F.element_at(x, low + 1))

    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def segments(x: Column, size: int, least: int | None = None) -> Column:
    """Slices of ``size`` values; the rest is dropped, but at least one slice is kept if ``least`` values are there."""
    n = F.greatest(F.lit(1), F.floor(F.size(x) / size).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(x, k * size + 1, F.lit(size)))
    return F.when(F.size(x) >= (size if least is None else least), cut).otherwise(F.array().cast("array<array<double>>"))


def frames(x: Column, size: int, hop: int) -> Column:
    n = F.floor((F.size(x) - size) / hop).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(x, k * hop + 1, F.lit(size)))).otherwise(F.array().cast("array<array<double>>"))


def si_sdr(clean: Column, estimate: Column) -> Column:
    """Scale-invariant signal to distortion ratio in dB over the common length; higher is better."""
    n = F.least(F.size(clean), F.size(estimate))

    def centred(x: Column) -> Column:
        return bound(F.slice(x, F.lit(1), n), lambda y: bound(total(y) / n, lambda m: F.transform(y, lambda v: v - m)))

    def ratio(p: Column) -> Column:
        c, e = p["c"], p["e"]
        a = dot(e, c) / (dot(c, c) + 1e-10)
        return bound(a, lambda k: F.lit(10.0) * F.log10(total(F.transform(c, lambda v: k * v * k * v)) / (total(F.zip_with(e, c, lambda x, y: (x - k * y) * (x - k * y))) + 1e-10)))

    return bound(F.struct(centred(clean).alias("c"), centred(estimate).alias("e")), ratio)


def mean_subtracted(matrix: Column) -> Column:
    """Subtract from every frame the mean over time of each bin."""
    n = F.size(matrix)
    mean = F.transform(F.sequence(F.lit(0), F.size(matrix[0]) - 1), lambda j: total(F.transform(matrix, lambda r: r[j])) / n)
    return bound(mean, lambda m: F.transform(matrix, lambda r: F.zip_with(r, m, lambda a, b: a - b)))


def duration(n_samples: Column, rate: Column | int) -> Column:
    return n_samples / (F.lit(rate) if isinstance(rate, int) else rate)
