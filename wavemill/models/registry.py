"""Plug-in models by name.

Denoiser ``(samples, rate) -> samples``; separator ``(mix, reference or None,
rate) -> list of samples``; extractor ``(samples, rate) -> vector``; recogniser
``(samples, rate, language) -> text``.  Plug-ins hold no state between calls:
what a call depends on comes as a column.  A factory is called once in each
Python worker.  A plug-in may have ``many``, which takes a list of such argument
tuples, as many as a batch has, and gives a list of results.  Where a plug-in
raises, or takes longer than ``seconds``, the row has no result and no other row
is touched (``running``).  Unknown denoisers and separators pass their input
through and an unknown recogniser falls back to the default one; an unknown
extractor is an error, as a made-up vector would accept everybody.  The
``standin_*`` models are deterministic, for tests, and only used where they are
named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import spectral
from ..functions.text import normalise
from . import running

KINDS = ("denoiser", "separator", "extractor", "recogniser")
_FACTORIES: dict[tuple[str, str], Callable[[], Callable]] = {}
#: How often a name was registered: workers keep what they made, under this number.
_VERSIONS: dict[tuple[str, str], int] = {}


def register(kind: str, name: str, factory: Callable[[], Callable]) -> None:
    if kind not in KINDS:
        raise ValueError(kind)
    _FACTORIES[kind, name] = factory
    _VERSIONS[kind, name] = _VERSIONS.get((kind, name), 0) + 1


def factory(kind: str, name: str | None) -> Callable[[], Callable]:
    if (kind, name or "") in _FACTORIES:
        return _FACTORIES[kind, name or ""]
    if kind == "extractor":
        raise KeyError(f"no extractor named {name!r}")
    return _FACTORIES[kind, "default"]


def _bins(x: np.ndarray, n: int) -> np.ndarray:
    size = np.abs(np.fft.rfft(x, 2 * n))[:n] + 1e-9
    return size / np.linalg.norm(size)


def _halves(mix, reference, rate):
    z = np.fft.rfft(mix)
    k = len(z) // 2
    return [np.fft.irfft(np.where(np.arange(len(z)) < k, z, 0), len(mix)), np.fft.irfft(np.where(np.arange(len(z)) < k, 0, z), len(mix))]


register("denoiser", "default", lambda: lambda x, rate: x)
register("denoiser", "renoise", lambda: lambda x, rate: spectral.gate(x))
register("separator", "default", lambda: lambda x, reference, rate: [x])
register("separator", "standin_bands", lambda: _halves)
register("recogniser", "default", lambda: lambda x, rate, language: "")
for _name, _dims in (("standin_cam", 192), ("standin_eres", 192), ("standin_rnet", 256)):
    register("extractor", _name, lambda n=_dims: lambda x, rate: _bins(np.asarray(x, np.float64), n))


def table_recogniser(answers: dict[int, str]) -> Callable[[], Callable]:
    """A stand-in that looks a waveform up by its number of samples."""
    return lambda: lambda x, rate, language: answers.get(len(x), "")


def _udf(returns: str, answer: Callable[..., pa.Array], *columns: Column) -> Column:
    """An iterator Arrow UDF: ``answer`` gets the columns of a batch."""

    def run(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield answer(*((batch,) if isinstance(batch, pa.Array) else batch))

    run.__annotations__ = {"batches": Iterator[Tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)(*columns)


def _waves(column: pa.Array) -> list:
    """Samples of each row as doubles."""
    return [None if x is None else np.asarray(x, np.float64) for x in column.to_pylist()]


def _vector(x) -> np.ndarray | None:
    """What a plug-in gave, as doubles; None where it is no vector."""
    try:
        out = np.asarray(x, np.float64)
    except (TypeError, ValueError):
        return None
    return out if x is not None and out.ndim == 1 else None


_DOUBLES = pa.list_(pa.float64())


def _plugin(kind: str, name: str | None) -> tuple[tuple, Callable[[], Callable]]:
    """What tells a registered plug-in from others, and its factory."""
    return (kind, name, _VERSIONS.get((kind, name or ""), 0)), factory(kind, name)


def _answers(plugin: tuple[tuple, Callable[[], Callable]], seconds: float | None, rows: list[tuple | None]) -> list:
    return running.results(running.runner(*plugin, seconds), rows)


def denoise(name: str, samples: Column, rate: Column, seconds: float | None = None) -> Column:
    """Samples; null where they are null or the model fails on them."""
    plugin = _plugin("denoiser", name)

    def answer(x: pa.Array, r: pa.Array) -> pa.Array:
        rows = [None if w is None else (w, int(k)) for w, k in zip(_waves(x), r.to_pylist())]
        return pa.array([_vector(v) for v in _answers(plugin, seconds, rows)], _DOUBLES)

    return _udf("array<double>", answer, samples, rate)


def separate(name: str, mix: Column, reference: Column, rate: Column, seconds: float | None = 60.0) -> Column:
    """Tracks, or null where the model fails or takes longer than ``seconds``."""
    plugin = _plugin("separator", name)

    def answer(x: pa.Array, ref: pa.Array, r: pa.Array) -> pa.Array:
        rows = [None if w is None else (w, k, int(n)) for w, k, n in zip(_waves(x), _waves(ref), r.to_pylist())]
        out = []
        for tracks in _answers(plugin, seconds, rows):
            tracks = None if tracks is None else [_vector(t) for t in tracks]
            out.append(None if tracks is None or any(t is None for t in tracks) else tracks)
        return pa.array(out, pa.list_(_DOUBLES))

    return _udf("array<array<double>>", answer, mix, reference, rate)


def ensemble(names: list[str] | tuple[str, ...], rate: Column, *samples: Column, seconds: float | None = None) -> Column:
    """``struct<c0: struct<m0: array<double>, ...>, ...>``: of each column of samples the vectors of all extractors, in one pass of Python.

    A vector is null where the samples are null or the model fails on them.
    """
    return _ensemble(names, rate, samples, False, seconds)


def ensemble_tracks(names: list[str] | tuple[str, ...], rate: Column, tracks: Column, seconds: float | None = None) -> Column:
    """``struct<m0: array<array<double>>, ...>``: the vectors of each track by all extractors; null where a model fails on one of a row's tracks."""
    return _ensemble(names, rate, (tracks,), True, seconds)["c0"]


def _ensemble(names, rate: Column, samples: tuple[Column, ...], tracks: bool, seconds: float | None) -> Column:
    plugins = {n: _plugin("extractor", n) for n in names}
    kind = pa.list_(_DOUBLES) if tracks else _DOUBLES
    text = "array<array<double>>" if tracks else "array<double>"

    def answer(r: pa.Array, *columns: pa.Array) -> pa.Array:
        rates, structs = r.to_pylist(), []
        for c in columns:
            lists = c.to_pylist() if tracks else [None if x is None else [x] for x in c.to_pylist()]
            rows = [(np.asarray(x, np.float64), int(k)) for xs, k in zip(lists, rates) for x in xs or ()]
            by_model, vectors = [], {n: [_vector(v) for v in _answers(p, seconds, rows)] for n, p in plugins.items()}
            for n in names:
                got = iter(vectors[n])
                found = [None if xs is None else [next(got) for _ in xs] for xs in lists]
                found = [None if v is None or any(t is None for t in v) else v for v in found]
                by_model.append(pa.array(found if tracks else [v and v[0] for v in found], kind))
            structs.append(pa.StructArray.from_arrays(by_model, [f"m{i}" for i in range(len(names))]))
        return pa.StructArray.from_arrays(structs, [f"c{i}" for i in range(len(columns))])

    fields = ", ".join(f"m{i}: {text}" for i in range(len(names)))
    returns = ", ".join(f"c{i}: struct<{fields}>" for i in range(len(samples)))
    return _udf(f"struct<{returns}>", answer, rate, *samples)


def extract(name: str, samples: Column, rate: Column, seconds: float | None = None) -> Column:
    """Vector of the samples; null where they are null or the model fails on them."""
    return _ensemble([name], rate, (samples,), False, seconds)["c0"]["m0"]


def extract_tracks(name: str, tracks: Column, rate: Column, seconds: float | None = None) -> Column:
    return ensemble_tracks([name], rate, tracks, seconds)["m0"]


def recognise(name: str, samples: Column, rate: Column, language: Column, seconds: float | None = None) -> Column:
    """Normalised transcript; null samples, an error in the model or one that takes too long give an empty one."""
    plugin = _plugin("recogniser", name)

    def answer(x: pa.Array, r: pa.Array, lang: pa.Array) -> pa.Array:
        rows = [None if w is None else (w, int(k), v) for w, k, v in zip(_waves(x), r.to_pylist(), lang.to_pylist())]
        return pa.array([normalise(t) if isinstance(t, str) else "" for t in _answers(plugin, seconds, rows)], pa.string())

    return _udf("string", answer, samples, rate, language)


def verify(a: Column, b: Column, threshold: float) -> Column:
    from ..functions.arrays import cosine

    return F.struct(cosine(a, b).alias("sim"), (cosine(a, b) >= threshold).alias("same"))
