"""Vector code compression: integer product codes, assigned by a VA-file.

Vectors become whole numbers and are cut into equal consecutive parts; each
part position has a codebook of a few entries, fitted by rounds of integer
k-means, and a vector's code is the index of the nearest entry of each part.

*VA-file.*  The entries of a part position are the file that is searched.  Every
entry coordinate is held in a few bits, the number of its cell: the coordinates
of a dimension in ascending order are dealt evenly to ``2**bits`` cells, each of
which knows its least and greatest coordinate.  A query (a vector's part) makes
a table of two figures for each dimension and cell: the least and the greatest
squared distance that a coordinate in the cell can have from its own.  Sums of
table entries over an entry's cells bound its distance from below and above.
Entries whose lower bound is above the smallest upper bound are out; only the
others are refined by exact integer distances.

*On Spark.*  Each round reads the vectors once: tasks hold the codebooks (a
number of integers that does not depend on the rows) and pass on, per part,
entry and position, the sum of the parts assigned to it, in limbs of 32 bits
that the JVM adds up; the driver gets these sums and nothing else.  A round that
loses an executor repeats the lost tasks only.

All figures are exact: whole numbers below 2**53 are held as doubles, a batch
with larger ones is computed with Python's integers.  An error, or a sum of
errors, that 64 bits cannot hold ends the query.

Null vectors and those with null, NaN or infinite components are dropped.
Vectors of unlike length are filled up with zeros to the longest, and this to a
multiple of the number of parts.  The codebooks start with the vectors of the
smallest ids; of rows that repeat an id the smaller vector is first, null ids
are last, and equal rows are rows of their own.  With fewer rows than entries
there are fewer entries.  Other columns are ignored, whatever their names.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, joined_by_key, table, trimmed

#: Whole numbers below this are exact in a double.
EXACT = float(1 << 53)
LIMB = 32


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """``vec_id, label, v array<double>`` of the vectors that take part; ``label`` as text."""
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.where(F.col("v").isNotNull() & ~bad)


def floored(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``: as doubles where these are exact, else as Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale) if scale & (scale - 1) == 0 else np.full(x.shape, np.inf)  # by a power of two no bit is lost
    if not x.size or np.abs(y).max() < EXACT:
        return y
    return np.array([Fraction(v) * scale // 1 for v in x.ravel().tolist()], object).reshape(x.shape)


def matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    flat, offsets = np.asarray(column.flatten(), dtype=np.float64), np.asarray(column.offsets, dtype=np.int64)
    lens = np.diff(offsets)
    out = np.zeros((len(lens), width))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return floored(out, scale)


def _alike(a: np.ndarray, b: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if all squares, and sums over ``rows`` rows, stay exact; else both as Python integers."""
    most = max([1, *(float(abs(x)) for m in (a, b) if m.size for x in (m.min(), m.max()))])
    if a.dtype != object and b.dtype != object and max(4.0 * most * most * max(1, a.shape[-1]), most * rows) < EXACT:
        return a, b
    return tuple(m if m.dtype == object else np.array([int(x) for x in m.ravel().tolist()], object).reshape(m.shape) for m in (a, b))


class VAFile:
    """The entries of one part position with the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = 3):
        k, w = entries.shape
        self.entries = entries
        cells = min(k, 1 << bits)
        order = np.argsort(entries, axis=0, kind="stable")
        place = np.empty((k, w), np.int64)
        np.put_along_axis(place, order, np.arange(k)[:, None].repeat(w, 1), 0)
        self.cell = place * cells // max(1, k)
        ordered = np.take_along_axis(entries, order, 0)
        first = -(-np.arange(cells) * k // cells)  # of the places in a cell
        last = np.append(first[1:], k) - 1
        self.low, self.high = ordered[first].T, ordered[last].T  # dimension, cell
        pick = np.zeros((w, cells, k))
        pick[np.arange(w)[:, None], self.cell.T, np.arange(k)[None, :]] = 1
        self.pick = pick.reshape(w * cells, k)  # from a query's table to sums over an entry's cells

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of each query from each entry, as far as the cells tell."""
        x = queries[:, :, None]
        below, above = self.low - x, x - self.high
        near = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(np.abs(below), np.abs(above))
        pick = self.pick.astype(object) if queries.dtype == object else self.pick
        return tuple((t * t).reshape(len(queries), -1) @ pick for t in (near, far))

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index (the lower of equals) and squared distance of each query's nearest entry, and how many distances were refined."""
        lower, upper = self.bounds(queries)
        who, what = np.nonzero(lower <= upper.min(1)[:, None])
        apart = queries[who] - self.entries[what]
        exact = np.full(lower.shape, np.inf, queries.dtype)
        exact[who, what] = (apart * apart).sum(1)
        best = exact.argmin(1)
        return best, exact[np.arange(len(best)), best], len(who)


@dataclass
class Codebooks:
    """``entries``: part, entry, position; whole numbers.  The vectors they were fitted on have ``width`` components at most."""

    entries: np.ndarray
    scale: int
    width: int

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    def files(self, rows: np.ndarray) -> tuple[np.ndarray, list[VAFile]]:
        """Rows by part, and the file of each part, in numbers that are exact for these rows."""
        n, (p, _, w) = len(rows), self.entries.shape
        x, entries = _alike(rows[:, : p * w].reshape(n, p, w), self.entries, n)
        return x, [VAFile(e) for e in entries]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel().tolist()).encode()).hexdigest()


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    """Numbered limbs that give ``x`` by their weights; all but the last are not negative, and the last has fewer bits than 32."""
    k = 0
    while not -(1 << LIMB - 1) <= x < 1 << LIMB - 1:
        yield k, x & ((1 << LIMB) - 1)
        x, k = x >> LIMB, k + 1
    yield k, x


def _sums(kept: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Number of parts assigned to each entry, and their sums."""
    held, (p, k, w) = kept.sparkSession.sparkContext.broadcast(books), books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, books = np.zeros((p, k), np.int64), np.zeros((p, k, w), object), held.value
        for b in batches:
            x, files = books.files(matrix(b.column("v"), p * w, books.scale))
            for j, file in enumerate(files if len(x) else ()):
                mine = np.eye(k)[file.nearest(x[:, j])[0]].T
                count[j] += mine.sum(1).astype(np.int64)
                got = (mine.astype(object) if x.dtype == object else mine) @ x[:, j]
                total[j] += got if got.dtype == object else got.astype(np.int64).astype(object)
        rows = [(j, e, -1, 0, int(n)) for (j, e), n in np.ndenumerate(count) if n]
        rows += [(j, e, i, limb, v) for (j, e, i), t in np.ndenumerate(total) if t for limb, v in _limbs(int(t))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [()] * 5)], ["part", "entry", "at", "limb", "n"])

    found = kept.select("v").mapInArrow(trimmed(run), "part long, entry long, at long, limb long, n long")
    count, total = np.zeros((p, k), object), np.zeros((p, k, w), object)
    for r in found.groupBy("part", "entry", "at", "limb").agg(F.sum("n").alias("n")).toLocalIterator():  # 16 numbers for each component of a vector
        if r["at"] < 0:
            count[r["part"], r["entry"]] = r["n"]
        else:
            total[r["part"], r["entry"], r["at"]] += r["n"] << LIMB * r["limb"]
    held.destroy()
    return count, total


def fit(kept: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks of the ``usable`` vectors, all of which every round reads."""
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    w = -(-longest // parts)
    first = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    column = pa.array([r["v"] for r in first], pa.list_(pa.float64()))
    books = Codebooks(matrix(column, parts * w, scale).reshape(len(first), parts, w).transpose(1, 0, 2), scale, longest)
    for _ in range(rounds if first and w else 0):
        count, total = _sums(kept, books)
        new = books.entries.astype(object)
        for (j, e), n in np.ndenumerate(count):
            if n:
                new[j, e] = total[j, e] // n
        small = max((abs(int(x)) for x in new.ravel()), default=0) < EXACT
        books = Codebooks(new.astype(np.float64) if small else np.array([int(x) for x in new.ravel()], object).reshape(new.shape), scale, longest)
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits for each part, and the sum of the squared distances."""
    held, (p, k, w) = kept.sparkSession.sparkContext.broadcast(books), books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for b in batches:
            if not b.num_rows:
                continue
            x, files = books.files(matrix(b.column("v"), p * w, books.scale))
            code, error = np.zeros((b.num_rows, p), np.uint8), np.zeros(b.num_rows, object)
            for j, file in enumerate(files):
                code[:, j], far, _ = file.nearest(x[:, j])
                error += np.array([int(d) for d in far.tolist()], object)
            if error.max() >= 1 << 63:
                raise OverflowError("the squared distance of a vector from its code does not fit 64 bits")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array(error.tolist(), pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "v").mapInArrow(trimmed(run), "vec_id long, label string, code string, error long")


def decode(encoded: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, embedding array<double>``: the entries that a code names, as components again."""
    names = F.array(*[F.array(*[F.array(*[F.lit(int(x) / books.scale) for x in e]) for e in part]) for part in books.entries])
    index = F.transform(F.sequence(F.lit(0), F.lit(books.parts - 1)), lambda j: F.conv(F.substring("code", j * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    whole = F.flatten(F.transform(index, lambda e, j: F.get(F.get(names, j), e)))
    return encoded.select("vec_id", F.slice(whole, 1, books.width).alias("embedding"))


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, **columns: str) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of the vectors that take part; ``columns`` as for ``usable``."""
    kept = usable(vectors, **columns)
    books = fit(kept, parts, entries, rounds, scale)
    coded = checkpointed(encode(kept, books))
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n"))
    out = joined_by_key(coded, checkpointed(sums), "label", "n")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
