"""Removal of repeated byte strings with common-prefix interval trees.

Every byte covered by a ``length``-byte string that also starts anywhere else
(in another document or in the same one) is removed; all is judged on the
input.  Documents are UTF-8 bytes, and a match never crosses a document's end.

*Sparse suffixes.*  A suffix array of the whole corpus would not fit anywhere,
so only the suffixes at anchors are sorted.  Among all ``ANCHOR``-byte strings
inside each ``length``-byte window the one with the least hash (the first, if
equal) is an anchor.  Equal windows choose equal anchors, so equal windows are
found at equal anchors.

*Interval tree.*  The suffixes at one anchor are sorted; a stack scan over the
lengths of common prefixes of neighbours gives the tree of intervals.  The
members of an interval share ``r`` bytes from the anchor on.  Among them, how
far each one's left side agrees with any other's is tested the same way (an
interval whose members all go on equally to the left just extends).  A member
with ``l`` bytes in common to the left and ``l + r >= length`` lies in repeats
that reach from ``l`` before the anchor to ``r`` after it.  All members get
their spans, not just neighbours.

*Skew.*  Of equal whole texts one is looked at.  Equal surroundings of an
anchor are repeats at once and are one member.  The commonest anchors (a
bounded list, counted over all documents) and all others with more than
``MOST_MEMBERS`` surroundings are not gathered: strings over such
an anchor are counted by fingerprint, coarse ones first, then whole windows
whose coarse strings occur again, combined within each task before they travel.

Fingerprints (anchors, surroundings, windows, whole texts) have 64 bits or
more; windows' fingerprints and whole texts are salted by independent hashes.

Null text counts as empty: no bytes, nothing removed.  Repeated rows are equal
texts, so they are removed whole if ``length`` bytes long.  Null ids are kept.
An empty table gives no rows.  Very long texts are taken in pieces that overlap,
so that what is held besides a text does not grow with it.  Columns other than
the id, the text and those named in ``carry`` do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ChunkCounter, batches_of, checkpointed, heavy_values, id_text, joined, mix64, table, trimmed

LENGTH = 200
ANCHOR = 64

#: Long texts are hashed in pieces of about this many bytes.
PIECE = 1 << 20
#: Anchors with more surroundings than this are not gathered: windows over them are counted instead.
MOST_MEMBERS = 20_000


def anchor_size(length: int) -> int:
    """Bytes of an anchor: ``ANCHOR``, or a third of a short ``length``."""
    if length < 3:
        raise ValueError("length must be 3 at least")
    return min(ANCHOR, length // 3)


def _bits(length: int) -> int:
    return length.bit_length()


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Hasher:
    """Hashes of all substrings of one byte string by prefix sums modulo 2**64 of mixed bytes."""

    _up = _down = np.zeros(0, np.uint64)
    _mixed = {s: mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(s)) for s in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)}

    def __init__(self, data: bytes, seed: int = 0xD6E8FEB86659FD93):
        n = len(data)
        if len(Hasher._up) <= n:
            Hasher._up, Hasher._down = _powers(_BASE, 2 * n + 2), _powers(_INVERSE, 2 * n + 2)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self._mixed[seed][np.frombuffer(data, np.uint8)] * Hasher._down[:n])])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * Hasher._up[start] + (stop - start).astype(np.uint64))


def sliding_first_min(h: np.ndarray, w: int) -> np.ndarray:
    """Distinct places of the first least value of every window of ``w`` values, ascending."""
    n = len(h) - w + 1
    if n < 1:
        return np.zeros(0, np.int64)
    # The place in the low bits makes the least value unique: of equal ones the first.  It orders by 34 bits of the hash.
    low, size, place = h >> np.uint64(30) << np.uint64(30) | np.arange(len(h), dtype=np.uint64), 1, np.uint64((1 << 30) - 1)
    while size * 2 <= w:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[w - size : w - size + n])
    return (low[np.concatenate([[True], low[1:] != low[:-1]])] & place).astype(np.int64)


def anchors(data: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, Hasher, int]]:
    """Places and hashes of the anchors of a text, piece by piece, with a hasher of the piece and where it begins.

    A piece goes ``length`` bytes beyond its anchors to the left and right, as far as the text does.
    """
    size, last = anchor_size(length), -1
    for first in range(0, len(data) - length + 1, PIECE):
        begin = max(0, first - length)
        piece = Hasher(data[begin : first + PIECE + 2 * length])
        i = np.arange(first, min(len(data), first + PIECE - 1 + length) - size + 1) - begin  # starts of anchors in windows that start here
        h = piece.of(i, i + size)
        at = sliding_first_min(h, length - size + 1)
        h, at = h[at], at + first
        if len(at) and at[0] == last:
            h, at = h[1:], at[1:]
        if len(at):
            last = at[-1]
            yield at, h, piece, begin


def _key():
    """A document's content: 64 bits of its SHA-256 digest and length."""
    return F.xxhash64(F.sha2(F.col("text"), 256), F.octet_length("text"))


def _column(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)


def _packed(at: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """A place and the numbers of bytes around it that its text has, ``length`` at most."""
    return at << 2 * bits | left << bits | right


def _unpacked(at, bits: int) -> tuple:
    """The same apart; of arrays or of a column."""
    low = (1 << bits) - 1
    if isinstance(at, Column):
        return F.shiftright(at, 2 * bits), F.shiftright(at, bits).bitwiseAND(F.lit(low)), at.bitwiseAND(F.lit(low))
    return at >> 2 * bits, at >> bits & low, at & low


def _frequent(texts: DataFrame, share: float, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ChunkCounter(share, 12, 400_000)

        def rows(got) -> Iterator[pa.RecordBatch]:
            if got and len(got[0]):
                yield pa.RecordBatch.from_arrays([_column(got[0]), pa.array(got[1])], ["value", "n"])

        for whole in batches:
            for b in batches_of(whole, "text"):
                for t in b.column("text").to_pylist():
                    for _, h, _, _ in anchors(t.encode(), length):
                        yield from rows(counter.add(np.unique(h), 1))
        yield from rows(counter.flush())

    return texts.select("text").mapInArrow(trimmed(run), "value long, n long")


def _places(texts: DataFrame, common: np.ndarray, length: int) -> DataFrame:
    """``anchor, around, key, at, often``: each anchor, the hash of its surroundings, and where it is."""
    held = texts.sparkSession.sparkContext.broadcast(np.sort(common))  # of bounded length
    reach, bits = length - anchor_size(length), _bits(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for whole in batches:
            for b in batches_of(whole, "text", 4 << 20):
                out = []
                for key, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                    data = t.encode()
                    for at, h, piece, begin in anchors(data, length):
                        left, right = np.minimum(at, reach), np.minimum(len(data) - at, length)
                        around = mix64(piece.of(at - left - begin, at + right - begin) + left.astype(np.uint64))
                        out.append((h, around, np.full(len(at), key), _packed(at, left, right, bits)))
                if out:
                    h, around, key, at = (np.concatenate(c) for c in zip(*out))
                    often = np.isin(h, known)
                    yield pa.RecordBatch.from_arrays([_column(h), _column(around), pa.array(key), pa.array(at), pa.array(often)], ["anchor", "around", "key", "at", "often"])

    return texts.mapInArrow(trimmed(run), "anchor long, around long, key long, at long, often boolean")


def _sorted_groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Cut sorted batches so that no group is split; a batch and the last group of the one before are held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        values = np.asarray(b.column(by))
        first = held[0].column(by)[0].as_py() if held else None
        if held and values[-1] == first:
            held.append(b)
            continue
        cut = int(np.searchsorted(values, values[-1]))
        if held or cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _sorted_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and surroundings -> ``key, at, anchor, full, member`` of anchors that occur again."""
    for t in _sorted_groups(batches, "anchor"):
        anchor, around, key, at = (np.asarray(t.column(c)) for c in ("anchor", "around", "key", "at"))
        new_a = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new_c = new_a | np.concatenate([[True], around[1:] != around[:-1]])
        a_id, c_id = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
        full = np.bincount(c_id)[c_id] > 1
        several = np.bincount(a_id, weights=new_c)[a_id] > 1
        member = several & new_c
        keep = full | member
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, at, anchor, full, member)], ["key", "at", "anchor", "full", "member"])


def lcp_of_neighbours(rows: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row (padded bytes) with the one before; the first has 0."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 4096):
        z = min(len(rows), a + 4096)
        differ = rows[a:z] != rows[a - 1 : z - 1]
        out[a:z] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(out, np.minimum(lens, np.concatenate([[0], lens[:-1]])))


def intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """Stack scan of an enhanced suffix array: ``(common prefix, first, last)`` of every interval of two members or more, children first."""
    out, stack = [], [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now = int(lcp[i]) if i < len(lcp) else -1
        left = i - 1
        while stack and stack[-1][0] > now:
            depth, left = stack.pop()
            out.append((depth, left, i - 1))
        if stack and stack[-1][0] < now or not stack and now >= 0:
            stack.append((now, left))
    return [x for x in out if x[2] > x[1]]


def tree_groups(left: list[bytes], lcp: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeats over one anchor: how far each reaches to the left and right of it, and all its members.

    ``left`` has the bytes before the members (reversed) in suffix order, ``lcp``
    the common prefixes of neighbours from the anchor on.  An interval's members
    agree to the right as far as its depth; sorted by their left sides, a second
    stack scan gives those that agree to the left.  Of these a set is a maximal
    repeat if it goes on unequally to the right too.
    """
    order = np.array(sorted(range(len(left)), key=left.__getitem__))
    rank = np.argsort(order)
    pairs = ((left[order[k - 1]], left[order[k]]) for k in range(1, len(order)))
    common = [0] + [next((j for j, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q))) for p, q in pairs]
    to_left, to_right = _least_between(np.array(common)), _least_between(lcp)
    for depth, a, z in intervals(lcp):
        inside = np.sort(rank[a : z + 1])
        agree = np.concatenate([[0], to_left(inside[:-1] + 1, inside[1:])])
        for ext, x, y in intervals(agree):
            if ext + depth >= length:
                who = np.sort(order[inside[x : y + 1]])
                if to_right(who[:1] + 1, who[-1:])[0] == depth:
                    yield ext, depth, who


def _least_between(values: np.ndarray):
    """A function of arrays ``a <= z``: the least value from place ``a`` to ``z``, by doubling."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))

    def least(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        k = np.frexp((z - a + 1).astype(float))[1] - 1
        out = np.empty(len(a), values.dtype)
        for level in np.unique(k):
            at = k == level
            out[at] = np.minimum(levels[level][a[at]], levels[level][z[at] - (1 << level) + 1])
        return out

    return least


def tree_spans(left: list[bytes], lcp: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For members of one anchor in suffix order (``left`` reversed): how far repeats reach to the left and right, 0 and 0 if none."""
    reach_l, reach_r = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    for ext, depth, who in tree_groups(left, lcp, length):
        reach_l[who], reach_r[who] = np.maximum(reach_l[who], ext), np.maximum(reach_r[who], depth)
    return reach_l, reach_r


def _with_text(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """The texts that have a list, with it.  Lists grow with the corpus, so texts and lists meet by a shuffle."""
    return texts.join(lists, "key")


def _members(texts: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """``anchor, right, left, key, at`` with the bytes around each place of ``rows`` (key, anchor, at); ``left`` is reversed."""
    lists = rows.groupBy("key").agg(F.collect_list(F.struct("anchor", "at")).alias("todo"))  # a document's own places
    reach, shift = length - anchor_size(length), 2 * _bits(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of(whole, "text", 4 << 20):
                out = []
                for key, t, todo in zip(*(b.column(c).to_pylist() for c in ("key", "text", "todo"))):
                    data = t.encode()
                    for x in todo:
                        p = x["at"] >> shift
                        out.append((x["anchor"], data[p : p + length], data[max(0, p - reach) : p][::-1], key, p))
                for i in range(0, len(out), 4096):
                    cols = zip(*out[i : i + 4096])
                    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["anchor", "right", "left", "key", "at"])

    return _with_text(texts, lists).select("key", "text", "todo").mapInArrow(trimmed(run), "anchor long, right binary, left binary, key long, at long")


def _trees(members: DataFrame, length: int) -> DataFrame:
    """``key, start, stop`` of repeats, from an interval tree for each anchor."""
    ordered = members.repartition("anchor").sortWithinPartitions("anchor", "right", "left")

    def padded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        values = column.to_pylist()
        lens = np.array([len(v) for v in values], dtype=np.int64)
        width = max(1, int(lens.max(initial=0)))
        return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(-1, width), lens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _sorted_groups(batches, "anchor"):
            anchor, key, at = (np.asarray(t.column(c)) for c in ("anchor", "key", "at"))
            right, right_n = padded(t.column("right"))
            left, left_n = padded(t.column("left"))
            new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            first = np.flatnonzero(new)
            size = np.diff(np.concatenate([first, [len(anchor)]]))
            lcp_r, lcp_l = lcp_of_neighbours(right, right_n), lcp_of_neighbours(left, left_n)
            reach_l, reach_r = np.zeros(len(anchor), np.int64), np.zeros(len(anchor), np.int64)
            # Two members: one interval, both directions are known.
            two = first[size == 2]
            l2, r2 = lcp_l[two + 1], lcp_r[two + 1]
            good = l2 + r2 >= length
            for k in (0, 1):
                reach_l[two[good] + k], reach_r[two[good] + k] = l2[good], r2[good]
            for a, m in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                s = slice(a, a + m)
                lefts = [x[:n].tobytes() for x, n in zip(left[s], left_n[s])]
                lcp = lcp_r[s].copy()
                lcp[0] = 0
                reach_l[s], reach_r[s] = tree_spans(lefts, lcp, length)
            hit = reach_r > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (key, at - reach_l, at + reach_r)], ["key", "start", "stop"])

    return ordered.mapInArrow(trimmed(run), "key long, start long, stop long")


def repeat_groups(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``group_id, n_bytes, doc_id, start``: every maximal repeat of ``length`` bytes or more, with all its occurrences.

    A repeat is seen ``length`` bytes to the right of an anchor and as many
    less the anchor to the left; one that goes on beyond is several groups that
    overlap.  Rows with one id are one another's occurrences too.  Places with
    equal surroundings are one class, which stands twice in its anchor's tree;
    its places meet the groups afterwards by a shuffle.  So however often a
    passage occurs, a task holds the distinct surroundings of an anchor and no
    more.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    places = checkpointed(_places(texts, np.zeros(0, np.uint64), length).select("key", "anchor", "at"))
    again = checkpointed(places.groupBy("anchor").count().where("count > 1"))
    rows = joined(places, again.select("anchor"), "anchor", "left_semi", again.count())
    seen = checkpointed(_members(texts, rows, length).distinct().withColumn("class", F.xxhash64("anchor", "right", "left")))
    classes = seen.groupBy("anchor", "right", "left", "class").agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("n"))
    twice = classes.select("anchor", "right", "left", "class", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    ordered = twice.repartition("anchor").sortWithinPartitions("anchor", "right", "left", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _sorted_groups(batches, "anchor"):
            anchor, name = (np.asarray(t.column(c)) for c in ("anchor", "class"))
            right, left = t.column("right").to_pylist(), t.column("left").to_pylist()
            ends = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
            for a, z in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if z - a < 2:
                    continue
                lens = np.array([len(x) for x in right[a:z]])
                rows = np.frombuffer(b"".join(x.ljust(length, b"\0") for x in right[a:z]), np.uint8).reshape(-1, length)
                for ext, depth, who in tree_groups(left[a:z], lcp_of_neighbours(rows, lens), length):
                    one, members = a + int(who[0]), np.unique(name[a:z][who])
                    string = left[one][:ext][::-1] + right[one][:depth]
                    # All occurrences have this anchor if a window inside the string chooses it; else they are all found at those that its windows choose.
                    if not any((at == ext).any() for at, *_ in anchors(string, length)):
                        continue
                    said = Hasher(string).of(np.array([0]), np.array([ext + depth]))
                    cols = (np.full(len(members), said.view(np.int64)[0]), np.full(len(members), ext + depth), members, np.full(len(members), ext))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["group_id", "n_bytes", "class", "ext"])

    groups = ordered.select("anchor", "right", "left", "class").mapInArrow(trimmed(run), "group_id long, n_bytes long, class long, ext long")
    found = groups.join(seen.select("class", "key", "at"), "class")
    return found.select("group_id", "n_bytes", F.col("key").alias("doc_id"), (F.col("at") - F.col("ext")).alias("start")).distinct()


#: Up to so many repeated fingerprints are sent to all tasks; beyond, windows are joined with them.
MOST_SENT = 500_000
#: Extents of the coarse strings around an anchor are multiples of so many bytes, from round to round.
STEPS = (17, 4)


def _counted(values: Iterator[tuple[np.ndarray, ...]], names: list[str], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Distinct tuples of the given columns with their number ``n``, combined within the task over about ``size`` tuples."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def rows() -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(c) for c in zip(*held)]
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
        first = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([*(_column(c[first]) for c in cols), pa.array(np.diff(np.append(first, len(new))))], [*names, "n"])

    for x in values:
        if len(x[0]):
            held.append(x)
            n += len(x[0])
        if n >= size:
            yield from rows()
            held, n = [], 0
    if held:
        yield from rows()


def _windows(texts: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """``key, start, stop`` of repeats over common anchors: windows over such a place (key, at) are counted by fingerprint.

    A window of a document counts once, whatever number of places it covers.
    Coarse strings go first: a window that reaches ``l`` bytes to the left of
    its anchor holds the string whose extents to the left and right are
    multiples of a step that depend on ``l`` alone, so only windows whose
    string occurs again can.  The next round does the same with longer strings
    of the windows left.  Where too many strings of a round occur again, that
    round drops nothing.
    """
    sc, size = texts.sparkSession.sparkContext, anchor_size(length)
    # Two tasks a core: the fewer tasks, the more of their equal strings are counted before they travel.
    source = _with_text(texts, rows.groupBy("key").agg(F.collect_list("at").alias("todo"))).select("key", "text", "todo").coalesce(2 * sc.defaultParallelism)
    reach, shift = length - size, 2 * _bits(length)
    reaches = np.arange(reach + 1)
    rounds: list[tuple] = []  # where a window's string begins, its width, and those that occur again

    def left(data: bytes, todo: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, Hasher, int]]:
        """The anchors and reaches of the windows that the rounds so far leave, with a hasher of the piece and where it begins."""
        places = np.sort(np.array(todo, dtype=np.int64) >> shift)
        for first in range(0, len(places), 4096):
            some = places[first : first + 4096]
            for k in np.unique(some // PIECE).tolist():
                part = some[some // PIECE == k]
                begin = max(0, int(part[0]) - length)
                one = Hasher(data[begin : int(part[-1]) + 2 * length])
                p, l = (x.ravel() for x in np.meshgrid(part, reaches, indexing="ij"))
                keep = (p >= l) & (p - l + length <= len(data))
                for back, width, again in rounds:
                    p, l = p[keep], l[keep]
                    string, which = np.unique(p - back[l], return_inverse=True)
                    known, f = np.append(again.value, np.iinfo(np.int64).max), one.of(string - begin, string - begin + width).view(np.int64)
                    keep = (known[np.searchsorted(known[:-1], f)] == f)[which]
                yield p[keep], l[keep], one, begin

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[int]]]:
        for whole in batches:
            for b in batches_of(whole, "text", 1 << 20):
                for key, t, todo in zip(*(b.column(c).to_pylist() for c in ("key", "text", "todo"))):
                    yield key, t.encode(), todo

    for step in STEPS:
        blocks = max(0, -(-(reach - 2 * (step - 1)) // step))
        back, width = np.minimum(reaches // step, blocks) * step, size + blocks * step

        def strings(batches: Iterator[pa.RecordBatch], back=back, width=width) -> Iterator[pa.RecordBatch]:
            # A string at the border of two pieces may count twice; then it just rules nothing out.
            starts = ((one, np.unique(p - back[l]) - begin) for _, data, todo in documents(batches) for p, l, one, begin in left(data, todo))
            return _counted(((one.of(x, x + width),) for one, x in starts), ["f"])

        twice = checkpointed(source.mapInArrow(trimmed(strings), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).where("n > 1").select("f"))
        if twice.count() <= MOST_SENT:
            rounds = [*rounds, (back, width, sc.broadcast(np.sort(twice.toPandas()["f"].to_numpy(np.int64))))]  # MOST_SENT at most

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for key, data, todo in documents(batches):
            mask = np.zeros(len(data), bool)
            for p, l, _, _ in left(data, todo):
                mask[p - l] = True
            for begin in range(0, len(data), PIECE):
                start = np.flatnonzero(mask[begin : begin + PIECE])
                if len(start):
                    piece = data[begin : begin + PIECE + length]
                    yield key, start + begin, *(Hasher(piece, *seed).of(start, start + length) for seed in ((), (0xA0761D6478BD642F,)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(((one, two) for _, _, one, two in fingerprints(batches)), ["f1", "f2"])

    seen = source.mapInArrow(trimmed(counted), "f1 long, f2 long, n long")
    again = checkpointed(seen.groupBy("f1", "f2").agg(F.sum("n").alias("n")).where("n > 1").select("f1", "f2"))
    if again.count() > MOST_SENT:

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, start, one, two in fingerprints(batches):
                yield pa.RecordBatch.from_arrays([_column(one), _column(two), pa.array(np.full(len(start), key)), pa.array(start)], ["f1", "f2", "key", "start"])

        every = source.mapInArrow(trimmed(placed), "f1 long, f2 long, key long, start long")
        return every.join(again, ["f1", "f2"]).select("key", "start", (F.col("start") + length).alias("stop"))
    known = again.toPandas().sort_values(["f1", "f2"])
    held = sc.broadcast(tuple(known[c].to_numpy(np.int64) for c in ("f1", "f2")))  # MOST_SENT pairs at most

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k1, k2 = (np.append(k, np.iinfo(np.int64).max) for k in held.value)
        for key, start, one, two in fingerprints(batches):
            one, two = one.view(np.int64), two.view(np.int64)
            at = np.minimum(np.searchsorted(k1, one), len(k1) - 1)
            hit = (k1[at] == one) & (k2[at] == two)
            at = np.minimum(at + 1, len(k1) - 1)  # two pairs may share their first half
            hit |= (k1[at] == one) & (k2[at] == two)
            spans = _merge([(x, x + length) for x in start[hit].tolist()])
            if spans:
                a, z = zip(*spans)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(a)), pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["key", "start", "stop"])

    return source.mapInArrow(trimmed(found), "key long, start long, stop long")


def _equal(often: DataFrame, equal: DataFrame, length: int) -> DataFrame:
    """``key, start, stop`` of the checkpointed places whose surroundings are among the checkpointed ``equal`` ones, merged within a batch."""
    sent, bits = equal.count() <= MOST_SENT, _bits(length)
    # The surroundings hold the anchor, so their hash alone tells them.
    held = often.sparkSession.sparkContext.broadcast(np.sort(equal.toPandas()["around"].to_numpy(np.int64)) if sent else None)  # MOST_SENT at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            around, key, at = (np.asarray(b.column(c)) for c in ("around", "key", "at"))
            place, before, after = _unpacked(at, bits)
            start, stop = place - before, place + after
            hit = stop - start >= length
            if held.value is not None:
                known = np.append(held.value, np.iinfo(np.int64).max)
                hit &= known[np.searchsorted(held.value, around)] == around
            key, start, stop = key[hit], start[hit], stop[hit]
            order = np.lexsort((start, key))
            key, start, stop = key[order], start[order], stop[order]
            # Within a text both ends grow from place to place.
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > stop[:-1])])) if len(key) else np.zeros(0, np.int64)
            last = np.append(new[1:], len(key)) - 1 if len(key) else new
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(start[new]), pa.array(stop[last])], ["key", "start", "stop"])

    places = often if sent else often.join(equal, ["anchor", "around"], "left_semi")
    return places.select("around", "key", "at").mapInArrow(trimmed(run), "key long, start long, stop long")


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            if z > out[-1][1]:
                out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, share: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Of ``doc_id, text`` rows: ``key, n_rows`` for each distinct text, and ``key, spans`` (merged, by byte) for those with repeats inside or elsewhere.

    Texts that occur more than once have no spans of their own here: they are
    repeats as a whole if ``length`` bytes long.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = base.select(_key().alias("key"), "doc_id").groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("rep"))
    whole = checkpointed(whole.where("n_rows > 1"))
    long = base.where(F.octet_length("text") >= length).withColumn("key", _key())
    copies = whole.select("key", F.col("rep"), F.lit(True).alias("copied"))
    texts = joined(long, copies, "key", "left", whole.count()).where("copied is null or doc_id <=> rep").select("key", "text")

    common = heavy_values(_frequent(texts, share, length))
    places = _places(texts, common, length)
    rare_sorted = places.where("not often").select("anchor", "around", "key", "at").repartition("anchor").sortWithinPartitions("anchor", "around")
    rare = checkpointed(rare_sorted.mapInArrow(trimmed(_sorted_rare), "key long, at long, anchor long, full boolean, member boolean"))
    place, before, after = _unpacked(F.col("at"), _bits(length))
    found = [rare.where("full").select("key", (place - before).alias("start"), (place + after).alias("stop")).where(F.col("stop") - F.col("start") >= length)]
    members = rare.where("member").select("key", "anchor", "at")
    large = checkpointed(members.groupBy("anchor").count().where(F.col("count") > MOST_MEMBERS).select("anchor"))
    n_large, to_count = large.count(), []
    if n_large:
        to_count.append(joined(members, large, "anchor", "left_semi", n_large).select("key", "at"))
        members = joined(members, large, "anchor", "left_anti", n_large)
    found.append(_trees(_members(texts, members, length), length))
    if len(common):
        often = checkpointed(places.where("often").select("anchor", "around", "key", "at"))
        per = checkpointed(often.groupBy("anchor", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("one")))
        found.append(_equal(often, per.where("n > 1").select("anchor", "around"), length))
        to_count.append(per.select("one.key", "one.at"))
    if to_count:
        places = to_count[0].unionByName(to_count[-1]) if len(to_count) > 1 else to_count[0]
        found.append(_windows(texts, places.where(before + after >= length), length))
    spans = found[0]
    for x in found[1:]:
        spans = spans.unionByName(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [_merge([(s["start"], s["stop"]) for s in row]) for row in b.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([[{"start": a, "stop": z} for a, z in row] for row in flat], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["key", "spans"])

    grouped = spans.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return whole, checkpointed(grouped.mapInArrow(trimmed(run), "key long, spans array<struct<start:long,stop:long>>"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, share: float = 0.005, whole_characters: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, kept binary, n_bytes, n_removed, n_spans`` for every row, and its columns named in ``carry``.

    With ``whole_characters`` a character stays if any of its bytes does, so
    that what is kept is valid UTF-8.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)])
    whole, spans = repeated_spans(rows.select("doc_id", "text"), length, share)
    base = rows.withColumn("key", _key())
    both = joined(base, whole.select("key", F.lit(True).alias("copied")), "key", "left", whole.count())
    # Copies have no spans of their own; they are dealt out evenly.
    both = both.withColumn("key", F.when(F.col("copied"), F.xxhash64("key", "doc_id")).otherwise(F.col("key"))).join(spans, "key", "left").drop("key")
    kinds = {"kept": T.BinaryType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType()}
    passed = [f for f in both.schema.fields if f.name not in ("text", "copied", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in batches_of(big, "text"):
                kept, counts = [], []
                for text, copied, todo in zip(*(b.column(c).to_pylist() for c in ("text", "copied", "spans"))):
                    data = text.encode()
                    cut = [(0, len(data))][: len(data) >= length] if copied else [(s["start"], s["stop"]) for s in todo or ()]
                    if whole_characters:
                        cut = [(a, z) for a, z in (_characters(data, *c) for c in cut) if a < z]
                    ends = [0, *(z for _, z in cut)]
                    kept.append(b"".join([data[e:a] for e, (a, _) in zip(ends, cut)] + [data[ends[-1] :]]))
                    counts.append((len(data), sum(z - a for a, z in cut), len(cut)))
                cols = [pa.array(c, pa.int64()) for c in zip(*counts)]
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in passed), pa.array(kept, pa.binary()), *cols], [*(f.name for f in passed), *kinds])

    out = both.mapInArrow(trimmed(run), T.StructType([*passed, *(T.StructField(n, k) for n, k in kinds.items())]))
    return out.select("doc_id", *[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)], *kinds)


def _characters(data: bytes, a: int, z: int) -> tuple[int, int]:
    """The whole characters inside a span."""
    while a < len(data) and data[a] & 0xC0 == 0x80:
        a += 1
    while z < len(data) and z > a and data[z] & 0xC0 == 0x80:
        z -= 1
    return a, z


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
