"""Exact n-gram Jaccard join with set-relation skipping, and its classes.

A document's set holds the 64-bit hashes of its distinct word shingles.  Two
documents link when ``|A and B| / |A or B| >= threshold``, that is when at most
``room = (|A| + |B|) * (1 - threshold) / (1 + threshold)`` shingles are in one
set only; classes are the connected components of all links.

*Equal sets* are one node, named by the fingerprint of the set.

*Index with block skipping by position.*  Sets are in blocks by size, so that
a set can link only with its own block and the next.  A set's shingles in
ascending order are cut in ``k + 1 + x`` parts by position in the range of
hashes, where ``k`` is the most room that two sets of these blocks have.  Two
linked sets are equal in ``x + 1`` parts at least, so each may leave out its
``x`` weakest (those with the fewest rare shingles, then with the fewest): the
strongest equal part is indexed by both.  A list of the index holds the sets
that are equal in one whole part; all other parts' entries are never met.

*Answers derived from a similar set's.*  A set weighs as much as the lists that
it is in hold; the heaviest set of a list (usually the text that the others
were copied from) is its head.  Each set's head is the one that it meets most
often; heads' heads are heavier and lead to a root.  The difference ``D(X)``
between a set and its root is computed once from both whole texts.  Sets that
link with their root are one class with it.  Those that do not are looked at
again among themselves, if more than ``CROWD`` of them meet in one list: a family
that is far from its root but alike in itself gets a root of its own (up to
``REROOTED`` times, and no more after a time that settled less than half of
them; what is left keeps its root).

For two sets of one root the difference is ``D(X) xor D(Y)``, so what the root
has in common with both is skipped: they both link with the root and so are in
one class, or else ``D(X)`` and ``D(Y)`` share some shingles.  Those pairs are
found by a prefix index on the differences, rarest first, where an entry's
position bounds the overlap that is still possible.

Two sets of different roots that meet in a list are decided by
``D(X) xor (root xor root') xor D(Y)``; the roots' difference is computed once
for all such pairs.  Where it is larger than the largest differences on both
sides and the room together, no pair is made at all; elsewhere only pairs whose
own differences and room reach that far.  So the pairs that are made are those
between sets far from their roots; families alike, linked or not, cost none.

*Hot keys.*  Texts meet their root's text in parts of ``PART`` members; the rows
of a list hold two numbers each, and Spark's skew joins split those of a long
list.

Null text, empty text and text without words have an empty set, which links
with nothing.  With fewer than ``words`` words the whole sequence is the one
shingle.  Rows with one id are one document, whatever their texts; rows with a
null id link with nothing and get a null component.  Very long texts are whole;
other columns are ignored; an empty table gives no rows.  Fingerprints of
shingles, parts and sets have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ChunkCounter, ascii_words_of_batch, batches_of, checkpointed, chosen_broadcasts, components, heavy_values, id_text, joined, joined_by_key, let_go, mix64, table, trimmed

#: The parts left out, as a share of the room.
SPARE = 0.5
#: How often sets that do not link with their root get another one at most, and the size of lists for which they do.
REROOTED, CROWD = 3, 32
#: The members that meet one copy of a root's text.
PART = 128
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text."""
    ids, names, offsets = ascii_words_of_batch(texts)
    code = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))[ids]
    n = len(code)
    h = np.full(max(0, n - words + 1), words, np.uint64)
    for j in range(words):
        h = mix64(h * _ODD + code[j : n - words + 1 + j])
    out = []
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if z - a >= words:
            out.append(np.unique(h[a : z - words + 1]))
        elif z > a:
            one = np.full(1, z - a, np.uint64)
            for x in code[a:z]:
                one = mix64(one * _ODD + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _fingerprint(s: np.ndarray, seed: int) -> int:
    return int(mix64(s ^ np.uint64(seed)).sum(dtype=np.uint64).view(np.int64))


def _surveyed(docs: DataFrame, words: int, share: float) -> DataFrame:
    """Of each document ``doc_id, th, n, s1, s2`` (hash of the text, size and signatures of the set), and of each shingle in at least ``share`` of the documents of a chunk ``value, often``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ChunkCounter(share, 8)
        kinds = (pa.int64(),) * 7
        names = ["doc_id", "th", "n", "s1", "s2", "value", "often"]

        def rows(got) -> Iterator[pa.RecordBatch]:
            if got and len(got[0]):
                none = pa.nulls(len(got[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([none] * 5 + [pa.array(got[0].view(np.int64)), pa.array(got[1])], names)

        for whole in batches:
            for b in batches_of(whole, "text", 2 << 20):
                sets = shingle_sets(b.column("text"), words)
                cols = [b.column("doc_id"), b.column("th"), [len(s) for s in sets], [_fingerprint(s, 0) for s in sets], [_fingerprint(s, 0xA5A5A5A5DEADBEEF) for s in sets], [None] * len(sets), [None] * len(sets)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)], names)
                yield from rows(counter.add(np.concatenate(sets), len(sets)))
        yield from rows(counter.flush())

    return docs.mapInArrow(trimmed(run), "doc_id long, th long, n long, s1 long, s2 long, value long, often long")


class Blocks:
    """Blocks of set sizes: what can link with a set is in its own block or in a neighbouring one."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def room(self, block: int) -> int:
        """The most shingles in one set only, of two linked sets of which the smaller is in ``block``."""
        while len(self.starts) < block + 2:
            self.of(self.starts[-1])
        small = self.starts[block + 1] - 1
        return (small + small * self.den // self.num) * (self.den - self.num) // (self.den + self.num)


def part_keys(s: np.ndarray, rare: np.ndarray, block: int, room: int) -> np.ndarray:
    """Keys of the ``room + 1`` strongest parts of a sorted set; ``rare`` marks its rare shingles."""
    spare = int(np.ceil(SPARE * room)) + 2
    m = room + 1 + spare
    cuts = np.minimum(np.arange(1, m) * (2.0**64 / m), 2.0**64 - 4096).astype(np.uint64)
    at = np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s + _ODD))])
    number = np.concatenate([[0], np.cumsum(rare)])
    keys = mix64((sums[at[1:]] - sums[at[:-1]]) * _ODD + mix64(np.arange(m, dtype=np.uint64) + np.uint64(block << 40)))
    return keys[np.lexsort((np.diff(at), np.diff(number[at])))[spare:]]


def _entries(docs: DataFrame, words: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """``key, node`` of every indexed part."""
    held = docs.sparkSession.sparkContext.broadcast(np.sort(common))  # of bounded length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, blocks = np.append(held.value, np.uint64((1 << 64) - 1)), Blocks(num, den)
        for whole in batches:
            for b in batches_of(whole, "text", 2 << 20):
                keys, nodes = [], []
                for s in shingle_sets(b.column("text"), words):
                    if not len(s):
                        continue
                    rare, own, node = known[np.searchsorted(held.value, s)] != s, blocks.of(len(s)), _fingerprint(s, 0)
                    for block in {own, max(0, own - 1)}:
                        room = blocks.room(block)
                        if room:  # else only equal sets link
                            keys.append(part_keys(s, rare, block, room))
                            nodes.append(np.full(len(keys[-1]), node, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], ["key", "node"])

    return docs.select("text").mapInArrow(trimmed(run), "key long, node long")


def _lists(entries: DataFrame) -> DataFrame:
    """``key, node`` of the lists of two sets at least.  Lists stream through: nothing but the last entry is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, node, whether it was given out
        for b in batches:
            key, node = np.asarray(b.column("key")), np.asarray(b.column("node"))
            if last is not None:
                key, node = np.append(last[0], key), np.append(last[1], node)
            if not len(key):
                continue
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            key, node = key[new], node[new]
            same = np.concatenate([[False], key[1:] == key[:-1]])
            give = same | np.append(same[1:], False)
            out = give.copy()
            if last is not None:
                out[0] &= not last[2]
                give[0] |= last[2]
            last = (key[-1], node[-1], bool(give[-1]))
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out])], ["key", "node"])

    return entries.repartition("key").sortWithinPartitions("key", "node").mapInArrow(trimmed(run), "key long, node long")


def _differences(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``a, b, na, nb, d, delta``: of pairs ``a, b, most`` the sizes, the number of shingles in one set only, and these where they are ``most`` at most (null: any number)."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) > PART:
        sizes = checkpointed(counts.withColumn("parts", F.ceil(F.col("n") / PART).cast("long")))
        parted = joined_by_key(pairs, sizes, "a", "n").select("a", "b", "most", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        heads = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(sizes.select("a", "parts"), "a").select("a", "text_a", copies.alias("part"))
    else:  # no head has more members than one part holds
        parted = pairs.withColumn("part", F.lit(0).cast("long"))
        heads = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"), F.lit(0).cast("long").alias("part"))
    with_b = parted.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(heads, ["a", "part"]).select("a", "b", "most", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of(whole, "text_b", 2 << 20):
                heads = b.column("text_a").dictionary_encode()  # a head stands in many rows
                head_sets = shingle_sets(heads.dictionary, words)
                other, sizes, deltas = shingle_sets(b.column("text_b"), words), [], []
                for h, y, most in zip(heads.indices.to_pylist(), other, b.column("most").to_pylist()):
                    x = head_sets[h]
                    delta = np.setxor1d(x, y, assume_unique=True)
                    sizes.append((len(x), len(y), len(delta)))
                    deltas.append(delta.view(np.int64) if most is None or len(delta) <= most else None)
                cols = [pa.array(c, pa.int64()) for c in zip(*sizes)] if sizes else [pa.array([], pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *cols, pa.array(deltas, pa.list_(pa.int64()))], ["a", "b", "na", "nb", "d", "delta"])

    return checkpointed(both.mapInArrow(trimmed(run), "a long, b long, na long, nb long, d long, delta array<long>"))


def _xor(a: Column, b: Column) -> Column:
    return F.array_except(F.concat(a, b), F.array_intersect(a, b))


def _roots(parents: DataFrame) -> DataFrame:
    """``node, root`` of ``node, parent`` rows without cycles, by doubling the way each round."""
    where = checkpointed(parents.select("node", F.col("parent").alias("root")))
    while True:
        above = where.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = checkpointed(where.join(above, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        where = step.select("node", "root")
        if step.where("moved").isEmpty():
            return where


def similar_classes(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", share: float = 0.002) -> DataFrame:
    """``doc_id, n_shingles long, component_id`` for every row; ``threshold`` is a fraction (numerator, denominator)."""
    with chosen_broadcasts(docs.sparkSession):
        return _similar_classes(docs, words, threshold, id_col, text_col, share)


def _similar_classes(docs: DataFrame, words: int, threshold: tuple[int, int], id_col: str, text_col: str, share: float) -> DataFrame:
    num, den = threshold
    docs = id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    seen = checkpointed(_surveyed(docs, words, share))
    common = heavy_values(seen.where("value is not null").select("value", F.col("often").alias("n")))
    rows = seen.where("value is null").select("doc_id", "th", "n", "s1", "s2")
    full = rows.where("n > 0 and doc_id is not null")
    equal = checkpointed(full.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count(F.lit(1)).alias("copies")))
    again = equal.where("copies > 1")
    copies = checkpointed(full.join(again.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).where((F.col("doc_id") != F.col("rep.doc_id")) | (F.col("th") != F.col("rep.th"))).select("doc_id", "th").distinct())
    rep_docs = joined(docs.where("doc_id is not null"), copies, ["doc_id", "th"], "left_anti", copies.count())
    lists = checkpointed(_lists(_entries(rep_docs, words, num, den, common)))
    nodes = equal.select(F.col("s1").alias("node"), "n", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"))

    def texts(ids: DataFrame) -> DataFrame:
        """``node, text`` of the given nodes."""
        wanted = checkpointed(ids.distinct().join(nodes, "node").select("node", "doc_id", "th"))
        return joined(docs.where("doc_id is not null"), wanted, ["doc_id", "th"], "inner", wanted.count()).select("node", "text").dropDuplicates(["node"])

    def linked(d: Column, s: Column) -> Column:
        return d * (num + den) <= s * (den - num)

    def rooted(lists: DataFrame) -> DataFrame:
        """``node, root, n, d, delta, linked``: what the sets of ``lists`` differ in from their roots."""
        sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        weights = lists.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("weight"))
        heads = lists.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("h")).select("key", F.col("h.weight").alias("weight"), F.col("h.node").alias("head"))
        met = lists.join(heads, "key").where("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("met"), F.max("weight").alias("weight"))
        star = checkpointed(met.groupBy("node").agg(F.max(F.struct("met", "weight", "head")).alias("m")).select(F.col("m.head").alias("a"), F.col("node").alias("b"), F.lit(None).cast("long").alias("most")))
        let_go(docs.sparkSession)
        near = _differences(star, texts(star.select(F.col("a").alias("node")).union(star.select("b"))), words).where(F.col("d") * 2 <= F.col("na") + F.col("nb"))
        root_of = _roots(near.select(F.col("b").alias("node"), F.col("a").alias("parent")))
        direct = near.join(root_of.select(F.col("node").alias("b"), F.col("root").alias("a")), ["a", "b"])
        deep = checkpointed(root_of.join(near.select(F.col("a").alias("root"), F.col("b").alias("node")), ["root", "node"], "left_anti").select(F.col("root").alias("a"), F.col("node").alias("b"), F.lit(None).cast("long").alias("most")))
        found = direct.select("a", "b", "na", "nb", "d", "delta")
        if not deep.isEmpty():
            found = found.unionByName(_differences(deep, texts(deep.select(F.col("a").alias("node")).union(deep.select("b"))), words))
        return checkpointed(found.select(F.col("b").alias("node"), F.col("a").alias("root"), F.col("nb").alias("n"), "d", "delta", linked(F.col("d"), F.col("na") + F.col("nb")).alias("linked")))

    let_go(docs.sparkSession)
    members, among = rooted(lists), lists
    for _ in range(REROOTED):
        let_go(docs.sparkSession)
        apart = checkpointed(members.where("not linked").select("node"))
        n = apart.count()
        among = checkpointed(joined(among, apart, "node", "left_semi", n).select("key", "node"))
        crowded = checkpointed(among.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CROWD).select("key"))
        among = checkpointed(joined(among, crowded, "key", "left_semi", crowded.count()))
        if among.isEmpty():
            break
        better = rooted(among).where("linked")
        settled = checkpointed(better.select("node").union(better.select("root")).distinct())
        members = checkpointed(members.join(settled, "node", "left_anti").unionByName(better))
        if 2 * settled.count() < n:  # the others are not alike in themselves
            break
    classes = members.where("linked").select("node", F.col("root").alias("class"))

    let_go(docs.sparkSession)

    # Two sets of one root: prefix index on the differences.
    active = members.join(members.where("not linked").select("root").distinct(), "root", "left_semi")
    tokens = active.select("root", "node", F.explode("delta").alias("token"))
    number = tokens.groupBy("root", "token").agg(F.count(F.lit(1)).alias("number")).where("number > 1")
    ranked = tokens.join(number, ["root", "token"], "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("number", F.lit(1)).alias("number"), "token"))).alias("ranked"))
    most = F.floor((F.col("n") + F.floor(F.col("n") * den / num)) * (den - num) / (den + num) + 1e-9).cast("int") + 1
    prefix = active.select("node", "root", "n", "d", "linked").join(ranked, "node").select("node", "root", "n", "d", "linked", F.posexplode(F.slice("ranked", F.lit(1), most)).alias("pos", "t"))
    prefix = checkpointed(prefix.where("t.number > 1").select("root", F.col("t.token").alias("token"), "node", "n", "d", "linked", "pos"))
    left, right = (prefix.select("root", "token", *[F.col(c).alias(f"{c}_{i}") for c in ("node", "n", "d", "linked", "pos")]) for i in "ab")
    space = (F.col("n_a") + F.col("n_b")) * (den - num)
    alike_sizes = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    fits = (F.col("node_a") < F.col("node_b")) & ~(F.col("linked_a") & F.col("linked_b")) & alike_sizes
    fits &= ((2 * F.col("pos_a") - F.col("d_a") + F.col("d_b")) * (den + num) <= space) & ((2 * F.col("pos_b") - F.col("d_b") + F.col("d_a")) * (den + num) <= space)
    alike = checkpointed(left.join(right, (left["root"] == right["root"]) & (left["token"] == right["token"]) & fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    deltas = [members.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("delta").alias("d" + x)) for x in "ab"]
    within = alike.join(deltas[0], "a").join(deltas[1], "b").where(linked(F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db")), F.col("na") + F.col("nb"))).select("a", "b")

    let_go(docs.sparkSession)

    # Sets of different roots that meet in a list: by the difference of their roots, as far as their own reach.
    placed = lists.select("key", "node").join(members.select("node", "root", "d"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), F.coalesce("d", F.lit(0)).alias("d"))
    placed = checkpointed(placed)
    mixed = checkpointed(placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key"))
    entries = checkpointed(joined(placed, mixed, "key", "left_semi", mixed.count()).join(nodes.select("node", "n"), "node"))
    sides = entries.groupBy("key", "root").agg(F.max("d").alias("d"), F.max("n").alias("n"), F.min("n").alias("least"))
    one, two = (sides.select("key", *[F.col(c).alias(f"{c}_{i}") for c in ("root", "d", "n", "least")]) for i in "ab")
    room = lambda x, y: F.floor((F.col(x) + F.col(y)) * (den - num) / (den + num) + 1e-9)
    meet = (F.col("root_a") < F.col("root_b")) & (F.col("n_a") * den >= F.col("least_b") * num) & (F.col("n_b") * den >= F.col("least_a") * num)
    reach = F.col("d_a") + F.col("d_b") + room("n_a", "n_b")
    both = checkpointed(one.join(two, "key").where(meet).select("key", "root_a", "root_b", "d_a", "n_a", "d_b", "n_b", reach.cast("long").alias("most")))
    heads = checkpointed(both.groupBy("root_a", "root_b").agg(F.max("most").alias("most")).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"), "most"))
    between = _differences(heads, texts(heads.select(F.col("a").alias("node")).union(heads.select("b"))), words).where("delta is not null").select(F.col("a").alias("root_a"), F.col("b").alias("root_b"), F.col("d").alias("gap"), "delta")
    near = checkpointed(both.join(between.select("root_a", "root_b", "gap"), ["root_a", "root_b"]).where("gap <= most").drop("most"))
    ends = []
    for i, j in ("ab", "ba"):
        own = entries.select("key", F.col("root").alias(f"root_{i}"), F.col("node").alias(f"node_{i}"), F.col("n").alias("own_n"), F.col("d").alias("own_d"))
        able = own.join(near, ["key", f"root_{i}"]).where(F.col("own_d") + F.col(f"d_{j}") + room("own_n", f"n_{j}") >= F.col("gap"))
        ends.append(able.select("key", "root_a", "root_b", "gap", f"node_{i}", F.col("own_n").alias(f"size_{i}"), F.col("own_d").alias(f"dist_{i}")))
    sized = (F.least("size_a", "size_b") * den >= F.greatest("size_a", "size_b") * num) & (F.col("dist_a") + F.col("dist_b") + room("size_a", "size_b") >= F.col("gap"))
    cross = ends[0].join(ends[1].drop("gap"), ["key", "root_a", "root_b"]).where(sized).select("node_a", "root_a", "size_a", "node_b", "root_b", "size_b").distinct()
    none = F.array().cast("array<long>")
    apart = [members.select(F.col("node").alias(f"node_{i}"), F.col("delta").alias(f"delta_{i}")) for i in "ab"]
    known = checkpointed(cross).join(between, ["root_a", "root_b"]).join(apart[0], "node_a", "left").join(apart[1], "node_b", "left")
    whole = _xor(_xor(F.col("delta"), F.coalesce("delta_a", none)), F.coalesce("delta_b", none))
    across = known.where(linked(F.size(whole), F.col("size_a") + F.col("size_b"))).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    let_go(docs.sparkSession)

    # Rows with one id are one document.
    shared = full.select("doc_id", "s1").groupBy("doc_id").agg(F.min("s1").alias("a"), F.max("s1").alias("_z")).where("a < _z").select("doc_id", "a")
    shared = full.join(shared, "doc_id").select("a", F.col("s1").alias("b")).distinct()
    for x in "ab":
        within, across, shared = (e.join(classes.select(F.col("node").alias(x), "class"), x, "left").withColumn(x, F.coalesce("class", x)).select("a", "b") for e in (within, across, shared))
    merged = components(within.union(across).union(shared)).select(F.col("node").alias("class"), "component")
    named = equal.select("s1", "s2", "n", F.col("rep.doc_id").alias("doc_id")).join(classes.withColumnRenamed("node", "s1"), "s1", "left").withColumn("class", F.coalesce("class", "s1"))
    named = checkpointed(named.join(merged, "class", "left").select("s1", "s2", "n", F.coalesce("component", "class").alias("component"), "doc_id"))
    by_set = named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("s1", "s2", "n", "component_id")
    out = rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("s1")).alias("s1"), "s2").join(by_set, ["s1", "s2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class; of rows that repeat an id one stays, unless their sets are empty."""
    classes = checkpointed(classes)
    gone = checkpointed(classes.where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct())
    again = checkpointed(classes.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).count().where("count > 1").select(id_col))
    left, n = joined(docs, gone, id_col, "left_anti", gone.count()), again.count()
    if not n:
        return left
    return joined(left, again, id_col, "left_anti", n).unionByName(joined(left, again, id_col, "left_semi", n).dropDuplicates([id_col]))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), words=3, threshold=(90, 100))
