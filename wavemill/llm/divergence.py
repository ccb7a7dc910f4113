"""Source divergence audit: how the word use of each source differs from the others of its language.

Terms are runs of ASCII letters and non-ASCII characters; only A-Z are lowered.

*First pass.*  Exact document frequencies: each task counts, per language, the
documents that hold a term, and the counts of all tasks are added up.  A
language keeps the terms of at least ``least`` documents.

*Second pass.*  An automaton (pyahocorasick) over the kept terms of a language,
each padded with a delimiter on both sides, runs over the text with every other
character turned into the delimiter, and counts occurrences.  Tasks pass on
sparse postings (language, source, term, count), which the JVM adds up.

The automaton holds the ``automaton`` commonest kept terms at most (200 000,
a few dozen MB in a worker), which are broadcast.  Where more are kept, the
tasks of the second pass also count the words that the automaton does not know,
and these counts meet the other kept terms by a shuffled join.

*Scores.*  With ``V`` kept terms of the language, ``N`` occurrences of kept terms
and ``count`` of them of one term, a group's share of the term is
``1 + floor(10**9 * (count + 5) / (N + 5 * V))``.  Two sources differ by the sum
of the absolute differences of their shares over all kept terms.  Postings are
dealt in blocks of terms and pairs of blocks of sources; each block is a small
matrix, and terms that neither source has are accounted for by their number.
The rows of pairs are as many as the result has: each source of a language
against each other.

Null text, language or source is ``''``.  Rows count as documents, repeated ones
as often as they occur.  A group without terms has count 0 of each.  A language
without kept terms has pairs of value 0 and no terms.  Equal values are ranked
by the bytes of the item.  Very long texts are whole; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, checkpointed, joined, least_count, table, trimmed

#: Every byte that is no ASCII letter and no part of a non-ASCII character becomes a space; A-Z become a-z.
_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Entries that a task counts before it passes them on.
HELD = 400_000
#: Terms, and sources, of one matrix.
TERM_BLOCK, SOURCE_BLOCK = 256, 128


def grouped_texts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))


def spaced(texts: pa.Array) -> list[bytes]:
    """Texts as bytes, lowered, with a space for each delimiter byte."""
    return [t.translate(_SPACED) for t in texts.cast(pa.binary()).to_pylist()]


def frequencies(rows: DataFrame) -> DataFrame:
    """``lang, term, n``: the number of documents of a language that hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            cols = [pa.array([k for k, c in held.items() for _ in c], pa.string()), pa.array([t for c in held.values() for t in c], pa.binary()), pa.array([n for c in held.values() for n in c.values()], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, ["lang", "term", "n"])

        for whole in batches:
            for b in batches_of(whole, "text", 4 << 20):
                for lang, text in zip(b.column("lang").to_pylist(), spaced(b.column("text"))):
                    held.setdefault(lang, Counter()).update(set(text.split()))
                if sum(map(len, held.values())) > HELD:
                    yield out()
        yield out()

    counted = rows.select("lang", "text").mapInArrow(trimmed(run), "lang string, term binary, n long")
    return counted.groupBy("lang", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"))


class Automaton:
    """Kept terms of one language, padded with the delimiter; counts those in a text by their numbers."""

    def __init__(self, terms: list[tuple[str, int]]):
        self.words = {t.encode() for t, _ in terms}
        self.found = ahocorasick.Automaton()
        for term, number in terms:
            self.found.add_word(f" {term} ", number)
        self.found.make_automaton()

    def count(self, text: bytes) -> Counter:
        """Occurrences by number; neighbours share the delimiter between them."""
        return Counter(map(itemgetter(1), self.found.iter(f" {text.decode(errors='surrogateescape')} "))) if self.words else Counter()


#: By language, the automata of the list that the worker had last.
_BUILT: dict = {"of": None}


def _automaton(lists: dict[str, list[tuple[str, int]]], lang: str) -> Automaton:
    if _BUILT["of"] is not lists:
        _BUILT.clear()
        _BUILT["of"] = lists
    if (key := ("lang", lang)) not in _BUILT:
        _BUILT[key] = Automaton(lists.get(lang, []))
    return _BUILT[key]


def _sparse(counts: dict[tuple[str, str], Counter], by_id: bool) -> pa.RecordBatch:
    """Counts as rows; ``counts`` is empty then."""
    lang, source = (pa.array([g[i] for g, c in counts.items() for _ in c], pa.string()) for i in (0, 1))
    what, n = ([x for c in counts.values() for x in f(c)] for f in (Counter.keys, Counter.values))
    counts.clear()
    none = pa.nulls(len(n), pa.binary() if by_id else pa.int64())
    pair = [pa.array(what, pa.int64()), none] if by_id else [none, pa.array(what, pa.binary())]
    return pa.RecordBatch.from_arrays([lang, source, *pair, pa.array(n, pa.int64())], ["lang", "source", "id", "term", "n"])


def occurrences(rows: DataFrame, known: DataFrame, others: bool) -> DataFrame:
    """``lang, source, id, term, n``, checkpointed: counts of the ``known`` terms (``lang, id, term``, a bounded number) by id, if wanted those of all other words by term, and each group's documents as id -1."""
    lists: dict[str, list[tuple[str, int]]] = {}
    for r in known.toLocalIterator():
        lists.setdefault(r["lang"], []).append((r["term"], r["id"]))
    held = rows.sparkSession.sparkContext.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        rest: dict[tuple[str, str], Counter] = {}
        for whole in batches:
            for b in batches_of(whole, "text", 4 << 20):
                for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), spaced(b.column("text"))):
                    a, mine = _automaton(held.value, lang), counts.setdefault((lang, source), Counter())
                    mine[-1] += 1
                    mine.update(a.count(text))
                    if others:
                        rest.setdefault((lang, source), Counter()).update(w for w in text.split() if w not in a.words)
                if sum(map(len, counts.values())) + sum(map(len, rest.values())) > HELD:
                    yield _sparse(counts, True)
                    yield _sparse(rest, False)
        yield _sparse(counts, True)
        yield _sparse(rest, False)

    found = rows.mapInArrow(trimmed(run), "lang string, source string, id long, term binary, n long")
    found = checkpointed(found.groupBy("lang", "source", "id", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n")))
    held.destroy()
    return found


def share(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(10**9 * (count + 5) / (n + 5 * v))`` of whole numbers, exactly; 0 without kept terms."""
    parts = [c.cast("decimal(20,0)") for c in (count + 5, n + 5 * v)]
    return F.when(v > 0, F.call_function("div", parts[0] * F.lit(1_000_000_000).cast("decimal(10,0)"), parts[1]) + 1).otherwise(0).cast("long")


def postings(docs: DataFrame, least: int = 30, automaton: int = 200_000, **columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept terms ``lang, id, term``; groups ``lang, source, total, v`` with the occurrences of kept terms and their number; postings ``lang, source, id, n``."""
    rows = grouped_texts(docs, **columns)
    kept = checkpointed(frequencies(rows).where(F.col("n") >= least).select("lang", "term", "n"))
    # Numbered within buckets, so that no task numbers all: the order of ids has no meaning.
    spot = F.pmod(F.xxhash64("lang", "term"), F.lit(1 << 12))
    numbered = kept.withColumn("spot", spot).withColumn("id", F.col("spot") + F.lit(1 << 12) * (F.row_number().over(Window.partitionBy("spot").orderBy("lang", "term")).cast("long") - 1))
    kept = checkpointed(numbered.select("lang", "id", "term", "n"))
    total = kept.count()
    known = kept if total <= automaton else checkpointed(kept.where(F.col("n") >= least_count(kept, automaton)))
    counts = checkpointed(occurrences(rows, known.select("lang", "id", "term"), total > automaton))
    found = counts.where("id >= 0").select("lang", "source", "id", "n")
    if total > automaton:
        other = kept.join(known.select("id"), "id", "left_anti").select("lang", "term", "id")
        found = found.unionByName(counts.where("id is null").drop("id").join(other, ["lang", "term"]).select("lang", "source", "id", "n"))
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    seen = counts.where("id = -1").select("lang", "source", F.lit(0).cast("long").alias("n")).unionByName(found.select("lang", "source", "n"))
    groups = seen.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(v, "lang", "left").select("lang", "source", "total", F.coalesce("v", F.lit(0)).cast("long").alias("v"))
    return kept.select("lang", "id", "term"), checkpointed(groups), found


def _block_sums(shares: DataFrame) -> DataFrame:
    """``lang, a, b, zero_a, zero_b, f, terms`` of each block: the sum of differences over its terms that ``a``, ``b`` or a neighbour has, and their number.

    ``shares`` has ``lang, k, i, j`` (the block of terms and the pair of blocks of
    sources), ``source``, ``block`` (its own), ``zero`` (its share of a term that it
    has not), and ``id, p`` of a posting or nulls: every source of both blocks
    has a row of nulls.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        names = t.column("source").combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        at, names = np.asarray(names.indices), names.dictionary.to_pylist()
        zero, block = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        zero[at], block[at] = np.asarray(t.column("zero")), np.asarray(t.column("block"))
        full = np.asarray(t.column("id").is_valid())
        ids, row = np.unique(np.asarray(t.column("id").filter(pa.array(full))), return_inverse=True)
        p = np.repeat(zero[None, :], len(ids), 0)
        p[row, at[full]] = np.asarray(t.column("p").filter(pa.array(full)))
        i, j = key[2].as_py(), key[3].as_py()
        left, right = (sorted(np.flatnonzero(block == x).tolist(), key=names.__getitem__) for x in (i, j))
        out = [], [], [], [], []
        for n, x in enumerate(left):
            others = right[n + 1 :] if i == j else right
            f = np.abs(p[:, others] - p[:, [x]]).sum(0)
            for c, values in zip(out, ([names[x]] * len(others), [names[y] for y in others], [zero[x]] * len(others), zero[others].tolist(), f.tolist())):
                c.extend(values)
        m = len(out[0])
        lang = pa.array([key[0].as_py()] * m, pa.string())
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([lang, *(pa.array(c, k) for c, k in zip(out, kinds)), pa.array([len(ids)] * m, pa.int64())], ["lang", "a", "b", "zero_a", "zero_b", "f", "terms"])

    return shares.groupBy("lang", "k", "i", "j").applyInArrow(run, "lang string, a string, b string, zero_a long, zero_b long, f long, terms long")


def pair_values(groups: DataFrame, found: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of each source and each other source of its language."""
    sizes = checkpointed(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s")))
    g = joined(groups, sizes, "lang", "inner", sizes.count())
    blocks = F.ceil(F.col("s") / SOURCE_BLOCK).cast("long")
    term_blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / TERM_BLOCK)).cast("long")
    zero = share(F.lit(0).cast("long"), F.col("total"), F.col("v"))
    g = checkpointed(g.select("lang", "source", "total", "v", zero.alias("zero"), blocks.alias("blocks"), term_blocks.alias("term_blocks"), F.pmod(F.xxhash64("source"), blocks).alias("block")))
    own = joined(found, g, ["lang", "source"], "inner", g.count())
    has = own.select("lang", F.pmod("id", "term_blocks").alias("k"), "source", "block", "blocks", "zero", "id", share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    every = g.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)).alias("k"), "source", "block", "blocks", "zero", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("p"))
    dealt = has.unionByName(every).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "source", "block", "zero", "id", "p")
    sums = _block_sums(dealt).groupBy("lang", "a", "b", "zero_a", "zero_b").agg(F.sum("f").alias("f"), F.sum("terms").alias("terms"))
    v = g.groupBy("lang").agg(F.max("v").alias("v"))
    pairs = joined(sums, v, "lang", "inner", sizes.count()).withColumn("value", F.col("f") + (F.col("v") - F.col("terms")) * F.abs(F.col("zero_a") - F.col("zero_b")))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return pairs.select("lang", "value", both.alias("x")).select("lang", "x.source", "x.item", "value")


def term_values(kept: DataFrame, groups: DataFrame, found: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of the terms that a source uses more than its language does."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    all_n = found.groupBy("id").agg(F.sum("n").alias("n"))
    terms = kept.join(all_n, "id")
    q = checkpointed(joined(terms, whole, "lang", "inner", whole.count()).select("id", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("v")).alias("q")))
    p = joined(found, groups, ["lang", "source"], "inner", groups.count()).select("lang", "source", "id", share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    return joined(p, q, "id", "inner", q.count()).where("p > q").select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))


def audit(docs: DataFrame, least: int = 30, top: int = 50, automaton: int = 200_000, **columns: str) -> DataFrame:
    """``lang, source, part, item, value long, rank int``: part ``pair`` whole, part ``term`` to rank ``top``; ``columns`` as for ``grouped_texts``."""
    kept, groups, found = postings(docs, least, automaton, **columns)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(groups, found).withColumn("rank", rank)
    terms = term_values(kept, groups, found).withColumn("rank", rank).where(F.col("rank") <= top)
    parts = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
