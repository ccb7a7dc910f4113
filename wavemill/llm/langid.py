"""Language identification by Bayesian fusion of evidence.

Of each page come: the log-likelihood of its text under a model of hashed
character n-grams for each language (trained in numpy on a bounded sample of
documents with known language), the language that the markup declares
(``lang=`` or a content-language meta tag), and the suffix, domain and host of
its address.

The likelihood of a text is tempered: it counts as at most ``tempered`` n-grams,
as neighbouring n-grams are far from independent.  How far a declaration or an
address suffix is to be believed is read off grouped counts over all pages
(how often each goes with each language that the texts alone suggest).  The
prior of a host is smoothed towards that of its domain, this towards its
suffix's, and this towards the whole; a page's own text never counts in its
own prior.

Null or empty pages have no text evidence and follow the other sources; null
addresses share one empty host.  Repeated rows count as often as they occur.
Ties between languages go to the first in the alphabet.  Very long pages are
whole; other columns are ignored; an empty table of pages gives no rows, and
without any document of known language every language is null.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, checkpointed, joined, table, trimmed, word_ngrams, words_of_batch

BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
#: Languages of the country suffixes are not listed: their meaning is learned from the counts.


def visible(page: str | None) -> str:
    """Text of a page without tags, scripts, styles and comments."""
    return html_lib.unescape(_DROP.sub(" ", page or ""))


class Model:
    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs


def ngram_counts(texts: list[str]) -> np.ndarray:
    out = np.zeros(BUCKETS)
    ids, words, _ = words_of_batch(pa.array(texts, pa.large_string()))
    if len(ids):
        who, what = word_ngrams(words, SIZES, BUCKETS, whole=False)
        out += np.bincount(what, weights=np.bincount(ids, minlength=len(words))[who], minlength=BUCKETS)
    return out


def modelled(by_language: dict[str, np.ndarray]) -> Model:
    """Log-probability of each bucket under each language, add-half smoothed, as difference from their mean."""
    names = sorted(by_language)
    counts = np.array([by_language[x] for x in names]).reshape(len(names), BUCKETS) + 0.5
    logs = np.log(counts / counts.sum(1, keepdims=True))
    return Model(names, (logs - logs.mean(0)).astype(np.float32) if names else logs)


def fit(docs: DataFrame, per_language: int = 150, max_chars: int = 20_000) -> Model:
    """Train on at most ``per_language`` documents of at most ``max_chars`` characters of each language.

    They are the first in a hashed order of ids.  Their n-grams are counted by
    executors; the driver gets a row of counts for each language.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null")
    short = F.length("text") <= max_chars
    # Each task passes on per_language rows of a language at most before they are ranked.
    ranked = d.where(short).select("lang", "doc_id", F.xxhash64("text").alias("th")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "th")))
    chosen = checkpointed(ranked.where(F.col("r") <= per_language).select("lang", "doc_id", "th").distinct())
    sample = joined(d.withColumn("th", F.xxhash64("text")), chosen, ["lang", "doc_id", "th"], "left_semi", chosen.count())

    def learn(rows: pa.Table) -> pa.Table:
        return pa.table({"lang": [rows.column("lang")[0].as_py()], "counts": pa.array([ngram_counts(rows.column("text").to_pylist()).tobytes()], pa.binary())})

    # A language's sample has per_language * max_chars characters at most (more only where rows repeat).
    got = sample.select("lang", "text").dropDuplicates().groupBy("lang").applyInArrow(learn, "lang string, counts binary").collect()
    names = sorted(r["lang"] for r in d.select("lang").distinct().collect())
    known = {r["lang"]: np.frombuffer(bytes(r["counts"]), np.float64) for r in got}
    return modelled({x: known.get(x, np.zeros(BUCKETS)) for x in names})


def evidence(pages: DataFrame, model: Model, tempered: float = 40.0) -> DataFrame:
    """``page_id, declared, host, domain, suffix, ll array<double>``: what each page says on its own."""
    logs, n_lang = model.logs, len(model.languages)
    url = F.lower(F.coalesce(F.col("url").cast("string"), F.lit("")))
    host = F.regexp_replace(F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), r"\.+$", "")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    head = r"(?is)<(?:html|body)\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b"
    meta = r"(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([a-z]{2,3})\b"
    declared = F.lower(F.coalesce(F.nullif(F.regexp_extract("html", head, 1), F.lit("")), F.regexp_extract("html", meta, 1)))
    parts = F.split("host", "\\.")
    numeric = F.col("host").rlike(r"^[0-9.]*$")
    suffix = F.when(numeric, "").otherwise(F.element_at(parts, -1))
    domain = F.when(numeric | (F.size(parts) < 2), F.col("host")).otherwise(F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1)))
    src = src.withColumn("declared", declared).withColumn("suffix", suffix).withColumn("domain", domain)
    kept = ["page_id", "declared", "host", "domain", "suffix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of(whole, "html"):
                ids, words, offsets = words_of_batch(pa.array(map(visible, b.column("html").to_pylist()), pa.large_string()))
                who, what = word_ngrams(words, SIZES, BUCKETS, whole=False)
                grams = np.bincount(who, minlength=len(words))
                out = np.zeros((b.num_rows, n_lang))
                row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
                n = np.bincount(row, weights=grams[ids], minlength=b.num_rows)
                for k in range(n_lang):
                    word = np.bincount(who, weights=logs[k][what], minlength=len(words))
                    out[:, k] = np.bincount(row, weights=word[ids], minlength=b.num_rows)
                out *= (np.minimum(n, tempered) / np.maximum(n, 1))[:, None]
                ll = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * n_lang, pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), ll], [*kept, "ll"])

    return src.mapInArrow(trimmed(run), "page_id long, declared string, host string, domain string, suffix string, ll array<double>")


def softmax(ll: Column) -> Column:
    shifted = F.transform(ll, lambda x: F.exp(x - F.array_max(ll)))
    return F.transform(F.array(shifted), lambda s: F.transform(s, lambda x: x / F.aggregate(s, F.lit(0.0), lambda a, b: a + b)))[0]


def fuse(seen: DataFrame, languages: list[str], strength: float = 20.0) -> DataFrame:
    """``page_id, lang, probability, text_lang, declared, host`` from ``evidence`` rows."""
    n = len(languages)
    names = F.array(*[F.lit(x) for x in languages])
    best = F.array_position(F.col("ll"), F.array_max("ll")).cast("int") - 1
    said = F.exists("ll", lambda x: x != 0)
    seen = seen.withColumn("vote", F.when(said, best))  # what the text alone suggests
    counts = [F.count(F.when(F.col("vote") == k, 1)).alias(f"c{k}") for k in range(n)]

    def grouped(key: str, prefix: str) -> DataFrame:
        return seen.groupBy(key).agg(*counts).select(key, F.array(*[F.col(f"c{k}") for k in range(n)]).alias(prefix))

    whole = [int(x or 0) for x in seen.agg(*counts).first()]
    total = sum(whole)
    top = F.array(*[F.lit((c + 1) / (total + n)) for c in whole])
    less_own = lambda c: F.transform(F.col(c), lambda x, i: (x - F.when(F.col("vote") == i, 1).otherwise(0)).cast("double"))
    def with_counts(rows: DataFrame, key: str, prefix: str) -> DataFrame:
        """Rows with their key's counts; keys of half a percent of all rows or more (200 at most) are broadcast, so no task gets one key's rows."""
        by, size = grouped(key, prefix), F.aggregate(F.col(prefix), F.lit(0).cast("long"), lambda a, b: a + b)
        sized = checkpointed(by.withColumn("_n", size))
        hot = sized.where((F.col("_n") > 0) & (F.col("_n") * 200 >= total)).select(key, F.col(prefix).alias("_hot"))
        own = F.when(F.col("_hot").isNotNull(), F.concat(F.lit("\0"), F.xxhash64("page_id", "ll").cast("string"))).otherwise(F.col(key))
        rows = rows.join(F.broadcast(hot), key, "left").withColumn("_own", own)
        rows = rows.join(sized.where((F.col("_n") == 0) | (F.col("_n") * 200 < total)).select(F.col(key).alias("_own"), F.col(prefix).alias("_cold")), "_own", "left")
        return rows.withColumn(prefix, F.coalesce("_hot", "_cold")).drop("_own", "_hot", "_cold")

    every = seen
    for key, prefix in (("host", "by_host"), ("domain", "by_domain"), ("suffix", "by_suffix"), ("declared", "by_declared")):
        every = with_counts(every, key, prefix)

    def smoothed(own: Column, above: Column) -> Column:
        return F.transform(F.array(F.aggregate(own, F.lit(0.0), lambda a, b: a + b)), lambda s: F.zip_with(own, above, lambda x, p: (x + strength * p) / (s + strength)))[0]

    # The declared language against the whole: P(language | declaration) / P(language) has the same shape as P(declaration | language).
    every = every.withColumn("_suffix", smoothed(less_own("by_suffix"), top)).withColumn("_domain", smoothed(less_own("by_domain"), F.col("_suffix"))).withColumn("_prior", smoothed(less_own("by_host"), F.col("_domain")))
    told = F.when(F.col("declared") == "", F.array_repeat(F.lit(0.0), n)).otherwise(F.zip_with(smoothed(less_own("by_declared"), top), top, lambda a, b: F.log(a / b)))
    score = F.zip_with(F.zip_with(F.col("ll"), F.transform("_prior", lambda p: F.log(p)), lambda a, b: a + b), told, lambda a, b: a + b)
    out = every.withColumn("_score", score).withColumn("_p", softmax(F.col("_score")))
    at = F.array_position("_p", F.array_max("_p")).cast("int")
    return out.select("page_id", F.element_at(names, at).alias("lang"), F.array_max("_p").alias("probability"), F.when(F.col("vote").isNotNull(), F.element_at(names, F.col("vote") + 1)).alias("text_lang"), "declared", "host")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(table(spark, sf_dir, "documents"))
    return fuse(checkpointed(evidence(table(spark, sf_dir, "pages"), model)), model.languages)
