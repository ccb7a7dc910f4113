"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0).  The number of documents
with each pattern of votes is counted over the whole corpus; the patterns are
at most 3^rules, whatever the corpus holds.  Expectation-maximisation over
these counts estimates for every rule how often it votes good, bad or not at
all on good and on bad documents (its accuracies), and the share of good
documents.  A document is kept when its posterior probability of being good
reaches ``keep_at``.

Null or empty text: no words, all counts 0, ``base_failed`` true.  Repeated
rows are judged alike.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, checkpointed, id_text, table, trimmed

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_alpha", "n_marks", "n_distinct", "n_lines"]


def measure(text: str | None) -> tuple[int, ...]:
    """The figures of one text, in the order of ``_FIELDS``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    distinct = len(set(words))
    if n > 3 and distinct < n:
        code: dict[bytes, int] = {}
        ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
        _, pair = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
        _, window, counts = np.unique(pair[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
        again = counts[window] > 1
        if again.any():
            inside = np.zeros(n, bool)
            for k in range(3):
                inside[k : n - 2 + k] |= again
            repeated = int(inside.sum())
    upper = sum(1 for c in text if c.isupper()) if not text.isascii() else len(text) - len(text.translate(_NO_UPPER))
    alpha = sum(map(str.isalpha, text)) if not text.isascii() else len(text) - len(text.translate(_NO_ALPHA))
    marks = text.count("!") + text.count("?")
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, upper, alpha, marks, distinct, len(lines)


_NO_UPPER = {i: None for i in range(65, 91)}
_NO_ALPHA = _NO_UPPER | {i: None for i in range(97, 123)}


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the figures of every whole text (all long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of(whole, "text"):
                rows = np.array([measure(t) for t in b.column("text").to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(_FIELDS)))], ["doc_id", *_FIELDS])

    return id_text(docs, id_col, text_col).mapInArrow(trimmed(run), "doc_id long, " + ", ".join(f"{f} long" for f in _FIELDS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Name -> vote.  Ratios are compared as products of whole numbers."""
    w, c = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": _vote(F.col("n_symbols") * 50 > c, F.col("n_symbols") * 500 < c),
        "symbols_per_word": _vote(F.col("n_symbols") * 4 > w, F.lit(False)),
        "case": _vote(F.col("n_upper") * 10 > F.col("n_alpha") * 4, F.col("n_upper") * 10 < F.col("n_alpha") * 2),
        "marks": _vote(F.col("n_marks") * 4 > w, F.col("n_marks") * 20 < w),
        "repeats": _vote(F.col("n_repeat_words") * 10 > w * 3, F.col("n_repeat_words") * 20 < w),
        "dup_lines": _vote(F.col("n_dup_lines") * 10 > F.col("n_lines") * 3, F.lit(False)),
        "letters": _vote(F.col("n_alpha") * 10 < c * 7, F.col("n_alpha") * 10 > c * 9),
        "word_length": _vote((c > w * 15) | (c * 10 < w * 22), (c < w * 11) & (c > w * 3)),
        "length": _vote(w < 20, w >= 80),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, pseudo: float = 1.0) -> dict:
    """Two-class latent model of vote patterns by expectation-maximisation.

    It starts from the belief that a bad vote means a bad document, and
    never lets a rule's bad vote count for the good class: the likelihood
    ratio of each outcome keeps the sign of the vote.
    """
    n, r = patterns.shape
    post = np.where((patterns < 0).any(1), 0.1, 0.9)
    total = counts.sum()
    share, theta = 0.5, np.full((r, 2, 3), 1 / 3)
    for _ in range(rounds):
        for y in (0, 1):
            w = counts * (post if y else 1 - post)
            for v in (-1, 0, 1):
                theta[:, y, v + 1] = (w @ (patterns == v)) + pseudo
        theta /= theta.sum(2, keepdims=True)
        wrong = theta[:, 1, 0] > theta[:, 0, 0]
        theta[wrong, :, 0] = theta[wrong, :, 0].mean(1, keepdims=True)
        wrong = theta[:, 1, 2] < theta[:, 0, 2]
        theta[wrong, :, 2] = theta[wrong, :, 2].mean(1, keepdims=True)
        share = float(np.clip((counts @ post + pseudo) / (total + 2 * pseudo), 0.01, 0.99))
        new = posterior({"share": share, "theta": theta}, patterns)
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return {"share": share, "theta": theta}


def posterior(model: dict, patterns: np.ndarray) -> np.ndarray:
    """Probability of a good document for each pattern of votes."""
    at = np.arange(patterns.shape[1])
    log = [np.log(model["theta"][at, y, patterns + 1]).sum(1) for y in (0, 1)]
    odds = log[1] - log[0] + np.log(model["share"] / (1 - model["share"]))
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def judge(docs: DataFrame, keep_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the figures, ``votes``, ``posterior double``, ``base_failed``, ``kept``."""
    spark = docs.sparkSession
    named = rules()
    seen = checkpointed(features(docs, id_col, text_col).withColumn("votes", F.array(*named.values())))
    counted = seen.groupBy("votes").count().collect()  # at most 3^rules rows
    if not counted:
        return seen.select("*", F.lit(0.0).alias("posterior"), base_failed().alias("base_failed"), F.lit(False).alias("kept"))
    patterns = np.array([r["votes"] for r in counted], dtype=np.int64)
    order = np.lexsort(patterns.T)
    patterns, counts = patterns[order], np.array([r["count"] for r in counted], dtype=float)[order]
    model = fit(patterns, counts)
    known = spark.createDataFrame([([int(v) for v in p], float(q)) for p, q in zip(patterns, posterior(model, patterns))], "votes array<int>, posterior double")
    return seen.join(F.broadcast(known), "votes").select("doc_id", *_FIELDS, "votes", "posterior", base_failed().alias("base_failed"), (~base_failed() & (F.col("posterior") >= keep_at)).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
