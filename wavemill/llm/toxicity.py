"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its hashed character n-grams (and of the
whole word), so an unseen misspelling shares most of its vectors with the word
it stands for.  The vectors of a window of words are averaged and go into a
softmax; a document's score is that of its highest window, so a short insult
in a long text is not averaged away.  Vectors and softmax are trained jointly
in numpy on a bounded sample of labelled documents (``max_docs`` per class and
``max_chars`` in all, both parameters).  Scoring covers whole texts.

A text without words (null, empty, white space) scores as the zero vector: the
softmax of the biases.  Rows are scored one by one, so repeated rows, ties and
other columns have no influence.

Without any usable labelled row (no labels, labels of other ids only, all of
them held out) there is nothing to learn from and nothing is called toxic:
every document gets the score of clean labels only, about 0.018.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import batches_of, table, trimmed, word_ngrams, words_of_batch

BUCKETS = 1 << 17
SIZES = (3, 4, 5, 6)
WINDOW = 12
#: The bias of a model that saw clean labels only, or none.
CLEAN = -4.0


class Model:
    """``vectors[BUCKETS, dims]``, ``softmax[dims, 2]``, ``bias[2]``; ``trained`` unless there was no row to learn from."""

    trained = True

    def __init__(self, dims: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (BUCKETS, dims)).astype(np.float32)
        self.softmax = rng.normal(0, 0.3, (dims, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def collapsed(self) -> tuple[np.ndarray, float]:
        """By linearity, each n-gram's share of the difference of the two logits, and the bias."""
        return self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0]), float(self.bias[1] - self.bias[0])


class Windows:
    """All windows of all rows with words, by row; rows without words have none."""

    def __init__(self, offsets: np.ndarray):
        lens = np.diff(offsets)
        size = np.minimum(lens, WINDOW)
        count = np.where(lens > 0, lens - size + 1, 0)
        before = np.cumsum(count) - count
        self.start = np.repeat((offsets[:-1] - before).astype(np.int32), count) + np.arange(count.sum(), dtype=np.int32)  # a slice's words
        self.length = np.repeat(size.astype(np.int32), count)
        self.rows = np.flatnonzero(count)
        self.first, self.count = before[self.rows], count[self.rows]

    def means(self, scores: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
        return (total[self.start + self.length] - total[self.start]) / self.length

    def best(self, values: np.ndarray) -> np.ndarray:
        """For each of ``rows`` the index of its first highest window."""
        if not len(self.rows):
            return self.rows
        top = np.maximum.reduceat(values, self.first)
        hit = np.flatnonzero(values == np.repeat(top, self.count))
        owner = np.searchsorted(self.first, hit, side="right") - 1
        return hit[np.unique(owner, return_index=True)[1]]


def train(texts: list[str], labels: np.ndarray, epochs: int = 120, warm: int = 20, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Joint training with AdaGrad; after ``warm`` epochs on whole texts only each text's highest window learns."""
    model = Model()
    if not len(texts) or labels.min() == labels.max():
        if len(texts):
            model.bias[:] = (-2, 2) if labels[0] else (2, -2)
        model.vectors[:] = 0
        model.trained = len(texts) > 0
        return model
    ids, words, offsets = words_of_batch(pa.array(texts, pa.large_string()))
    who, what = word_ngrams(words, SIZES, BUCKETS)
    per_word = np.bincount(who, minlength=len(words)).astype(np.float64)
    y = labels.astype(np.float64)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    lens = np.diff(offsets)
    row_of = np.repeat(np.arange(len(texts)), lens)
    windows = Windows(offsets)
    rows = windows.rows
    seen = np.full(BUCKETS, 1e-10)
    seen_w, seen_b = 1e-10, 1e-10
    for epoch in range(epochs):
        diff = model.softmax[:, 1] - model.softmax[:, 0]
        gram, bias = model.vectors @ diff, float(model.bias[1] - model.bias[0])
        word = np.bincount(who, weights=gram[what], minlength=len(words)) / np.maximum(per_word, 1)
        score = word[ids]
        if epoch < warm:
            mean = np.bincount(row_of, weights=score, minlength=len(texts)) / np.maximum(lens, 1)
            wrong = (1 / (1 + np.exp(-np.clip(mean * 4 + bias, -50, 50))) - y) * weight
            at, push = ids, (wrong / np.maximum(lens, 1) * 4)[row_of]
            bias_push = wrong.sum()
        else:
            value = windows.means(score)
            pick = windows.best(value)
            wrong = (1 / (1 + np.exp(-np.clip(value[pick] + bias, -50, 50))) - y[rows]) * weight[rows]
            span = windows.length[pick]
            spread = np.repeat(windows.start[pick] - (np.cumsum(span) - span), span) + np.arange(span.sum())
            at, push = ids[spread], np.repeat(wrong / span, span)
            bias_push = wrong.sum()
        by_word = np.bincount(at, weights=push, minlength=len(words)) / np.maximum(per_word, 1)
        by_gram = np.bincount(what, weights=by_word[who], minlength=BUCKETS)
        down = by_gram @ model.vectors
        seen += by_gram**2
        seen_w += float(down @ down)
        seen_b += bias_push**2
        step = rate * by_gram / np.sqrt(seen)
        model.vectors -= (step[:, None] * diff[None, :] / max(np.linalg.norm(diff), 1e-6)).astype(np.float32)
        model.vectors *= 1 - decay
        model.softmax[:, 1] -= (0.1 * down / np.sqrt(seen_w)).astype(np.float32)
        model.softmax[:, 0] += (0.1 * down / np.sqrt(seen_w)).astype(np.float32)
        shift = 0.2 * bias_push / np.sqrt(seen_b)
        model.bias += np.array([shift / 2, -shift / 2], np.float32)
    return model


def score_texts(texts: pa.Array, gram: np.ndarray, bias: float) -> np.ndarray:
    ids, words, offsets = words_of_batch(texts)
    logit = np.full(len(texts), bias)
    if len(ids):
        who, what = word_ngrams(words, SIZES, BUCKETS)
        word = np.bincount(who, weights=gram[what], minlength=len(words)) / np.bincount(who, minlength=len(words))
        windows = Windows(offsets)
        value = windows.means(word[ids])
        logit[windows.rows] += value[windows.best(value)]
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 1500, max_chars: int = 10_000_000) -> Model:
    """Train on the labelled rows that are not held out.

    The sample: of each class the ``max_docs`` rows first in a hashed order,
    then in that order as long as all their texts have ``max_chars``
    characters at most.  Rows with a null id, label or text are not used.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    order = [F.xxhash64(F.col("doc_id")), F.col("doc_id")]
    some = [rows.where(F.col("toxic") == k).dropDuplicates(["doc_id"]).orderBy(*order).limit(max_docs) for k in (0, 1)]
    sample = F.broadcast(some[0].unionByName(some[1]))  # 2 * max_docs rows at most
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    joined = text.join(sample, "doc_id")
    sizes = joined.select("doc_id", "toxic", F.length("text").alias("n")).orderBy(*order, "toxic", "n").limit(4 * max_docs).collect()
    chosen, total = set(), 0
    for r in sizes:
        if total + r["n"] <= max_chars:
            total += r["n"]
            chosen.add(r["doc_id"])
    if not chosen:
        return train([], np.zeros(0))
    # One task on an executor trains on the bounded sample, so the driver holds the model only; a lost task is run again.
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(chosen)], "doc_id long")
    rows = joined.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text").repartition(1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)).sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
        model = train(got.column("text").to_pylist(), got.column("toxic").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.vectors, model.softmax, model.bias)], ["vectors", "softmax", "bias"])

    row, model = rows.mapInArrow(trimmed(learn), "vectors binary, softmax binary, bias binary").first(), Model()
    for name in ("vectors", "softmax", "bias"):
        old = getattr(model, name)
        setattr(model, name, np.frombuffer(bytes(row[name]), np.float32).reshape(old.shape).copy())
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Every column of ``docs`` and ``out``, a double from 0 to 1; an equally named column is replaced.

    An untrained model calls nothing toxic.
    """
    gram, bias = model.collapsed()
    bias = bias if model.trained else CLEAN
    docs = docs.drop(out)
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast((gram.astype(np.float32), bias))  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, b0 = held.value
        for whole in batches:
            for b in batches_of(whole, text_col, 1 << 20):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_texts(b.column(text_col), g, b0), pa.float64())], [*names, out])

    return docs.mapInArrow(trimmed(run), StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
