"""Packing by optimal length buckets.

The lengths of all documents are counted in a global histogram.  Dynamic
programming over it chooses the bucket boundaries that minimise the padding
when every document is padded to the boundary of its bucket.  Inside a bucket
all padded lengths are equal, so a batch holds ``budget // boundary`` documents
(one at least): token-budget batches are runs of that many documents in a
fixed hashed order.

The order is global but nothing is collected for it: documents are dealt to
shards by a hash of the id, numbered in their shard, and the shards' counts
(buckets * shards rows) give each shard's first number.

Every length is counted exactly, so the padding is the least that any choice
of boundaries gives.  A length is a text's number of byte-level BPE tokens.  The
histogram has a row per distinct length, as many as tokens in the longest text
at most.  Very long texts are whole; other columns are ignored.  Null or empty
text has length 0.  Repeated rows are packed each for itself, in an order by
id and length; equal rows may swap places.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import counts
from .common import checkpointed, table

BUCKETS = 16
BUDGET = 16_384


def word_count(text: Column) -> Column:
    """Number of white-space separated words, a cheaper length than the default."""
    bare = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "\x01")
    return F.length(F.translate(bare, " \t\n\x0b\x0c\r", "")).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over ascending lengths with the least padding in all.

    cost(i, j] = L_j * (N_j - N_i) - (S_j - S_i) with running counts N and
    sums S.  For a fixed number of buckets the best start moves right as the
    end does, so each row of the table is filled by divide and conquer.
    Ties go to the smaller start.
    """
    m = len(lengths)
    if not m:
        return []
    length = lengths.astype(object) if lengths.max() > 1 << 40 else lengths.astype(np.int64)
    n = np.concatenate([[0], np.cumsum(counts)])
    s = np.concatenate([[0], np.cumsum(counts * length)])
    best = np.concatenate([[0], np.full(m, np.iinfo(np.int64).max // 4)]).astype(np.int64)
    starts = []
    for _ in range(min(buckets, m)):
        now, frm = best.copy(), np.arange(m + 1)
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, a, z = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(z, mid - 1) + 1)
            cost = best[i] + length[mid - 1] * (n[mid] - n[i]) - (s[mid] - s[i])
            k = int(i[np.argmin(cost)])
            now[mid], frm[mid] = cost.min(), k
            todo += [(lo, mid - 1, a, k), (mid + 1, hi, k, z)]
        starts.append(frm)
        best = now
    out, j = [], m
    for frm in reversed(starts):
        if j <= 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(frm[j])
    return sorted(set(out))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """``doc_id, n_tokens, bucket int, padded_to, padding, batch_id long, slot int``, one row per document.

    ``batch_id`` is unique over all buckets: batches of shorter buckets come
    first.  A batch holds at most ``budget`` padded tokens, or one document.
    ``length`` is the length of a row; by default its text's tokens are counted.
    """
    spark = docs.sparkSession
    if length is None:
        sized = checkpointed(counts(docs, id_col=id_col, text_col=text_col))
    else:
        sized = checkpointed(docs.select(F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("n_tokens")))
    seen = sorted((r["n_tokens"], r["count"]) for r in sized.groupBy("n_tokens").count().collect())  # one row per distinct length
    total = sum(c for _, c in seen)
    cuts = boundaries(np.array([a for a, _ in seen], dtype=np.int64), np.array([c for _, c in seen], dtype=np.int64), buckets)
    # 16 * 1024 rows of counts at most
    shards = shards or min(1024, max(8, math.ceil(total / 200_000)))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array(F.lit(0).cast("long"))
    bucket = F.size(F.filter(bounds, lambda b: b < F.col("n_tokens"))).cast("int")
    shard = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).cast("int")
    placed = sized.withColumn("bucket", bucket).withColumn("shard", shard)
    per = {}
    for r in placed.groupBy("bucket", "shard").count().collect():
        per[r["bucket"], r["shard"]] = r["count"]
    rows, first_batch = [], 0
    for b, cut in enumerate(cuts):
        size, before = max(1, budget // max(1, cut)), 0
        for k in range(shards):
            if (b, k) in per:
                rows.append((b, k, cut, size, before, first_batch))
                before += per[b, k]
        first_batch += math.ceil(before / size)
    offsets = spark.createDataFrame(rows, "bucket int, shard int, padded_to long, size long, before long, first_batch long")
    w = Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")
    numbered = placed.withColumn("r", F.row_number().over(w) - 1).join(F.broadcast(offsets), ["bucket", "shard"])
    place = F.col("before") + F.col("r")
    return numbered.select(
        "doc_id", "n_tokens", "bucket", "padded_to", (F.col("padded_to") - F.col("n_tokens")).alias("padding"),
        (F.col("first_batch") + F.floor(place / F.col("size"))).cast("long").alias("batch_id"), F.pmod(place, F.col("size")).cast("int").alias("slot"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
