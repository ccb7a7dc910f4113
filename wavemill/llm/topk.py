"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are whole numbers; a dimension is a term and the candidates' non-zero
components in it are its postings.  Queries and candidates are dealt into
blocks of bounded size; each pair of blocks is one group: for every term the
queries that have it scatter ``query weight * posting weight`` into a dense
score array, then selection by partition keeps ``k`` candidates of the block,
and a merge ranks what the blocks kept.  Every candidate is scored; ties go to
the smaller id.

Scores are exact whatever the components: those of pairs that 64 bits might not
hold are computed with Python's integers, pair by pair.  Only where a score that
is to be returned leaves 64 bits the query ends with an error.

Vectors that are null or hold null, NaN or infinite components take no part;
those without any component score 0.  Other columns are ignored; an empty table
gives no rows.  Vectors of unlike length score over their common dimensions.  A
repeated candidate row counts once per row; a repeated query id ranks the
candidates of all its rows together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .vafile import matrix, usable

#: Bytes of the components of a block of queries and of candidates, on average; and rows of one that is not made smaller to keep more tasks busy.
QUERY_BYTES, CANDIDATE_BYTES, SMALL_BLOCK = 4 << 20, 16 << 20, 2048
#: Products and sums below this are exact in 64 bits.
SAFE = float(1 << 62)


def _sizes(m: np.ndarray) -> np.ndarray:
    """The largest component of each row, without its sign."""
    return np.abs(m).max(1, initial=0).astype(np.float64) if m.size else np.zeros(len(m))


def _in_64_bits(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    """As 64-bit integers; rows that have larger ones are zero."""
    return np.where((size < SAFE)[:, None], m, 0).astype(np.int64)


def block_top(queries: np.ndarray, query_ids: np.ndarray, cands: np.ndarray, cand_ids: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """``query_id, vec_id, score`` of each query row's best ``k`` candidates in the block; components are whole numbers of any size."""
    order = np.argsort(cand_ids, kind="stable")
    cands, cand_ids = cands[order], cand_ids[order]
    query_size, cand_size = _sizes(queries), _sizes(cands)
    small, largest, width = _in_64_bits(cands, cand_size), cand_size.max(initial=0), max(1, cands.shape[1])
    postings = []
    for t in range(cands.shape[1]):
        at = np.flatnonzero(small[:, t])
        full = len(at) == len(cand_ids)
        postings.append((slice(None) if full else at, small[:, t].copy() if full else small[at, t]))
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    dense = np.empty(len(cand_ids), np.int64)
    for i, row in enumerate(_in_64_bits(queries, query_size)):
        most = SAFE / (width * max(1.0, query_size[i])) if query_size[i] < SAFE else 0.0
        dense[:] = 0
        for t in np.flatnonzero(row):
            at, weight = postings[t]
            dense[at] += row[t] * weight  # wraps around only for the pairs that are computed anew below
        own = cand_ids != query_ids[i]
        wide = np.zeros(0, np.int64)
        if largest >= most:
            wide = np.flatnonzero(own & (cand_size >= most))
            own = own & (cand_size < most)
        scores, ids = (dense, cand_ids) if own.all() else (dense[own], cand_ids[own])
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            above = np.flatnonzero(scores > least)
            equal = np.flatnonzero(scores == least)[: k - len(above)]  # ids ascend
            take = np.concatenate([above, equal])
            scores, ids = scores[take], ids[take]
        best = list(zip(scores.tolist(), ids.tolist()))
        if len(wide):
            mine = [int(x) for x in queries[i].tolist()]
            best += [(sum(a * int(b) for a, b in zip(mine, cands[j].tolist())), int(cand_ids[j])) for j in wide]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        out[0].extend([int(query_ids[i])] * len(best))
        out[1].extend(v for _, v in best)
        out[2].extend(s for s, _ in best)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id, rank int, vec_id, score long``; ``is_query`` is a condition on ``vec_id``."""
    v = usable(vectors, id_col, vec_col, None).where("vec_id is not null").select("vec_id", "v")
    n = v.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size("v")).alias("w")).first()
    row = 8 * max(1, n["w"] or 0)
    query_blocks, blocks = max(1, math.ceil(n["q"] * row / QUERY_BYTES)), max(1, math.ceil(n["n"] * row / CANDIDATE_BYTES))
    blocks = max(blocks, min(vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(n["n"] / SMALL_BLOCK)))
    # Dealt by id and content: rows that repeat an id but not its vector part as well.
    place = F.xxhash64("vec_id", "v")
    left = v.where(is_query).withColumn("qb", F.pmod(place, F.lit(query_blocks))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = v.withColumn("cb", F.pmod(place, F.lit(blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score", "beyond")])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        both = [t.column("v").combine_chunks() for t in (a, b)]
        both = [c if not isinstance(c, pa.ChunkedArray) else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in both]
        width = max([1, *(int(np.diff(np.asarray(c.offsets)).max(initial=0)) for c in both)])
        q, vec, score = block_top(matrix(both[0], width, scale), np.asarray(a.column("vec_id")), matrix(both[1], width, scale), np.asarray(b.column("vec_id")), k)
        # What 64 bits do not hold stands above or below everything else; it is an error only if it is to be returned.
        beyond = [(s >= 1 << 63) - (s < -(1 << 63)) for s in score]
        cols = q, vec, [0 if x else s for s, x in zip(score, beyond)], beyond
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(schema.names, cols)})

    columns = [F.col("cb").cast("long").alias("cb"), F.col("qb").cast("long").alias("qb"), "vec_id", "v"]
    part = left.select(*columns).groupBy("cb", "qb").cogroup(right.select(*columns).groupBy("cb", "qb")).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), "vec_id"))
    told = F.when(F.col("beyond") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit 64 bits")).cast("long"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", told.alias("score"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
