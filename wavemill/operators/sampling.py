"""Deterministic samples, limits and pairings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def numbered_spread(df: DataFrame, by: str, key: str, name: str = "rn", buckets: int = 1024) -> DataFrame:
    """Dense numbers from 1 within groups of any size, in no meaningful order.

    Rows are numbered within hashed buckets of a group and shifted by the sizes
    of the buckets before, so that no task holds a whole group.
    """
    cut = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    sizes = cut.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col(by).alias("_by"), F.col("_b").alias("_bucket"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inner = numbered(cut, [by, "_b"], [key], "_i")
    joined = inner.join(shift, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_bucket")))
    return joined.select(*df.columns, (F.col("_i") + F.col("_before")).alias(name))


def numbered_in_order(df: DataFrame, order: list[str | Column], name: str = "rn", start: int = 0) -> DataFrame:
    """Dense numbers from ``start`` in an order, made in the JVM and in no single task.

    A range exchange brings the rows in order; they are written once with the
    number of their range and their place in it, so that later readers and
    repeated tasks see the same ranges, and each range is shifted by the rows of
    those before it (one row a range).  Rows that the order does not tell apart
    get their numbers in no stated order.
    """
    placed = df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    placed = scratch.checkpointed(placed)
    ranges = placed.groupBy("_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = ranges.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first") + F.lit(start)).alias("_shift"))
    return placed.join(F.broadcast(shift), "_part").select(*df.columns, (F.col("_place") + F.col("_shift")).alias(name))


def ordered(df: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """Rows by ``key`` in ranges, ties in a stated order instead of that of arrival."""
    return df.orderBy(key, *ties)


def first_n(df: DataFrame, n: int, idx: str = "idx", start: int = 0) -> DataFrame:
    return df.where((F.col(idx) >= start) & (F.col(idx) < start + n))


def balanced(df: DataFrame, limit: int, split: str = "split", order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Up to ``limit // 2`` of ``pos``, then of ``neg`` as many as the limit leaves; both are top-n scans."""
    pos = df.where(F.col(split) == "pos").orderBy(*order).limit(limit // 2)
    n = pos.count()
    neg = df.where(F.col(split) == "neg").orderBy(*order).limit(max(0, limit - n))
    return pos.unionByName(neg)


def shuffled(df: DataFrame, key: list[str], seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key)


def hashed_sample(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    return shuffled(df, key, seed).limit(n)


def last_n_split(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Adds ``is_val`` for the last ``n`` rows of the order: a top-n scan finds them, and a broadcast of them finds the rest, so the table is not shuffled.

    Nulls are values like others.  Of equal rows as many are marked as the scan
    counted; which of them makes no difference, so those that are not marked
    are made from their number.
    """
    names = df.columns
    last = df.orderBy(*order).limit(n).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).cache()
    mine = last.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(names)])
    same = F.lit(True)
    for i, c in enumerate(names):
        same &= F.col(c).eqNullSafe(F.col(f"_{i}"))
    rest = df.join(F.broadcast(mine), same, "left_anti").withColumn("is_val", F.lit(False))
    marked = last.select(*names, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k")).select(*names, F.lit(True).alias("is_val"))
    there = df.join(F.broadcast(mine), same, "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias("_all"))
    other = last.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(names)], "_n")
    over = there.join(F.broadcast(other), same).where("_all > _n")
    over = over.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_all") - F.col("_n"))).alias("_k"))
    return rest.unionByName(marked).unionByName(over.select(*names, F.lit(False).alias("is_val")))


def folds(key: str, n: int = 5) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def hashed_partner(df: DataFrame, pool: DataFrame, key: str, pool_index: str, pool_size: int, seed: int = 0) -> DataFrame:
    """Pairs each row with the pool row whose dense index (from 0) a hash gives: sampling with replacement."""
    pick = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(pool_size))
    return df.withColumn(pool_index, pick).join(pool, pool_index)


def full_batches(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """``batch`` numbers in an order, without the last partial batch."""
    numbered = numbered_in_order(df, order, "_i")
    n = numbered.count() // size * size
    return numbered.where(F.col("_i") < n).withColumn("batch", F.floor(F.col("_i") / size)).drop("_i")
