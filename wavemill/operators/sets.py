"""Join-shaped and set-shaped operators.  None hints a broadcast of a table that may grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resume(df: DataFrame, done: DataFrame, key: str = "ckpt_key") -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def checkpoint_keys(done: DataFrame) -> DataFrame:
    """Older files lack ``ckpt_key``; the id stands for it."""
    key = F.coalesce("ckpt_key", "id") if "ckpt_key" in done.columns else F.col("id")
    return done.withColumn("ckpt_key", key)


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def aligned(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("split", "idx")) -> DataFrame:
    """What zips rows by position elsewhere is a join on explicit positions here."""
    return a.join(b, list(on), "inner")


def by_position(a: DataFrame, b: DataFrame, order_a: list[str | Column], order_b: list[str | Column], position: str = "position") -> DataFrame:
    """Rows of two tables without a common key, joined by their places (from 0) in an order of each; the longer one's rest has no partner and is left out."""
    from .sampling import numbered_in_order

    return numbered_in_order(a, order_a, position).join(numbered_in_order(b, order_b, position), position)


def missing_types(expected: DataFrame, existing: DataFrame, on: tuple[str, ...] = ("split", "orig_id", "aug_type")) -> DataFrame:
    return expected.join(existing.select(*on).distinct(), list(on), "left_anti")


def augmented(originals: DataFrame, existing: DataFrame, types: list[str], make, order: list[str]) -> DataFrame:
    """``existing`` and what ``make`` (a frame function) adds for the (split, orig_id, aug_type) it lacks, in ``order``."""
    expected = originals.withColumn("aug_type", F.explode(F.array(*map(F.lit, types))))
    return make(missing_types(expected, existing)).unionByName(existing, allowMissingColumns=True).orderBy(*order)


def split_by_existing(df: DataFrame, listing: DataFrame, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose files all exist, the others)."""
    marked, flags = df, []
    for k, p in enumerate(paths):
        seen = listing.select(F.col("path").alias(p)).distinct().withColumn(f"_seen{k}", F.lit(True))
        marked, flags = marked.join(seen, p, "left"), [*flags, F.coalesce(F.col(f"_seen{k}"), F.lit(False))]
    both = flags[0]
    for f in flags[1:]:
        both = both & f
    drop = [f"_seen{k}" for k in range(len(paths))]
    return marked.where(both).drop(*drop).select(df.columns), marked.where(~both).drop(*drop).select(df.columns)


def pool_pairs(df: DataFrame, by: str, key: str, per_row: int = 1, seed: int = 0) -> DataFrame:
    """Each row with ``per_row`` others of its group, drawn by hash: never all pairs of a group."""
    from .sampling import numbered_spread

    left = numbered_spread(df, by, key)
    sizes = left.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    right = left.select(F.col(by), F.col("rn").alias("_pick"), F.col(key).alias(f"pool_{key}"))
    drawn = left.join(sizes, by).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(per_row))))
    step = F.pmod(F.xxhash64(F.col(key), F.col("_k"), F.lit(seed)), F.greatest(F.col("_n") - 1, F.lit(1)))
    drawn = drawn.withColumn("_pick", F.pmod(F.col("rn") + step, F.col("_n")) + 1)
    return drawn.join(right, [by, "_pick"]).drop("_n", "_k", "_pick", "rn")


def distinct_paths(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*cols)).alias("path")).distinct()


def with_features(pairs: DataFrame, features: DataFrame, cols: list[str], key: str = "path", value: str = "feature") -> DataFrame:
    for c in cols:
        pairs = pairs.join(features.select(F.col(key).alias(c), F.col(value).alias(f"{c}_{value}")), c)
    return pairs


def union_splits(*splits: DataFrame) -> DataFrame:
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def complement(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows where a predicate is false or unknown."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def joined_by_key(rows: DataFrame, by_key: DataFrame, key: str, count: str, share: int = 200) -> DataFrame:
    """``rows`` with the one row of ``by_key`` that its text ``key`` has (null equals null); ``count`` is that key's number of rows.

    A key with a ``share``-th of all rows or more is broadcast (there are
    ``share`` of them at most); the rows of such keys are not shuffled to it but
    dealt by content, so no task gets one key's rows.
    """
    other = [c for c in by_key.columns if c not in (key, count)]
    total = by_key.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * share >= total
    name = F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit("null"))
    common = by_key.where(hot).select(name.alias("_key"), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in other])
    rest = by_key.where(~hot).select(name.alias("_key"), *other)
    out = rows.withColumn("_key", name).join(F.broadcast(common), "_key", "left")
    spread = F.concat(F.lit("~"), F.xxhash64(*rows.columns).cast("string"))
    out = out.withColumn("_key", F.when(F.col("_hot"), spread).otherwise(F.col("_key"))).join(rest, "_key", "left")
    return out.select(*rows.columns, *[F.coalesce(f"_h_{c}", c).alias(c) for c in other])
