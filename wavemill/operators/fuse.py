"""Score fusion over the whole run, and threshold decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGMA_EPS = 1e-8


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the population mean and deviation of each column."""
    return df.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def partial_moments(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """``by..., column, n, mean, m2`` of each group and column: the count of its values, their mean and the sum of squared deviations from it.

    Rows of this kind are what a run keeps of a batch (or a stream of a window);
    ``merged_moments`` makes the moments of all rows from them.
    """
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2")) for c in cols]
    rows = df.groupBy(*by).agg(F.array(*parts).alias("_p")).select(*by, F.explode("_p").alias("_p"))
    return rows.select(*by, "_p.column", "_p.n", "_p.mean", "_p.m2").where("n > 0")


def merged_moments(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by..., column, n, mean, m2`` over all parts of a column (and group).

    Squared deviations add up with each part's own distance from the common
    mean, so nothing large is subtracted from anything large.
    """
    keys = ["column", *(by or [])]
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    near = parts.join(whole.select(*keys, F.col("mean").alias("_mean")), keys)
    spread = near.groupBy(*keys).agg(F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2).alias("m2"))
    return whole.join(spread, keys).select(*(by or []), "column", "n", "mean", "m2")


def as_statistics(merged: DataFrame, cols: list[str]) -> DataFrame:
    """One row ``<col>_mean, <col>_std`` as ``moments`` has, from ``merged_moments`` rows."""
    pick = lambda c, v: F.max(F.when(F.col("column") == c, v))
    return merged.agg(*[x for c in cols for x in (pick(c, F.col("mean")).alias(f"{c}_mean"), pick(c, F.sqrt(F.col("m2") / F.col("n"))).alias(f"{c}_std"))])


def zscores(df: DataFrame, cols: list[str], stats: DataFrame | None = None) -> DataFrame:
    """Adds ``<col>_z``.  ``stats`` is a one-row frame of frozen moments; by default those of ``df`` itself."""
    joined = df.crossJoin(F.broadcast(stats if stats is not None else moments(df, cols)))  # one row
    z = [((F.col(c) - F.col(f"{c}_mean")) / (F.col(f"{c}_std") + SIGMA_EPS)).alias(f"{c}_z") for c in cols]
    return joined.select(*[F.col(c) for c in df.columns], *z)


def zscore_fuse(df: DataFrame, cols: list[str], weights: tuple[float, ...], stats: DataFrame | None = None, out: str = "fused") -> DataFrame:
    z = zscores(df, cols, stats)
    fused = sum((F.col(f"{c}_z") * F.lit(w) for c, w in list(zip(cols, weights))[1:]), F.col(f"{cols[0]}_z") * F.lit(weights[0]))
    return z.select(*df.columns, fused.alias(out))


def accept(score: Column, threshold: float) -> Column:
    return score >= F.lit(threshold)


def separation_triggered(sim: Column, low: float, high: float) -> Column:
    return (sim >= F.lit(low)) & (sim < F.lit(high))


def dual_accept(sim: Column, separated: Column, threshold: float, threshold_separated: float) -> Column:
    return sim >= F.when(separated, F.lit(threshold_separated)).otherwise(F.lit(threshold))
