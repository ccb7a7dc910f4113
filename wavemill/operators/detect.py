"""Track choice after separation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_track(tracks: DataFrame, by: list[str], score: str, ordinal: str = "track_idx") -> DataFrame:
    """One row per key: the first track with the highest score."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), ordinal)
    return tracks.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def choose_track(base: Column, sims: Column, cap: float) -> Column:
    """``struct<track int, sim double, improved boolean>``: the first best track above the base similarity by at most ``cap``; else track -1."""
    marked = F.transform(sims, lambda s, i: F.struct(s.alias("sim"), (-i).alias("back")))
    good = F.filter(marked, lambda x: x["sim"].isNotNull() & (x["sim"] > base) & (x["sim"] - base <= cap))
    top = F.array_max(good)
    return F.when(F.size(good) > 0, F.struct((-top["back"]).cast("int").alias("track"), top["sim"].alias("sim"), F.lit(True).alias("improved"))).otherwise(
        F.struct(F.lit(-1).alias("track"), base.alias("sim"), F.lit(False).alias("improved"))
    )


def adaptive_separation(df: DataFrame, separate, sims, base: str, low: float, high: float, cap: float, need_two: bool = False) -> DataFrame:
    """Separation for the rows whose base similarity is in ``[low, high)`` only.

    ``separate`` adds ``tracks`` to a frame and ``sims`` adds ``track_sims``
    (both frame functions, so their models run on the triggered rows alone).
    Adds ``sim, track, improved, triggered``; the audio is the caller's.
    """
    hit = F.coalesce((F.col(base) >= low) & (F.col(base) < high), F.lit(False))
    done = sims(separate(df.where(hit)))
    usable = F.when(F.size("track_sims") > 1, F.col("track_sims")).otherwise(F.array().cast("array<double>")) if need_two else F.col("track_sims")
    done = done.withColumn("_c", choose_track(F.col(base), usable, cap))
    some = done.select(*df.columns, F.col("_c.sim").alias("sim"), F.col("_c.track").alias("track"), F.col("_c.improved").alias("improved"), F.lit(True).alias("triggered"))
    rest = df.where(~hit).select(*df.columns, F.col(base).alias("sim"), F.lit(-1).alias("track"), F.lit(False).alias("improved"), F.lit(False).alias("triggered"))
    return some.unionByName(rest)


def training_choice(base: Column, first_sims: Column, cap: float) -> Column:
    """``struct<track int, sim double>`` as training preparation chooses, by the first extractor's similarities alone.

    The jump is measured against the weighted base, no gain is required and
    the search starts from -1.0: without a track under the cap the result is
    track -1 with that similarity.
    """
    marked = F.transform(first_sims, lambda s, i: F.struct(s.alias("sim"), (-i).alias("back")))
    top = F.array_max(F.filter(marked, lambda x: (x["sim"] > -1.0) & (x["sim"] - base <= cap)))
    return F.struct(F.coalesce(-top["back"], F.lit(-1)).cast("int").alias("track"), F.coalesce(top["sim"], F.lit(-1.0)).alias("sim"))


def training_separation(df: DataFrame, separate, first_sims, base: str, low: float, high: float, cap: float) -> DataFrame:
    """``adaptive_separation`` with the choice of training preparation; adds ``sep_best_sim, track, triggered``.

    Rows that are not triggered, or get no tracks, keep the base similarity.
    """
    hit = F.coalesce((F.col(base) >= low) & (F.col(base) < high), F.lit(False))
    done = first_sims(separate(df.where(hit)))
    none = F.struct(F.lit(-1).alias("track"), F.col(base).cast("double").alias("sim"))
    done = done.withColumn("_c", F.when(F.size("track_sims") > 0, training_choice(F.col(base), F.col("track_sims"), cap)).otherwise(none))
    some = done.select(*df.columns, F.col("_c.sim").alias("sep_best_sim"), F.col("_c.track").alias("track"), F.lit(True).alias("triggered"))
    rest = df.where(~hit).select(*df.columns, F.col(base).cast("double").alias("sep_best_sim"), F.lit(-1).alias("track"), F.lit(False).alias("triggered"))
    return some.unionByName(rest)
