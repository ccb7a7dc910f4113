"""Grid searches over weights and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fuse import zscores

# Candidate weights in order, and thresholds in hundredths.
WEIGHTS = [
    (0.4, 0.4, 0.2), (0.45, 0.45, 0.1), (0.5, 0.4, 0.1), (0.4, 0.5, 0.1), (0.5, 0.5, 0.0), (0.35, 0.45, 0.2),
    (0.45, 0.35, 0.2), (0.6, 0.3, 0.1), (0.3, 0.6, 0.1), (0.5, 0.35, 0.15), (0.35, 0.5, 0.15),
]
THRESHOLDS = list(range(-35, 5))


def grid_table(spark, weights=None, thresholds=None) -> DataFrame:
    rows = [(i, j, *map(float, w), t / 100) for i, w in enumerate(weights or WEIGHTS) for j, t in enumerate(thresholds or THRESHOLDS)]
    return spark.createDataFrame(rows, "w_id int, t_id int, w0 double, w1 double, w2 double, threshold double")


def grid_scores(df: DataFrame, cols: list[str], positive: str, chars: str, weights=None, thresholds=None, stats: DataFrame | None = None) -> DataFrame:
    """Score of every grid point.

    Each row counts once per weight vector into the bin of the thresholds that
    it reaches, so rows multiply by the weights only; the points are sums over
    the bins, of which there is one per weight and threshold at most.
    """
    weights, thresholds = weights or WEIGHTS, thresholds or THRESHOLDS
    order = sorted(thresholds)
    z = zscores(df.select(*cols, positive, chars), cols, stats)
    choices = [F.struct(F.lit(i).alias("w_id"), *[F.lit(float(v)).alias(f"w{k}") for k, v in enumerate(w)]) for i, w in enumerate(weights)]
    each = z.withColumn("_w", F.explode(F.array(*choices)))
    fused = sum((F.col(f"{c}_z") * F.col(f"_w.w{k}") for k, c in list(enumerate(cols))[1:]), F.col(f"{cols[0]}_z") * F.col("_w.w0"))
    each = each.select(F.col("_w.w_id").alias("w_id"), fused.alias("_fused"), F.col(positive).alias("_p"), F.col(chars).alias("_chars"))
    reached = sum(((F.col("_fused") >= F.lit(t / 100)).cast("int") for t in order[1:]), (F.col("_fused") >= F.lit(order[0] / 100)).cast("int"))
    p = F.col("_p")
    bins = each.groupBy("w_id", reached.alias("_k")).agg(F.sum(F.when(p, F.col("_chars"))).alias("_c"), F.count_if(p).alias("_pos"), F.count_if(~p).alias("_neg"))
    ranked = df.sparkSession.createDataFrame([(j, order.index(t)) for j, t in enumerate(thresholds)], "t_id int, _rank int")
    points = grid_table(df.sparkSession, weights, thresholds).join(F.broadcast(ranked), "t_id")
    wide, hit = bins.join(F.broadcast(points), "w_id"), F.col("_k") > F.col("_rank")  # a fixed number of points
    per = wide.groupBy("w_id", "t_id", "w0", "w1", "w2", "threshold").agg(
        F.coalesce(F.try_divide(F.sum(F.when(~hit, F.col("_c"))), F.sum("_c")), F.lit(0.0)).alias("cer"),
        (1 - F.try_divide(F.coalesce(F.sum(F.when(hit, F.col("_neg"))), F.lit(0)), F.sum("_neg"))).alias("rr"),
        F.coalesce(F.sum(F.when(hit, F.col("_pos"))), F.lit(0)).alias("pos_acc"), F.coalesce(F.sum(F.when(hit, F.col("_neg"))), F.lit(0)).alias("neg_fa"),
    )
    return per.withColumn("score", (1 - F.col("cer")) * 40 + F.col("rr") * 40)


def best_point(scores: DataFrame) -> DataFrame:
    """The first point with the highest score."""
    return scores.orderBy(F.desc("score"), "w_id", "t_id").limit(1)


def model_sweep(df: DataFrame, points: DataFrame, stage, evaluate) -> DataFrame:
    """Each row with each of a fixed number of parameter points through ``stage`` (a frame function), evaluated per point."""
    return evaluate(stage(df.crossJoin(F.broadcast(points))))
