"""Manifests as a stream: batch functions on micro-batches, resumed by Spark's own checkpoint.

Fusion statistics are global over a run, so a stream takes frozen ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators import fuse


def stream_processed(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.readStream.schema(schema.PROCESSED_JSON).json(folder)
    return raw.select(*[F.col(f"`{c}`").alias(schema.MANIFEST_KEYS.get(c, c)) for c in raw.columns])


def score_stream(stream: DataFrame, cols: list[str], weights: tuple[float, ...], stats: DataFrame, threshold: float) -> DataFrame:
    """Stateless: each row fused with the frozen one-row ``stats`` and judged."""
    return fuse.zscore_fuse(stream, cols, weights, stats).withColumn("is_target", fuse.accept(F.col("fused"), threshold))


def run_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch through a batch function into its own folder, so that a replayed batch replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, key: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and key; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"))
