"""Finished batches of a long run, so that a run that was ended goes on where it stopped.

A batch is written as Parquet to a folder of its own and counts once the log
names it: ``_log/<number>.json`` holds the batch's folder and rows.  What an
ended run left half written is never read.  The log file of a number is made
once; a second run that works on the same folder at the same time gets an error
instead of rows that are there twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sets


class BatchLog:
    """The finished batches in ``folder``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        """``batch, path, rows`` in the order of their numbers; one for each batch."""
        path, system = self._path("_log")
        if not system.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in system.listStatus(path) if s.getPath().getName().endswith(".json"))
        if not names:
            return []
        rows = self.spark.read.schema("batch int, path string, rows long").json([f"{self.folder}/_log/{n}" for n in names])
        return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["batch"])

    def read(self) -> DataFrame | None:
        """The rows of all finished batches with their ``batch``; None without any."""
        parts = [self.spark.read.parquet(f"{self.folder}/{e['path']}").withColumn("batch", F.lit(e["batch"])) for e in self.entries() if e["rows"]]
        return sets.union_splits(*parts) if parts else None

    def append(self, df: DataFrame, batch: int | None = None) -> None:
        """Write ``df`` and name it in the log, as number ``batch`` (default: the next)."""
        batch = len(self.entries()) if batch is None else batch
        where = f"data/{batch:06}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{where}")
        entry = {"batch": batch, "path": where, "rows": self.spark.read.parquet(f"{self.folder}/{where}").count()}
        path, system = self._path("_log", f"{batch:06}.json")
        if system.exists(path):
            raise FileExistsError(f"batch {batch} is there already: another run works in {self.folder}")
        out = system.create(path, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()


def in_batches(df: DataFrame, log: BatchLog, key: str, batches: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` of all rows of ``df``, done in ``batches`` parts by the hash of ``key``; rows whose key the log has are not done again.

    ``work`` keeps the key.  What it gives for one part is appended before the
    next begins, so an ended run loses one part at most.
    """
    for k in range(batches):
        part = df.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        done = log.read()
        left = part if done is None else sets.resume(part, done, key)
        if not left.isEmpty():
            log.append(work(left))
    done = log.read()
    return work(df.limit(0)).withColumn("batch", F.lit(0)) if done is None else done
