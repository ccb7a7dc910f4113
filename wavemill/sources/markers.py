"""Marker files of finished stages, through Spark's file system access.

A marker holds the digest of what its stage was made from, so that it does not
outlive a change of inputs or parameters.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(*parts) -> str:
    """Of values by what they show, and of frames by their columns and rows in any order."""
    h = hashlib.sha256()
    for p in parts:
        if isinstance(p, DataFrame):
            row = p.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in p.columns]))).cast("decimal(38,0)"))).first()
            p = (p.schema.simpleString(), row[0], str(row[1]))
        h.update(repr(p).encode())
    return h.hexdigest()


def _path(spark: SparkSession, folder: str, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, f".stage_{name}.done")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def is_done(spark: SparkSession, folder: str, name: str, made_from: str | None = None) -> bool:
    """Whether the stage is done, and from what ``made_from`` stands for if that is given."""
    path, system = _path(spark, folder, name)
    if not system.exists(path):
        return False
    if made_from is None:
        return True
    held = system.open(path)
    try:
        return bytes(held.readAllBytes()).decode() == made_from
    finally:
        held.close()


def write_done(spark: SparkSession, folder: str, name: str, made_from: str = "") -> None:
    path, system = _path(spark, folder, name)
    out = system.create(path, True)
    try:
        out.write(bytearray(made_from.encode()))
    finally:
        out.close()


def clear(spark: SparkSession, folder: str, name: str) -> None:
    path, system = _path(spark, folder, name)
    system.delete(path, False)
