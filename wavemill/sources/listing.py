"""Listings of folders as tables, through Spark's own file system access."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sets


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, length, modified`` of all files under ``folder``, however deep, in ranges of paths; ``path`` is relative to it.

    Only what the file system says of a file is read, no content.  Spark lists
    large folders by a job; the listing itself, one entry a file, is in the
    driver's memory while tasks are planned.  Spark plans no task for an empty
    file, so those come from that listing, with length 0 and no time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getPath().toUri().getPath()
    inside = F.expr(f"substring(path, locate({_quoted(root)}, path) + {len(root) + (not root.endswith('/'))})")
    full = files.select(inside.alias("path"), "length", F.col("modificationTime").alias("modified"))
    every = spark.createDataFrame([(unquote(urlparse(p).path),) for p in files.inputFiles()], "path string").select(inside.alias("path"))
    return every.join(full, "path", "left").withColumn("length", F.coalesce("length", F.lit(0))).orderBy("path")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def existing(spark: SparkSession, df: DataFrame, folder: str, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose files are all in ``folder``, the others); paths are relative to it."""
    return sets.split_by_existing(df, listing(spark, folder), paths)
