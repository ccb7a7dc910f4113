"""Readers of manifests, processed records, checkpoints, results and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, shape: StructType, strict: bool = True) -> DataFrame:
    """Lines of JSON in a declared schema; blank lines are dropped."""
    return spark.read.schema(shape).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``idx, value``: every line with its number in the file, blank ones counted but left out.

    A manifest is read as one file whose lines keep their order; the number
    comes from the partitions' line counts (one row each), so the file is still
    split and no line goes through Python.
    """
    lines = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    rows, before = [], 0
    for r in lines.groupBy("_part").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        rows.append((r["_part"], r["first"] - before))
        before += r["n"]
    shift = spark.createDataFrame(rows, "_part int, _less long")
    numbered = lines.join(F.broadcast(shift), "_part").select((F.col("_id") - F.col("_less")).alias("idx"), "value")
    return numbered.where(F.trim("value") != "")


def read_manifest(spark: SparkSession, root: str, splits: tuple[str, ...] = ("pos", "neg"), names: str = "{split}.jsonl") -> DataFrame:
    """``split, idx, id, kws_path, kws_text, cmd_path, label, ckpt_key`` of the splits whose files exist.

    ``idx`` is the raw line number.  A missing id becomes the row's place in
    the united list.
    """
    parts, before = [], None
    for k, split in enumerate(splits):
        path = f"{root}/{names.format(split=split)}"
        if not exists(spark, path):
            continue
        rows = numbered_lines(spark, path).select(F.lit(split).alias("split"), F.lit(k).alias("split_order"), "idx", F.from_json("value", schema.MANIFEST_JSON, {"mode": "FAILFAST"}).alias("r"))
        offset = F.lit(before or 0)
        flat = rows.select("split", "split_order", "idx", *[F.col(f"r.`{old}`").alias(new) for old, new in schema.MANIFEST_KEYS.items()])
        parts.append(flat.withColumn("id", F.coalesce("id", (F.col("idx") + offset).cast("string"))).withColumn("ckpt_key", F.concat_ws("_", "split", F.col("idx").cast("string"))))
        if k + 1 < len(splits):
            last = flat.agg(F.max("idx")).first()[0]
            before = (before or 0) + (0 if last is None else last + 1)
    if not parts:
        raise FileNotFoundError(f"no manifest of {splits} in {root}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_test_manifest(spark: SparkSession, path: str) -> DataFrame:
    """An unlabelled manifest; paths are taken relative to its folder."""
    rows = numbered_lines(spark, path).select("idx", F.from_json("value", schema.MANIFEST_JSON, {"mode": "FAILFAST"}).alias("r"))
    flat = rows.select(F.lit("test").alias("split"), "idx", *[F.col(f"r.`{old}`").alias(new) for old, new in schema.MANIFEST_KEYS.items()])
    return flat.withColumn("id", F.coalesce("id", F.col("idx").cast("string"))).withColumn("base", F.lit(path.rsplit("/", 1)[0]))


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    raw = read_jsonl(spark, path, schema.PROCESSED_JSON, strict=False)
    return raw.select(*[F.col(f"`{c}`").alias(schema.MANIFEST_KEYS.get(c, c)) for c in raw.columns])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_processed(spark, path).select("kws_path", "cmd_path", F.col("label").isNotNull().cast("int").alias("target"))


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame | None:
    """Finished rows, or None if there is no checkpoint or one that is no Parquet; other errors are raised, as they may pass."""
    if not exists(spark, path):
        return None
    done = spark.read.schema(schema.CHECKPOINT).parquet(path)
    try:
        done.agg(F.count("ckpt_key"), F.count("id")).collect()
    except Exception as e:
        if "CANNOT_READ_FILE_FOOTER" in str(e) or "not a Parquet file" in str(e):  # a broken checkpoint means a fresh start
            return None
        raise
    from ..operators.sets import checkpoint_keys

    return checkpoint_keys(done)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of submission documents; labels written as booleans or texts both read as texts."""
    doc = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    return doc.select(F.explode("result.results").alias("r"), F.input_file_name().alias("version")).select("version", "r.*")


def cached(spark: SparkSession, path: str, compute) -> DataFrame:
    """Parquet at ``path``, computed and written if absent."""
    if not exists(spark, path):
        compute().write.parquet(path)
    return spark.read.parquet(path)
