"""Writers of manifests, submissions, reports and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import four_places, normalised_path, rooted


def write_jsonl(df: DataFrame, path: str, manifest_keys: bool = False) -> None:
    """One object per line; nulls are kept; column names go back to the manifests' if asked."""
    back = {v: k for k, v in schema.MANIFEST_KEYS.items()}
    out = df.select(*[F.col(c).alias(back.get(c, c) if manifest_keys else c) for c in df.columns])
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def submission(results: DataFrame, final_cer: float, duration: float, fields: tuple[str, ...] = ("id", "content", "label", "cer")) -> DataFrame:
    """One row with the submission document as JSON, rows in manifest order.

    A document holds all rows of an evaluation by its format; it is as large
    as the manifest's texts.
    """
    shown = {c: (four_places(F.col(c)) if c == "cer" else F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in fields}
    rows = results.select("split_order", "idx", F.struct(*[v.alias(k) for k, v in shown.items()]).alias("r"))
    doc = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("split_order", "idx", "r"))), lambda x: x["r"]).alias("results"))
    return doc.select(F.to_json(F.struct(F.struct("results", F.lit(f"{final_cer:.4f}").alias("final_cer"), F.lit(f"{duration:.2f}").alias("duration")).alias("result"))).alias("value"))


def alternative_submission(results: DataFrame, cer: float, rr: float, seconds: float) -> DataFrame:
    doc = submission(results, cer, seconds)
    tail = F.struct(F.lit(f"{cer:.4f}").alias("avg_cer"), F.lit(f"{rr:.4f}").alias("avg_rr"), F.lit(int(seconds * 1000)).alias("duration"))
    return doc.select(F.to_json(F.struct(F.from_json("value", schema.SUBMISSION)["result"]["results"].alias("results"), tail.alias("summary"))).alias("value"))


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    """Finished rows of a batch; a replayed batch is dropped by key when read."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema.CHECKPOINT.fields]).write.mode("append").parquet(path)


def write_distribution(df: DataFrame, path: str) -> None:
    """CSV of the gate's figures in UTF-8 with a byte order mark: a header, four decimals, empty for null."""
    shown = [four_places(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    first, *others = df.select(*shown).columns
    df.select(*shown).select(F.col(first).alias("\ufeff" + first), *others).write.mode("overwrite").option("header", True).option("nullValue", "").option("encoding", "UTF-8").csv(path)


def gate_report(counts: DataFrame, examples: DataFrame, coverage: DataFrame, limits: dict) -> DataFrame:
    """One row of JSON; ``examples`` holds 50 rows of each rule at most."""
    hits = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("rule_hits"))
    shown = examples.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "sim", "best"))).alias("rows"))
    detail = shown.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "rows")))).alias("detail"))
    config = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in limits.items()]))
    one = coverage.crossJoin(hits).crossJoin(detail)  # one row each
    return one.select(F.to_json(F.struct(F.from_json(config, "map<string,double>").alias("config"), "total", "has_gate_fields", "missing_gate_fields", "rule_hits", "detail")).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    """A report of few rows (statistics, a summary of versions), one object per line."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def absolute_paths(df: DataFrame, root: str, cols: list[str]) -> DataFrame:
    """Paths under ``root`` with slashes, ``.`` and ``..`` resolved."""
    return df.withColumns({c: normalised_path(rooted(root, F.col(c))) for c in cols})
