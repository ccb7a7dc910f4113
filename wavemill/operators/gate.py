"""Rule-based data gate, its report and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMITS = {"neg_high_sim": 0.55, "pos_low_sim": 0.30, "jump_cap": 0.30}


def number(c: Column) -> Column:
    return c.try_cast("double")


def flag(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "yes"), F.lit(False))


def tidy(df: DataFrame) -> DataFrame:
    """``sim, best, triggered`` from processed records.

    Columns do not tell an absent key from a null one, so the fallback fields
    serve in both cases; ``tidy_records`` reads VARIANTs, which do.
    """
    return df.withColumns({
        "sim": number(F.coalesce("sim_abs", "sim_abs_weighted")), "best": number(F.col("sep_best_sim")), "triggered": flag(F.coalesce("sep_triggered", "cmd_separated")),
    })


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: each line of JSON as a VARIANT, which keeps apart what columns do not: a key that is absent and one that is null."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("record"))


def _first_present(record: Column, *keys: str) -> Column:
    """The value (a VARIANT, which may be null) of the first key that is there; SQL null if none is."""
    return F.coalesce(*[F.try_variant_get(record, f"$['{k}']", "variant") for k in keys])


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def number_of(v: Column) -> Column:
    """A VARIANT as a double: numbers, texts that are numbers, true and false; anything else is null."""
    text = F.trim(F.try_variant_get(v, "$", "string"))
    plain = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    named = F.regexp_replace(F.lower(text), "^[+-]", "")
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    special = F.when(named == "nan", float("nan")).when(named.isin("inf", "infinity"), sign * float("inf"))
    flag_ = F.try_variant_get(v, "$", "boolean").cast("double")
    return F.when(_kind(v) == "STRING", F.coalesce(plain, special)).when(_kind(v) == "BOOLEAN", flag_).otherwise(F.try_variant_get(v, "$", "double"))


def truth_of(v: Column) -> Column:
    """A VARIANT as a flag: texts ``true``, ``1`` and ``yes``; else what is not null, false, zero or empty."""
    kind, text = _kind(v), F.try_variant_get(v, "$", "string")
    other = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind.rlike("^(ARRAY|OBJECT)"), ~text.isin("[]", "{}")).otherwise(F.try_variant_get(v, "$", "double") != 0)
    return F.coalesce(F.when(kind == "STRING", F.lower(text).isin("true", "1", "yes")).otherwise(other), F.lit(False))


def tidy_records(df: DataFrame, record: str = "record", label: str = "识别文本") -> DataFrame:
    """``positive, sim, best, triggered`` of VARIANT records.

    A key that is there with null does not fall back to the next one.
    """
    r = F.col(record)
    labelled = F.try_variant_get(r, f"$['{label}']", "variant")
    return df.withColumns({
        "positive": labelled.isNotNull() & ~F.coalesce(F.is_variant_null(labelled), F.lit(False)), "sim": number_of(_first_present(r, "sim_abs", "sim_abs_weighted")),
        "best": number_of(_first_present(r, "sep_best_sim")), "triggered": truth_of(_first_present(r, "sep_triggered", "cmd_separated")),
    })


def rule_hits(positive: Column, sim: Column, best: Column, triggered: Column, limits: dict | None = None) -> Column:
    """Names of the rules that a row breaks; nulls break none; a null limit turns a rule off."""
    limits = LIMITS | (limits or {})
    found = []
    if limits["neg_high_sim"] is not None:
        found.append(F.when(~positive & (sim > limits["neg_high_sim"]), F.lit("G1_neg_high_sim")))
    if limits["pos_low_sim"] is not None:
        found.append(F.when(positive & (best < limits["pos_low_sim"]), F.lit("G2_pos_low_sim")))
    if limits["jump_cap"] is not None:
        found.append(F.when(triggered & (best - sim > limits["jump_cap"]), F.lit("G3_jump_artifact")))
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def passed(hits: Column) -> Column:
    return F.size(hits) == 0


def rule_counts(df: DataFrame) -> DataFrame:
    """Rules by falling number of hits."""
    return df.select(F.explode("hits").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule")


def examples(df: DataFrame, order: list[str], most: int = 50) -> DataFrame:
    """The first ``most`` rows of each rule; Spark limits each group before the exchange."""
    w = Window.partitionBy("rule").orderBy(*order)
    return df.withColumn("rule", F.explode("hits")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def coverage(df: DataFrame) -> DataFrame:
    has = F.col("sim").isNotNull() | F.col("best").isNotNull()
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("has_gate_fields"), F.count_if(~has).alias("missing_gate_fields"))
