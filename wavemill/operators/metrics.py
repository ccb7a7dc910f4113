"""Recognition and detection metrics.  Predicates on labels and contents have one name per meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import error_rate


def truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def present(c: Column) -> Column:
    return c.isNotNull()


def is_negative(label: Column) -> Column:
    """A label of ``"null"`` is negative and truthy at once."""
    return label.isNull() | label.isin("", "null")


def rejected(content: Column) -> Column:
    return F.coalesce(content, F.lit("")).isin("", "null")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def micro_error(errors: Column, chars: Column) -> Column:
    """Edits per reference character; rows with an empty reference are left out; 0 if there are no characters."""
    return F.coalesce(F.try_divide(F.sum(F.when(chars > 0, errors)), F.sum(F.when(chars > 0, chars))), F.lit(0.0))


def micro_error_official(errors: Column, chars: Column) -> Column:
    """Edits of empty references count too; without any characters 0 if there are no edits, else 1."""
    return F.when(F.coalesce(F.sum(chars), F.lit(0)) == 0, F.when(F.coalesce(F.sum(errors), F.lit(0)) == 0, 0.0).otherwise(1.0)).otherwise(F.sum(errors) / F.sum(chars))


def rejection_rate(content: Column, of: Column | None = None) -> Column:
    of = F.lit(True) if of is None else of
    return F.coalesce(F.try_divide(F.count_if(of & rejected(content)), F.count_if(of)), F.lit(0.0))


def rejection_rate_strict(content: Column, of: Column | None = None) -> Column:
    """Here the content ``"null"`` is a false acceptance; null without rows."""
    of = F.lit(True) if of is None else of
    return 1 - F.try_divide(F.count_if(of & truthy(content)), F.count_if(of))


def score_unit(cer: Column, rr: Column) -> Column:
    return (1 - cer) * 0.4 + rr * 0.4


def score80(cer: Column, rr: Column) -> Column:
    return (1 - cer) * 40 + rr * 40


def evaluate(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one per group, from ``label, content, ref, hyp`` (the last two normalised): cer, rr, both scores and counts."""
    pos, neg = truthy(F.col("label")), is_negative(F.col("label"))
    edits = F.when(pos, F.levenshtein("hyp", "ref"))
    chars = F.when(pos, F.length("ref"))
    one = df.groupBy(*by).agg(micro_error(edits, chars).alias("cer"), rejection_rate(F.col("content"), neg).alias("rr"), F.count_if(pos).alias("pos_count"), F.count_if(neg).alias("neg_count"))
    return one.select("*", score_unit(F.col("cer"), F.col("rr")).alias("score"), score80(F.col("cer"), F.col("rr")).alias("score80"))


def version_summary(df: DataFrame, seconds: str = "seconds", by: str = "version") -> DataFrame:
    """Per version of the results: cer, rr, score of 80 and the summed duration."""
    took = df.groupBy(by).agg(F.sum(seconds).alias("duration"))
    return evaluate(df, (by,)).select(by, "cer", "rr", "score80").join(took, by)


def time_per_sample(df: DataFrame, seconds: str, total: int) -> DataFrame:
    """One row: mean seconds a sample, and what ``total`` samples would take."""
    return df.agg(F.avg(seconds).alias("mean_seconds")).select("mean_seconds", (F.col("mean_seconds") * total).alias("total_seconds"))


def mean_gain(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """One row: means of a measure before and after, and the mean gain; rows that lack either are left out."""
    both = before.isNotNull() & after.isNotNull()
    return df.agg(F.avg(F.when(both, before)).alias("before"), F.avg(F.when(both, after)).alias("after"), F.avg(after - before).alias("gain"))


def with_row_error(df: DataFrame) -> DataFrame:
    return df.withColumn("cer", F.when(truthy(F.col("label")), error_rate(F.col("ref"), F.col("hyp"))))


def min_half_total_error(df: DataFrame, score: str, positive: str, steps: int = 200) -> DataFrame:
    """The first threshold ``k / steps`` with the least (false rejections + false acceptances) / 2.

    Each row counts once into a bin, so the scan is one aggregation of at most
    ``steps + 2`` groups and a running sum over them.  Without any better point
    the result is 1.0 at 0.0.
    """
    # Number of grid thresholds that the score reaches.
    k = F.greatest(F.lit(0), F.least(F.lit(steps), (F.floor(F.col(score) * steps) + 1).cast("int")))
    k = F.when((k > 0) & (F.col(score) < (k - 1) / F.lit(float(steps))), k - 1).when((k < steps) & (F.col(score) >= k / F.lit(float(steps))), k + 1).otherwise(k)
    bins = df.groupBy(k.alias("k")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    grid = df.sparkSession.range(0, steps).select(F.col("id").cast("int").alias("t"))
    per = grid.crossJoin(F.broadcast(bins))  # steps * (steps + 1) rows of counts
    rates = per.groupBy("t").agg(F.try_divide(F.sum(F.when(F.col("k") <= F.col("t"), F.col("p")).otherwise(0)), F.sum("p")).alias("frr"), F.try_divide(F.sum(F.when(F.col("k") > F.col("t"), F.col("n")).otherwise(0)), F.sum("n")).alias("far"))
    rates = rates.select("t", ((F.coalesce("frr", F.lit(0.0)) + F.coalesce("far", F.lit(0.0))) / 2).alias("hter"))
    return rates.agg(F.min(F.struct("hter", "t")).alias("m")).select(F.when(F.col("m.hter") < 1, F.col("m.hter")).otherwise(1.0).alias("min_hter"), F.when(F.col("m.hter") < 1, F.col("m.t") / F.lit(float(steps))).otherwise(0.0).alias("threshold"))


def margin_loss(pos: Column, neg: Column, high: float = 0.7, low: float = 0.3) -> Column:
    """Nulls on either side count for nothing (``greatest`` would skip them, not pass them on)."""
    relu = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))
    return F.avg(relu(high - pos)) + F.avg(relu(neg - low))


def embedding_spread(df: DataFrame, col: str) -> DataFrame:
    """Mean over the dimensions of the sample deviation, and whether it has collapsed."""
    per = df.select(F.posexplode(col).alias("pos", "v")).groupBy("pos").agg(F.stddev_samp(F.col("v").cast("double")).alias("s"))
    return per.agg(F.avg("s").alias("spread")).select("spread", (F.col("spread") < 0.01).alias("collapsed"))


def mismatches(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.count_if(F.abs(a - b) > tolerance)


def uppercase_or_wide(c: Column) -> Column:
    """Labels with capitals or full-width forms."""
    return c.rlike("[A-Z\\uFF01-\\uFF5E]")


def first_uppercase(df: DataFrame, label: str, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows with such a label: a report, not a filter."""
    return df.where(uppercase_or_wide(F.col(label))).orderBy(*order).limit(n)


def hit_breakdown(df: DataFrame) -> DataFrame:
    """Per language and in all from ``kws_text, hit, separated``: rows, direct hits, hits and misses after separation, rest, rate."""
    language = F.when(F.col("kws_text").rlike("[A-Za-z]"), "en").otherwise("zh")
    hit, sep = F.col("hit"), F.col("separated")
    counts = [
        F.count(F.lit(1)).alias("total"), F.count_if(hit & ~sep).alias("direct_hit"), F.count_if(hit & sep).alias("separated_hit"),
        F.count_if(~hit & sep).alias("separated_miss"), F.count_if(~hit & ~sep).alias("no_match"), F.try_divide(F.count_if(hit), F.count(F.lit(1))).alias("rate"),
    ]
    return df.withColumn("language", language).cube("language").agg(*counts).withColumn("language", F.coalesce("language", F.lit("all")))


def best_epoch(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of the epochs flagged ``best``, that with the least ``val_eer``, the earlier one of equals."""
    one = df.where("best").groupBy(*by).agg(F.min(F.struct("val_eer", "epoch")).alias("m"))
    return one.where("m is not null").select(*by, "m.epoch", "m.val_eer")


def running_best(df: DataFrame, value: str, order: list[str], start: float, by: list[str] | None = None) -> DataFrame:
    """Flags rows whose value is under ``start`` and under all before."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("is_best", F.col(value) < F.least(F.lit(start), F.min(value).over(w)))
