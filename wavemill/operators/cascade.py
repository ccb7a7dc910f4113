"""Cascades: cheap stages first, expensive ones for the rows that are left.

A ``when`` around Python UDFs would run them for every row, so each stage runs
on a filtered frame and the parts are united.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Cache a frame until ``release``."""
    _KEPT.append(df.persist())
    return _KEPT[-1]


def release() -> None:
    """Free what ``keep`` has cached; frames made from it can still be used and are computed anew."""
    while _KEPT:
        _KEPT.pop().unpersist()


Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def cascade(df: DataFrame, stages: list[Stage], persist: Callable[[DataFrame], DataFrame] = keep) -> DataFrame:
    """``stages`` are (name, function); a function adds ``done boolean`` and ``value``.

    Rows done at one stage do not reach the next; those never done keep the
    last value.  Adds ``stage``, the name of the stage that decided.
    """
    columns, left, parts = df.columns, df, []
    for k, (name, stage) in enumerate(stages):
        tried = persist(stage(left).withColumn("stage", F.lit(name)))
        if k + 1 == len(stages):
            parts.append(tried)
        else:
            parts.append(tried.where(F.coalesce("done", F.lit(False))))
            left = tried.where(~F.coalesce("done", F.lit(False))).select(columns)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*columns, "value", F.coalesce("done", F.lit(False)).alias("done"), "stage")


def recognise_command(df: DataFrame, quick, main, reliable) -> DataFrame:
    """Quick recogniser, kept where its words are reliable; else the main one.  Both map a frame to one with ``heard``."""
    return cascade(
        df,
        [
            ("quick", lambda d: quick(d).withColumn("value", F.col("heard")).withColumn("done", reliable(F.col("heard"))).drop("heard")),
            ("main", lambda d: main(d).withColumn("value", F.col("heard")).withColumn("done", F.lit(True)).drop("heard")),
        ],
    )
