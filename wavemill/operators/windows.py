"""Window-shaped operators with explicit frames and unique orders."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def moving_average3(value: Column, by: list[str], order: list[str]) -> Column:
    """Mean of three neighbours; at the edges the edge value counts twice."""
    w = Window.partitionBy(*by).orderBy(*order)
    before, after = F.coalesce(F.lag(value).over(w), value), F.coalesce(F.lead(value).over(w), value)
    return (before + value + after) / 3


def rolling_mean(value: Column, rows: int, by: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0)
    return F.avg(value).over(w)


def rolling_mean_cents(value: Column, rows: int, by: list[str], order: list[str]) -> Column:
    """The same for values with two decimals, summed exactly as whole cents."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0)
    cents = F.round(value * 100).cast("long")
    return F.sum(cents).over(w) / F.count(cents).over(w) / 100
