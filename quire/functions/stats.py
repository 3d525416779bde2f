"""Aggregates and number functions whose ties and edges differ from the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median_or_zero(c: Column) -> Column:
    """Middle value, or the mean of the two middle ones; 0 for no rows."""
    return F.coalesce(F.median(c), F.lit(0.0))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at place round(q (n - 1)) of an array in order; 0 if it is empty."""
    ordered = F.sort_array(values)
    return F.when(F.size(values) == 0, 0.0).otherwise(F.element_at(ordered, F.floor(q * (F.size(values) - 1) + 0.5).cast("int") + 1))


def upper_middle(values: Column, default: float) -> Column:
    """The middle of an array in order, the upper one of two."""
    return F.when(F.size(values) == 0, default).otherwise(F.element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1))


def half_up(c: Column) -> Column:
    """Rounded, halves towards plus infinity."""
    return F.floor(c + 0.5)


def weighted_median(value: Column, weight: Column) -> Column:
    """The median of values each repeated weight times."""
    return F.coalesce(F.percentile(value, 0.5, weight), F.lit(0.0))


def first_seen_mode(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of several the one that comes first by `order`. Columns: by, value, times, total."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("times"), F.min(order).alias("_first"))
    best = Window.partitionBy(*by).orderBy(F.desc("times"), "_first")
    ranked = counted.withColumns({"_rank": F.row_number().over(best), "total": F.sum("times").over(Window.partitionBy(*by))})
    return ranked.where("_rank = 1").select(*by, value, "times", "total")
