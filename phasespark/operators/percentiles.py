"""Percentiles between two ranked values, to the last bit those of SQL's quantile_cont: a value that is meant to lie on a threshold then does."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def between(low: Column, high: Column, part: Column) -> Column:
    """low * (1 - part) + high * part, the first product and the sum rounded once, together; equal ends are given as they are."""
    fused = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - part, high * part).cast("double")
    return F.when(low == high, low).when(low.isNotNull() & high.isNotNull(), fused)


def between_numbers(low: float, high: float, part: float) -> float:
    """``between`` of one series' numbers."""
    return low if low == high else float(Fraction(low) * Fraction(1 - part) + Fraction(high * part))


def percentile_of(values: DataFrame, column: str, percentile: float, name: str) -> DataFrame:
    """(series_id, ``name``): the percentile of each series' values, from the two ranked values around its place. Values are sorted, not
    gathered."""
    rows = values.select("series_id", F.col(column).cast("double").alias("_v")).filter("_v is not null")
    by = Window.partitionBy("series_id")
    at = (F.count("*").over(by) - 1) * F.lit(percentile / 100.0)
    rows = rows.select("series_id", "_v", (F.row_number().over(by.orderBy("_v")) - 1).alias("_r"), at.alias("_at"))
    ends = rows.filter((F.col("_r") == F.floor("_at")) | (F.col("_r") == F.ceil("_at"))).groupBy("series_id", "_at").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    return ends.select("series_id", between(F.col("_low"), F.col("_high"), F.col("_at") - F.floor("_at")).alias(name))
