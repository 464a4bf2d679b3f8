"""Signal sources: signals(series_id, t, x) from tables, from generators and from numpy files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasespark.sources.numpy_files import NumpyFiles
from phasespark.sources.tables import table

#: Samples of a task, about. Without a number of tasks Spark goes by compressed bytes, and a task sorts millions of samples in one stage.
SAMPLES = 100_000


def as_signals(df: DataFrame, series: Column | None, order: list[Column], value: Column) -> DataFrame:
    """Rows numbered from 0 within each series; null and non-finite values are dropped. No series column: one series, '0'.

    Series are dealt to as many tasks as their rows need (``SAMPLES`` each), so that a task's memory doesn't grow with the table.
    """
    kept = df.select((series if series is not None else F.lit("0")).cast("string").alias("series_id"), *(o.alias(f"_o{i}") for i, o in enumerate(order)), value.cast("double").alias("x"))
    kept = kept.filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    if series is not None:
        kept = kept.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SAMPLES)), "series_id")
    by = Window.partitionBy("series_id").orderBy(*(f"_o{i}" for i in range(len(order))))
    return kept.select("series_id", (F.row_number().over(by) - 1).cast("long").alias("t"), "x")


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user: the values of the user's events in time order."""
    return as_signals(table(spark, sf_dir, "events"), F.col("user_id"), [F.col("ts"), F.col("event_id")], F.col("value"))


def orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per customer: the prices of the customer's orders in time order."""
    return as_signals(table(spark, sf_dir, "orders"), F.col("o_custkey"), [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_totalprice"))


def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: revenue by ship date, summed as decimals so that the order of summation doesn't show."""
    days = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("v"))
    return as_signals(days, None, [F.col("day")], F.col("v"))


def from_numpy(spark: SparkSession, path: str, npz_key: str | None = None, series_id: str = "0") -> DataFrame:
    """A 1-D array of numbers of a .npy or .npz file, read by the tasks in byte ranges. An archive of one array needs no key.

    ValueError at once for other arrays and files; values that are not finite fail when they are read.
    """
    options = {"path": path, "seriesId": series_id} | ({"key": npz_key} if npz_key is not None else {})
    NumpyFiles(options).reader(None)  # the header is checked here, where errors keep their kind
    spark.dataSource.register(NumpyFiles)
    return spark.read.format("numpy").options(**options).load()
