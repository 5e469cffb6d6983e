"""Distribution tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varlake._shared import scratch


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """Empirical cumulative distribution of a column: ``value, n, ecdf``, the value under its own name; see ``ecdfs``."""
    values = df.select(F.lit(0).alias("quantity"), F.col(column).alias("value"))
    return _cumulated(values).select(F.col("value").alias(column), "n", "ecdf")


def ecdfs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distributions of several numeric columns as ``quantity, value, n, ecdf``, in one pass over ``df``."""
    entries = [F.struct(F.lit(c).alias("quantity"), F.col(c).cast("double").alias("value")) for c in columns]
    return _cumulated(df.select(F.explode(F.array(*entries)).alias("e")).select("e.*"))


def _cumulated(values: DataFrame) -> DataFrame:
    """Running shares per quantity; null values are left out.

    Values are counted first, so repeated ones never reach a window. The counts, dealt into ranges, are stored in the shared
    folder; running totals are then taken inside each range, and the ranges' totals, one row each, give their offsets.
    """
    counts = values.filter(F.col("value").isNotNull()).groupBy("quantity", "value").agg(F.count("*").alias("n"))
    path = scratch(values.sparkSession, "ecdf")
    counts.repartitionByRange("quantity", "value").withColumn("range", F.spark_partition_id()).write.parquet(path)
    placed = values.sparkSession.read.parquet(path)
    totals = placed.groupBy("quantity", "range").agg(F.sum("n").alias("range_n"))
    every = Window.partitionBy("quantity")
    before = every.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "quantity",
        "range",
        F.coalesce(F.sum("range_n").over(before), F.lit(0)).alias("offset"),
        F.sum("range_n").over(every).alias("total"),
    )
    running = Window.partitionBy("quantity", "range").orderBy("value")
    share = (F.col("within") + F.col("offset")) / F.col("total")
    return (
        placed.withColumn("within", F.sum("n").over(running))
        .join(offsets, ["quantity", "range"])
        .select("quantity", "value", "n", share.alias("ecdf"))
    )
