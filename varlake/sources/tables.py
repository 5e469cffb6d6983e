"""Stored tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession

from varlake.operators.reshape import display_head

SITE_COLUMNS = ("contigName", "start", "end", "referenceAllele", "alternateAlleles")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Load a stored table of any format Spark has a source for."""
    return spark.read.format(fmt).load(path)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> None:
    """Store a table; by default an existing one is never replaced."""
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_site_table(
    df: DataFrame, name: str, path: str, buckets: int, keys: Sequence[str] = ("contigName", "start", "end")
) -> DataFrame:
    """Stores a table in ``buckets`` by its site, sorted in each, as ``name`` in the session's catalog, and reads it.

    Two tables of as many buckets join on all of ``keys`` without moving a row of either, as often as they are joined: the
    keys must be as the join wants them, so a start that has to be shifted is shifted before. A site's rows share a bucket.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_and_check(df: DataFrame, path: str, fmt: str = "parquet", nrows: int = 5, **options) -> pd.DataFrame:
    """Store a table, read it back and return a preview of what was stored."""
    write_table(df, path, fmt, **options)
    return display_head(read_table(df.sparkSession, path, fmt), nrows)


def select_site_columns(df: DataFrame, *extra: str | Column) -> DataFrame:
    """The columns that identify a variant."""
    return df.select(*SITE_COLUMNS, *extra)
