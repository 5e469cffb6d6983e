"""Joining genotypes with consequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlake.operators.reshape import shift_start

SITE = ["contigName", "start", "end"]


def join_consequences(
    singlegt: DataFrame, consequences: DataFrame, shift_start_by: int = 1, on_id: bool = False
) -> DataFrame:
    """Inner join of genotype rows with consequence rows.

    By default on the site: annotation coordinates are 1-based, so the genotype ``start`` is moved by one
    (``shift_start_by=0`` joins on it as it is). Alleles are not part of that key, and indels, whose annotated start
    differs, do not match. ``on_id`` joins on the variant identifier instead and has neither limit; both sides then
    need a column ``id``. Both sides have many rows for each row of their tables, so neither is broadcast, however small
    its table is as a file.
    """
    consequences = consequences.hint("merge")
    if on_id:
        right = consequences.drop("seq_region_name", "start", "end")
        return singlegt.join(right, ["id"], "inner")
    left = shift_start(singlegt, shift_start_by) if shift_start_by else singlegt
    return left.join(consequences.withColumnRenamed("seq_region_name", "contigName"), SITE, "inner")


def site_key(df: DataFrame, shift_start_by: int = 0) -> DataFrame:
    """Only the site columns, optionally shifted."""
    return df.select("contigName", (F.col("start") + shift_start_by).alias("start"), "end")
