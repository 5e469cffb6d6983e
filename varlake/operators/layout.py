"""Physical order of stored variant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

POSITION = ("contigName", "start", "end", "referenceAllele", "alternateAlleles")


def _order(df: DataFrame) -> list[str]:
    return [c for c in POSITION if c in df.columns]


def layout_by_position(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partition by position and sort inside partitions, so that files have narrow min/max statistics.

    The sort columns after ``start`` take part in the range bounds too: a position shared by very many rows is then
    spread over several partitions instead of one.
    """
    order = _order(df)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def sort_by_position(df: DataFrame) -> DataFrame:
    """Total order by position and alleles."""
    return df.orderBy(*_order(df))
