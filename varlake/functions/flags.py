"""Boolean flag structs (one-hot encoding with names as fields)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from varlake.functions._columns import as_column


def flag_struct(column: str | Column, values: Sequence[str], is_array: bool = False) -> Column:
    """``struct<value: boolean, …>``: whether the column equals, or as an array contains, each value.

    A null input gives null flags.
    """
    source = as_column(column)
    test = (lambda v: F.array_contains(source, v)) if is_array else (lambda v: source == F.lit(v))
    return F.struct(*[test(value).alias(value) for value in values])
