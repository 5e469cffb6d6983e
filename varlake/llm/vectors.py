"""Embedding vectors as integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are below this in size once scaled, so that squared distances and products fit 64 bits.
LIMIT = 1 << 27


def is_finite(vector: str) -> Column:
    """True for a vector that is not null and holds neither nulls nor components that are not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def integers(rows: DataFrame, vector: str, scale: int = 64) -> DataFrame:
    """``rows`` whose ``vector`` is finite, each component x turned into floor(scale * x), x as double.

    A component of LIMIT and more stops the query with an error.
    """

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(float(scale))
        large = F.raise_error(F.concat(F.lit("a vector's component is too large: "), x.cast("string"))).cast("long")
        return F.when(F.abs(scaled) < float(LIMIT), F.floor(scaled)).otherwise(large)

    return rows.where(is_finite(vector)).withColumn(vector, F.transform(vector, whole))
