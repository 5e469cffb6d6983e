"""Small helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(value: str | Column) -> Column:
    """A ``Column`` as it is; a string is read as a SQL expression."""
    return value if isinstance(value, Column) else F.expr(value)


def quoted(name: str) -> Column:
    """A top-level column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    Expressions built in Python repeat what they mention, and the optimiser inlines projections into filters and
    lambdas. Inside a lambda that would compute the value per element. A lambda's own variable is never inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df.withColumn(name, value)`` for values that are expensive to compute.

    A filter on a projected column is pushed below the projection with the column's whole expression in it, once per
    mention. A generator's output is left alone, so the value is computed once per row.
    """
    return df.withColumn(name, F.explode(F.array(value)))
