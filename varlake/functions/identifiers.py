"""Variant identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varlake.functions._columns import as_column


def variant_spdi(
    contig: str | Column = "contigName",
    start: str | Column = "start",
    ref: str | Column = "referenceAllele",
    alt: str | Column = "alternateAllele",
    join_alternate_alleles: bool = False,
) -> Column:
    """``contig:start:ref:alt`` with the 0-based start.

    With ``join_alternate_alleles`` the ``alt`` column is an array whose non-null elements are joined by
    commas. A null in any of the four parts makes the identifier null.
    """
    alt_text = as_column(alt)
    if join_alternate_alleles:
        alt_text = F.array_join(alt_text, ",")
    parts = [as_column(contig), as_column(start).cast("string"), as_column(ref), alt_text]
    spaced = [piece for part in parts for piece in (F.lit(":"), part)]
    return F.concat(*spaced[1:])
