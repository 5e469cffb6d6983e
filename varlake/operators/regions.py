"""Regions derived from gene models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Gene-model columns that make no sense for a promoter.
_DROPPED = ("Score", "Frame", "exon_number", "exon_id", "Feature")


def promoter_regions(transcripts: DataFrame, offset: int = 1000, clamp: bool = False) -> DataFrame:
    """The ``offset`` bases before each transcript, seen in reading direction.

    ``Start``/``End`` are 0-based and half-open. Strands other than ``+`` count as reverse. ``clamp`` keeps starts from
    going below the contig's first base.
    """
    forward = F.col("Strand") == "+"
    low = F.when(forward, F.col("Start") - offset).otherwise(F.col("End"))
    high = F.when(forward, F.col("Start")).otherwise(F.col("End") + offset)
    if clamp:
        low = F.greatest(low, F.lit(0))
    return transcripts.withColumns({"Start": low, "End": high}).drop(*_DROPPED)
