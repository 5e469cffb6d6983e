"""Row filters."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_quality(df: DataFrame, mode: Literal["and", "or"] = "and", min_qual: float = 99) -> DataFrame:
    """Keep variants that passed all filters and / or reach a quality.

    Apply it right after the scan: the comparison on ``qual`` is pushed into the file reader in ``and`` mode.
    """
    passed = F.array_contains("filters", "PASS")
    good = F.col("qual") >= min_qual
    if mode == "and":
        return df.filter(passed & good)
    if mode == "or":
        return df.filter(passed | good)
    raise ValueError(f"mode must be 'and' or 'or', not {mode!r}")


def filter_rare(df: DataFrame, max_het: int = 2, max_hom: int = 2, zygosity: str = "zygosity") -> DataFrame:
    """Keep carriers of variants that few samples carry in the same zygosity."""
    state = F.col("genotype.num_alt_alleles")
    rare_het = (state == 1) & (F.col(f"{zygosity}.n_hetero") <= max_het)
    rare_hom = (state == 2) & (F.col(f"{zygosity}.n_homo") <= max_hom)
    return df.filter(rare_het | rare_hom)


def filter_feature(df: DataFrame, feature: str = "transcript", column: str = "Feature") -> DataFrame:
    """Keep the annotation rows of one feature type."""
    return df.filter(F.col(column) == feature)


def drop_missing(df: DataFrame, column: str = "missing") -> DataFrame:
    """Drop observations flagged as missing; a null flag is no flag, as in ``unstack_arrays``."""
    return df.filter(~F.coalesce(F.col(column), F.lit(False)))
