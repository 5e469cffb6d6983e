"""The reference analyses, end to end."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import DataFrame

from varlake.operators.burden import Measure, gene_burden_from_tables
from varlake.operators.consequences import (
    explode_transcript_consequences,
    vocabulary,
    with_consequence_flags,
)
from varlake.operators.filters import filter_quality
from varlake.operators.genotypes import (
    explode_genotypes,
    keep_rare_genotypes,
    with_genotype_states,
    with_zygosity,
)
from varlake.operators.joins import join_consequences
from varlake.operators.reshape import scalarise_biallelic
from varlake.operators.variants import split_and_normalize


def prepare_variants(
    variants: DataFrame, quality_mode: Literal["and", "or"] = "and", min_qual: float = 99
) -> DataFrame:
    """Quality filter, one-element arrays to scalars, genotype states and zygosity counts."""
    kept = filter_quality(variants, quality_mode, min_qual).drop("names")
    return with_zygosity(with_genotype_states(scalarise_biallelic(kept)))


def prepare_consequences(annotations: DataFrame, terms: Sequence[str] | None = None) -> DataFrame:
    """Flagged transcript consequences; without ``terms`` the vocabulary is read from the data first."""
    if terms is None:
        terms = vocabulary(annotations, ["transcript_consequences"])["transcript_consequences"]
    return with_consequence_flags(explode_transcript_consequences(annotations), terms)


def burden_table(
    variants: DataFrame,
    annotations: DataFrame,
    measure: Measure = "count",
    terms: Sequence[str] | None = None,
    quality_mode: Literal["and", "or"] = "and",
    min_qual: float = 99,
) -> DataFrame:
    """Gene burden of all genotypes; the pre-aggregated plan."""
    if terms is None:
        terms = vocabulary(annotations, ["transcript_consequences"])["transcript_consequences"]
    kept = scalarise_biallelic(filter_quality(variants, quality_mode, min_qual))
    return gene_burden_from_tables(kept, annotations, terms, measure)


def joined_genotypes(
    variants: DataFrame,
    annotations: DataFrame,
    terms: Sequence[str] | None = None,
    quality_mode: Literal["and", "or"] = "and",
    min_qual: float = 99,
) -> DataFrame:
    """One row per (variant, sample, transcript consequence): input of the row-level burden plans.

    Variants cross the network as one row each, and consequences without their flags: both are spread out after the join.
    """
    if terms is None:
        terms = vocabulary(annotations, ["transcript_consequences"])["transcript_consequences"]
    sites = prepare_variants(variants, quality_mode, min_qual)
    joined = join_consequences(sites, explode_transcript_consequences(annotations))
    return explode_genotypes(with_consequence_flags(joined, terms))


def rare_burden_table(
    variants: DataFrame,
    annotations: DataFrame,
    terms: Sequence[str] | None = None,
    max_het: int = 2,
    max_hom: int = 2,
    min_qual: float = 99,
    shift_start_by: int = 1,
) -> DataFrame:
    """Gene burden of rare genotypes only, filtered before anything is joined or exploded."""
    if terms is None:
        terms = vocabulary(annotations, ["transcript_consequences"])["transcript_consequences"]
    carriers = keep_rare_genotypes(prepare_variants(variants, "and", min_qual), max_het, max_hom)
    return gene_burden_from_tables(carriers, annotations, terms, "count", shift_start_by, complete=False)


def ingest_variants(variants: DataFrame, reference_bases: DataFrame | str | Sequence[str], **options) -> DataFrame:
    """Split multi-allelic sites and left-align: what a raw call set goes through before it is stored."""
    return split_and_normalize(variants, reference_bases, **options)
