"""Turning the nested genotype list into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlake.functions._columns import with_computed
from varlake.functions.genotypes import genotype_states, zygosity_summary
from varlake.operators.reshape import zip_explode_cols


def with_genotype_states(df: DataFrame) -> DataFrame:
    """Add ``num_alt_alleles``, aligned with ``genotypes``."""
    return with_computed(df, "num_alt_alleles", genotype_states("genotypes"))


def with_zygosity(df: DataFrame, name: str = "zygosity") -> DataFrame:
    """Add the struct of sample counts per genotype state."""
    return with_computed(df, name, zygosity_summary("num_alt_alleles"))


def explode_genotypes(df: DataFrame) -> DataFrame:
    """One row per (variant, sample) with ``genotype: struct<gt, num_alt_alleles>``."""
    exploded = zip_explode_cols(df, ["genotypes", "num_alt_alleles"], "genotype", {"genotypes": "gt"})
    return exploded.drop("genotypes", "num_alt_alleles")


def keep_rare_genotypes(
    df: DataFrame, max_het: int = 2, max_hom: int = 2, zygosity: str = "zygosity"
) -> DataFrame:
    """Keep, inside ``genotypes`` and ``num_alt_alleles``, only carriers of rare zygosities.

    Exploding the result equals ``filter_rare(explode_genotypes(df))``, but a common variant never costs a row per
    sample. Variants left without carriers are dropped.
    """
    het_ok = F.col(f"{zygosity}.n_hetero") <= max_het
    hom_ok = F.col(f"{zygosity}.n_homo") <= max_hom
    pairs = F.arrays_zip(F.col("genotypes").alias("gt"), F.col("num_alt_alleles").alias("state"))

    def carriers(*states: int):
        return F.filter(pairs, lambda pair: pair.getField("state").isin(*states))

    # Which states are rare is decided once per variant; inside the filter it would be decided per sample.
    kept = (
        F.when(het_ok & hom_ok, carriers(1, 2)).when(het_ok, carriers(1)).when(hom_ok, carriers(2))
    )
    return (
        with_computed(df.filter(het_ok | hom_ok), "__rare", kept)
        .filter(F.size("__rare") > 0)
        .withColumns({"genotypes": F.col("__rare.gt"), "num_alt_alleles": F.col("__rare.state")})
        .drop("__rare")
    )


def explode_rare_genotypes(
    df: DataFrame, max_het: int = 2, max_hom: int = 2, zygosity: str = "zygosity"
) -> DataFrame:
    """One row per (variant, rare carrier)."""
    return explode_genotypes(keep_rare_genotypes(df, max_het, max_hom, zygosity))


def allele_counts(df: DataFrame, zygosity: str = "zygosity") -> DataFrame:
    """Allele count and zygosity counts per variant."""
    return df.select("INFO_AC", f"{zygosity}.*").drop("other")
