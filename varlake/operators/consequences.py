"""Exploding annotation records and flagging their consequences."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlake.functions._columns import quoted
from varlake.functions.flags import flag_struct

# Level names used by the annotation format.
IMPACT_LEVELS = ("HIGH", "MODERATE", "LOW", "MODIFIER")
LOF_LEVELS = ("HC", "LC")

# The four consequence lists of an annotation record.
CONSEQUENCE_TYPES = (
    "intergenic_consequences",
    "motif_feature_consequences",
    "regulatory_feature_consequences",
    "transcript_consequences",
)

# Record-level fields that an exploded consequence does not carry.
_RECORD_LEVEL_EXTRAS = (
    "colocated_variants",
    "intergenic_consequences",
    "most_severe_consequence",
    "motif_feature_consequences",
    "regulatory_feature_consequences",
)


def explode_transcript_consequences(annotations: DataFrame, outer: bool = False) -> DataFrame:
    """One row per (record, transcript consequence) as the struct ``transcript_consequence``.

    Records without transcript consequences vanish unless ``outer`` is set.
    """
    explode = F.explode_outer if outer else F.explode
    return annotations.withColumn("transcript_consequence", explode("transcript_consequences")).drop(
        "transcript_consequences", *_RECORD_LEVEL_EXTRAS
    )


def first_colocated(annotations: DataFrame) -> DataFrame:
    """Replace ``colocated_variants`` by its first element, ``colocated_variant``."""
    return annotations.withColumn("colocated_variant", F.get("colocated_variants", F.lit(0))).drop("colocated_variants")


def term_rows(annotations: DataFrame, csq_types: Sequence[str] = CONSEQUENCE_TYPES) -> DataFrame:
    """Distinct ``(csq_type, term)`` rows over several consequence lists, in one pass over the records."""

    def labelled(name: str) -> Column:
        terms = F.array_distinct(F.flatten(quoted(name).getField("consequence_terms")))
        return F.transform(terms, lambda term: F.struct(F.lit(name).alias("csq_type"), term.alias("term")))

    per_type = [labelled(name) for name in csq_types]
    # A missing list must not swallow the others, so nulls become empty before concatenation.
    present = [F.coalesce(terms, F.array().cast("array<struct<csq_type:string,term:string>>")) for terms in per_type]
    return annotations.select(F.explode(F.concat(*present)).alias("t")).select("t.*").distinct()


def consequence_terms(annotations: DataFrame, csq_type: str = "transcript_consequences") -> DataFrame:
    """Distinct consequence terms of one list."""
    return term_rows(annotations, [csq_type]).select("term")


def collect_terms(terms: DataFrame) -> list[str]:
    """Bring a one-column vocabulary to the driver, sorted. It becomes columns, so it should be small."""
    return sorted(row[0] for row in terms.collect() if row[0] is not None)


def vocabulary(annotations: DataFrame, csq_types: Sequence[str] = CONSEQUENCE_TYPES) -> dict[str, list[str]]:
    """Sorted terms of each consequence list; one job for all of them."""
    found: dict[str, list[str]] = {name: [] for name in csq_types}
    for csq_type, term in term_rows(annotations, csq_types).collect():
        if term is not None:
            found[csq_type].append(term)
    return {name: sorted(terms) for name, terms in found.items()}


def consequence_flags(terms: Iterable[str], prefix: str = "transcript_consequence") -> Mapping[str, Column]:
    """The three flag structs of one exploded transcript consequence, by column name."""
    return {
        "consequences": flag_struct(F.col(f"{prefix}.consequence_terms"), list(terms), is_array=True),
        "impact_level": flag_struct(F.col(f"{prefix}.impact"), IMPACT_LEVELS),
        "lof_level": flag_struct(F.col(f"{prefix}.lof"), LOF_LEVELS),
    }


def with_consequence_flags(exploded: DataFrame, terms: Iterable[str]) -> DataFrame:
    """Add the structs ``consequences``, ``impact_level`` and ``lof_level``."""
    return exploded.withColumns(dict(consequence_flags(terms)))


def array_to_onehot_columns(
    df: DataFrame, input_col: str, output_col: str, terms: Sequence[str] | None = None
) -> DataFrame:
    """Fit the vocabulary of a string array column and encode it as a struct of booleans."""
    if terms is None:
        terms = collect_terms(df.select(F.explode(quoted(input_col)).alias("term")).distinct())
    return df.withColumn(output_col, flag_struct(quoted(input_col), terms, is_array=True))
