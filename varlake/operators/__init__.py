"""DataFrame → DataFrame operators."""

from varlake.operators.annotate import (
    annotate_cadd,
    annotate_colocated,
    annotate_exact,
    annotate_overlap,
    annotate_transcript_scores,
)
from varlake.operators.burden import (
    count_consequences,
    gene_burden,
    gene_burden_by_bitmaps,
    gene_burden_from_tables,
    min_af_consequences,
    pivot_zygosity,
    score_stats,
)
from varlake.operators.consequences import (
    array_to_onehot_columns,
    collect_terms,
    consequence_terms,
    explode_transcript_consequences,
    first_colocated,
    vocabulary,
    with_consequence_flags,
)
from varlake.operators.filters import drop_missing, filter_feature, filter_quality, filter_rare
from varlake.operators.genotypes import (
    allele_counts,
    explode_genotypes,
    explode_rare_genotypes,
    keep_rare_genotypes,
    with_genotype_states,
    with_zygosity,
)
from varlake.operators.intervals import overlap_pairs
from varlake.operators.joins import join_consequences
from varlake.operators.layout import layout_by_position, sort_by_position
from varlake.operators.regions import promoter_regions
from varlake.operators.reshape import (
    display_head,
    expand_struct,
    flatten,
    normalise_field_names,
    scalarise,
    scalarise_biallelic,
    shift_start,
    unstack_arrays,
    unstack_columns,
    zip_explode_cols,
)
from varlake.operators.stats import ecdf, ecdfs
from varlake.operators.variants import normalize_variants, split_and_normalize, split_multiallelics

__all__ = [
    "allele_counts",
    "annotate_cadd",
    "annotate_colocated",
    "annotate_exact",
    "annotate_overlap",
    "annotate_transcript_scores",
    "array_to_onehot_columns",
    "collect_terms",
    "consequence_terms",
    "count_consequences",
    "display_head",
    "drop_missing",
    "ecdf",
    "ecdfs",
    "expand_struct",
    "explode_genotypes",
    "explode_rare_genotypes",
    "explode_transcript_consequences",
    "filter_feature",
    "filter_quality",
    "filter_rare",
    "first_colocated",
    "flatten",
    "gene_burden",
    "gene_burden_by_bitmaps",
    "gene_burden_from_tables",
    "join_consequences",
    "keep_rare_genotypes",
    "layout_by_position",
    "min_af_consequences",
    "normalise_field_names",
    "normalize_variants",
    "overlap_pairs",
    "pivot_zygosity",
    "promoter_regions",
    "scalarise",
    "scalarise_biallelic",
    "score_stats",
    "shift_start",
    "sort_by_position",
    "split_and_normalize",
    "split_multiallelics",
    "unstack_arrays",
    "unstack_columns",
    "vocabulary",
    "with_consequence_flags",
    "with_genotype_states",
    "with_zygosity",
    "zip_explode_cols",
]
