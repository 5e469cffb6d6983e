"""Column expressions: everything here is row-local and stays inside the JVM."""

from varlake.functions.genotypes import (
    call_summary_stats,
    depth_summary_stats,
    genotype_states,
    quality_summary_stats,
    zygosity_summary,
)
from varlake.functions.flags import flag_struct
from varlake.functions.identifiers import variant_spdi
from varlake.functions.text import field_name_normaliser

__all__ = [
    "call_summary_stats",
    "depth_summary_stats",
    "field_name_normaliser",
    "flag_struct",
    "genotype_states",
    "quality_summary_stats",
    "variant_spdi",
    "zygosity_summary",
]
