"""The columns every variant table has."""

from __future__ import annotations

from pyspark.sql import types as T

from varlake.schema._build import struct_of

_INTS = T.ArrayType(T.IntegerType())

GENOTYPE_SCHEMA = struct_of(
    """
    sampleId string, phased boolean, calls nested, alleleDepths nested, depth integer,
    conditionalQuality integer, phredLikelihoods nested
    """,
    calls=_INTS,
    alleleDepths=_INTS,
    phredLikelihoods=_INTS,
)

#: INFO columns, ``INFO_<key>``, depend on the file.
VARIANT_SCHEMA = struct_of(
    """
    contigName string, start long, end long, names strings, referenceAllele string,
    alternateAlleles strings, qual double, filters strings, genotypes nested
    """,
    genotypes=T.ArrayType(GENOTYPE_SCHEMA),
)
