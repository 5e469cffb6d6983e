"""Gene models in GTF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlake.sources.bgzip import text_lines

# Attribute keys that become columns by default.
ATTRIBUTES = ("gene_id", "transcript_id", "gene_name", "gene_biotype", "exon_number", "exon_id", "protein_id")


def parse_gtf_lines(lines: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """Text lines (column ``value``) → typed rows with 0-based half-open ``Start``/``End``; absent attributes are null."""
    fields = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#") & (F.size(fields) >= 9)).select(fields.alias("f"))

    def text(i: int):
        value = F.get("f", F.lit(i))
        return F.nullif(value, F.lit("."))

    def attribute(key: str):
        # Values are quoted, or bare as numbers often are.
        pattern = rf'(?:^|;)\s*{key}\s+(?:"([^"]*)"|([^";\s]+))'
        whole = F.get("f", F.lit(8))
        found = F.concat(F.regexp_extract(whole, pattern, 1), F.regexp_extract(whole, pattern, 2))
        return F.nullif(found, F.lit(""))

    return rows.select(
        text(0).alias("Chromosome"),
        text(1).alias("Source"),
        text(2).alias("Feature"),
        (text(3).try_cast("long") - 1).alias("Start"),
        text(4).try_cast("long").alias("End"),
        text(5).try_cast("double").alias("Score"),
        text(6).alias("Strand"),
        text(7).try_cast("int").alias("Frame"),
        *[attribute(key).alias(key) for key in attributes],
    )


def read_gtf(spark: SparkSession, path: str, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """Read one or more (compressed) GTF files; block-compressed ones by many tasks each."""
    return parse_gtf_lines(text_lines(spark, path), attributes)
