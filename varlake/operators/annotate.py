"""Attaching external annotation tables to variants by joins.

List annotations come in two shapes. ``nested=True`` gives the annotation format's shape: one array per variant, as
long as the list of features at that variant. ``nested=False`` gives one row per (variant, feature), null where there
is none; it keeps no list in memory, so use it when a single site may have very many features. ``page_size`` gives nested
lists with a bound: each variant has a row for each page of at most so many features, and a column ``page``.

Coordinates of both sides are 0-based and half-open. Lists are looked up per distinct site, so copies of a site do not
multiply the work.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varlake.functions._columns import quoted, with_computed
from varlake.operators.intervals import overlap_pairs
from varlake.operators.variants import minimal_alleles

SITE = ["contigName", "start", "end"]


#: Windows over which a site's features are dealt before they are numbered for pages.
DEALT = 64


def _paged(found: DataFrame, keys: Sequence[str], name: str, page_size: int) -> DataFrame:
    """Lists of at most ``page_size`` entries per key and ``page``. A key's entries are numbered in DEALT windows, not in one."""
    dealt = found.withColumn("__part", F.spark_partition_id() % DEALT)
    place = F.row_number().over(Window.partitionBy(*[quoted(k) for k in keys], "__part").orderBy(quoted(name)))
    page = (F.floor((place - 1) / page_size) * DEALT + F.col("__part")).cast("long")
    pages = dealt.withColumn("page", page).groupBy(*[quoted(k) for k in keys], "page")
    return pages.agg(F.array_sort(F.collect_list(name)).alias(name))


def _attach(
    variants: DataFrame,
    pairs: DataFrame,
    keys: Sequence[str],
    entry: Column,
    name: str,
    nested: bool,
    page_size: int | None = None,
) -> DataFrame:
    found = pairs.select(*[quoted(k) for k in keys], entry.alias(name))
    if page_size is not None:
        found = _paged(found, keys, name, page_size)
    elif nested:
        found = found.groupBy(*[quoted(k) for k in keys]).agg(F.array_sort(F.collect_list(name)).alias(name))
        # One row per site on the right, so only copies of a site can be many, and those are on the side that is split.
        return variants.join(found, list(keys), "left")
    # In a left join only the left side of a hot key is split; an inner join splits both. Merged, because a table of variants
    # that is small as a file may hold too many rows to be broadcast.
    matched = variants.hint("merge").join(found, list(keys))
    bare = variants.join(found.select(*[quoted(k) for k in keys]), list(keys), "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True)


def _custom_entry(fields: Sequence[str], name_col: str | None, allele_col: str | None, coordinates: Column) -> Column:
    """Features are named by an identifier, else by their coordinates: contig, 1-based start and end."""
    null = F.lit(None).cast("string")
    return F.struct(
        (F.coalesce(quoted(name_col).cast("string"), coordinates) if name_col else coordinates).alias("name"),
        (quoted(allele_col).cast("string") if allele_col else null).alias("allele"),
        F.struct(*[quoted(f).alias(f) for f in fields]).alias("fields"),
    )


def _coordinates(contig: str, start: str, end: str) -> Column:
    return F.concat(quoted(contig), F.lit(":"), (quoted(start) + 1).cast("string"), F.lit("-"), quoted(end).cast("string"))


def _needed_columns(features: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Only the coordinate columns and what the entry needs."""
    wanted = [*SITE, *[c for c in keep if c not in SITE]]
    return features.select(*[quoted(c) for c in dict.fromkeys(wanted)])


def annotate_overlap(
    variants: DataFrame,
    features: DataFrame,
    short_name: str,
    fields: Sequence[str],
    name_col: str | None = "name",
    allele_col: str | None = None,
    nested: bool = True,
    force_coordinates: bool = False,
    page_size: int | None = None,
) -> DataFrame:
    """Add every feature that overlaps the variant by at least one base as ``struct<name, allele, fields>``.

    Features without a name, or all with ``force_coordinates``, are named by their coordinates.
    """
    name_col = None if force_coordinates else name_col
    needed = [c for c in (name_col, allele_col, *fields) if c]
    sites = variants.select(*SITE).distinct()
    pairs = overlap_pairs(sites, _needed_columns(features, needed))
    entry = _custom_entry(fields, name_col, allele_col, _coordinates("contigName", "feature_start", "feature_end"))
    return _attach(variants, pairs, SITE, entry, short_name, nested, page_size)


def annotate_exact(
    variants: DataFrame,
    features: DataFrame,
    short_name: str,
    fields: Sequence[str],
    name_col: str | None = "name",
    allele_col: str | None = None,
    variant_allele_col: str | None = None,
    nested: bool = True,
    ref_col: str | None = None,
    variant_ref_col: str | None = None,
    force_coordinates: bool = False,
    page_size: int | None = None,
) -> DataFrame:
    """Add the features with exactly the variant's coordinates and, if both allele columns are named, its allele.

    If the reference alleles of both sides are named too, bases that a pair of alleles has in common at its ends are cut on
    both sides before they are compared, and coordinates move along: ``CA>CT`` meets ``A>T``. Names as in
    ``annotate_overlap``.
    """
    name_col = None if force_coordinates else name_col
    needed = [c for c in (name_col, allele_col, ref_col, *fields) if c]
    entries = _needed_columns(features, needed)
    entry = _custom_entry(fields, name_col, allele_col, _coordinates(*SITE))
    if not (variant_allele_col and allele_col):
        return _attach(variants, entries, SITE, entry, short_name, nested, page_size)
    if not (ref_col and variant_ref_col):
        keys = [*SITE, variant_allele_col]
        return _attach(variants, entries.withColumn(variant_allele_col, quoted(allele_col)), keys, entry, short_name, nested, page_size)
    keys = ["__contig", "__start", "__ref", "__alt"]
    left = _with_minimal_alleles(variants, variant_ref_col, variant_allele_col)
    right = _with_minimal_alleles(entries, ref_col, allele_col)
    return _attach(left, right, keys, entry, short_name, nested, page_size).drop(*keys)


def _with_minimal_alleles(df: DataFrame, ref: str, alt: str) -> DataFrame:
    """Keys of the change itself: bases common to both alleles are cut at the end, then at the beginning."""
    trimmed = with_computed(df, "__trimmed", minimal_alleles(quoted(ref), quoted(alt)))
    return trimmed.select(
        *[quoted(c) for c in df.columns],
        F.col("contigName").alias("__contig"),
        (F.col("start") + F.col("__trimmed.skipped")).alias("__start"),
        F.col("__trimmed.ref").alias("__ref"),
        F.col("__trimmed.alt").alias("__alt"),
    )


def annotate_colocated(variants: DataFrame, known: DataFrame, nested: bool = True, page_size: int | None = None) -> DataFrame:
    """Add known variants at the same coordinates as ``colocated_variants``.

    ``known`` needs ``contigName, start, end, strand, id, allele_string``; reported starts are 1-based.
    """
    entry = F.struct(
        F.col("contigName").alias("seq_region_name"),
        F.col("strand").cast("int").alias("strand"),
        (F.col("start") + 1).cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
        F.col("id").cast("string").alias("id"),
        F.col("allele_string").cast("string").alias("allele_string"),
    )
    return _attach(variants, known, SITE, entry, "colocated_variants", nested, page_size)


def annotate_cadd(
    variants: DataFrame,
    snv_scores: DataFrame,
    indel_scores: DataFrame,
    alt: str = "alternateAllele",
) -> DataFrame:
    """Add ``cadd_raw`` and ``cadd_phred`` of the variant's allele from the two score tables.

    The tables hold ``contigName, start, referenceAllele, alternateAllele, cadd_raw, cadd_phred``. Should a table list
    an allele twice, the highest raw score counts, so no variant is ever duplicated.
    """
    columns = ["contigName", "start", "referenceAllele", "alternateAllele", "cadd_raw", "cadd_phred"]
    both = snv_scores.select(*columns).unionByName(indel_scores.select(*columns)).withColumnRenamed("alternateAllele", alt)
    keys = ["contigName", "start", "referenceAllele", alt]
    # The score tables hold every possible change: only those of the variants' alleles are compared any further.
    best = (
        both.join(variants.select(*[quoted(k) for k in keys]), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.max(F.struct("cadd_raw", "cadd_phred")).alias("__best"))
    )
    joined = variants.join(best, keys, "left")
    return joined.withColumns(
        {c: F.col(f"__best.{c}").cast("float") for c in ("cadd_raw", "cadd_phred")}
    ).drop("__best")


# What each request letter reports.
_ANNOTYPES = {"p": ("prediction",), "s": ("score",), "b": ("prediction", "score")}


def annotate_transcript_scores(
    consequences: DataFrame,
    scores: DataFrame,
    kind: Literal["sift", "polyphen"],
    annotype: Literal["p", "s", "b"] = "b",
    keys: Mapping[str, str] | None = None,
    conflicts: Literal["error", "highest", "lowest"] = "error",
) -> DataFrame:
    """Add ``<kind>_prediction`` and ``<kind>_score`` of an amino-acid change; the unrequested one is null.

    Should ``scores`` list a change more than once with different values, that is an error, or the entry with the highest
    or lowest score counts (a low SIFT score is the damaging one, of PolyPhen a high one).

    ``consequences`` has one row per transcript consequence; ``keys`` maps its columns to those of ``scores``
    (default: transcript, protein position, amino acids).
    """
    if annotype not in _ANNOTYPES:
        raise ValueError(f"annotype must be one of {sorted(_ANNOTYPES)}, not {annotype!r}")
    keys = keys or {c: c for c in ("transcript_id", "protein_start", "amino_acids")}
    listed = scores.select(*[quoted(right).alias(left) for left, right in keys.items()], "prediction", "score")
    # Score tables and consequences may be far larger than Spark thinks, so neither is broadcast.
    wanted = listed.join(consequences.select(*[quoted(k) for k in keys]).hint("merge"), list(keys), "left_semi")
    entry = F.struct("score", "prediction")
    least, most = F.min(entry), F.max(entry)
    error = F.raise_error(F.concat(F.lit(f"{kind} scores differ for one change: "), F.to_json(least), F.lit(" "), F.to_json(most)))
    chosen = {"error": F.when(least != most, error).otherwise(most), "highest": most, "lowest": least}[conflicts]
    best = wanted.groupBy(*keys).agg(chosen.alias("__best"))
    types = {"prediction": "string", "score": "float"}
    added = {
        f"{kind}_{part}": (F.col(f"__best.{part}") if part in _ANNOTYPES[annotype] else F.lit(None)).cast(dtype)
        for part, dtype in types.items()
    }
    return consequences.join(best.hint("merge"), list(keys), "left").withColumns(added).drop("__best")
