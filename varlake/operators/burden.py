"""Gene burden: what each sample's variants do to each gene, split by zygosity.

Four equivalent plans are offered.

* ``count_consequences`` / ``min_af_consequences`` followed by ``pivot_zygosity``: two aggregations, two shuffles.
* ``gene_burden``: one conditional aggregation over the joined rows, one shuffle after the join.
* ``gene_burden_from_tables``: consequences are summed up per (site, gene) *before* the join, and only carriers are
  exploded, *after* it. Rows number (carriers x genes) per site instead of (samples x transcripts), variants cross the
  network as one row each, and a site holding a large share of all annotation rows collapses in the map-side combine.
  This is the plan to use on large tables.
* ``gene_burden_by_bitmaps``: the same for carriers; the rows of all other samples, for many samples nearly all of the result,
  come from bitmaps and are not shuffled. Samples without a name only count where they carry an allele.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlake.functions._columns import quoted
from varlake.functions.genotypes import genotype_states
from varlake.operators.consequences import (
    consequence_flags,
    explode_transcript_consequences,
)

Measure = Literal["count", "min_af"]

FLAG_STRUCTS = ("consequences", "impact_level", "lof_level")

#: Result field prefix → field of the transcript consequence.
SCORES = {"sift": "sift_score", "polyphen": "polyphen_score", "cadd": "cadd_raw"}

#: Result column → number of alternate alleles.
ZYGOSITIES = {"heterozygous": 1, "homozygous": 2}

GENE_SAMPLE = ["contigName", "gene_id", "sampleId"]


def _flag_names(df: DataFrame, struct: str) -> list[str]:
    dtype = df.schema[struct].dataType
    assert isinstance(dtype, T.StructType)
    return dtype.fieldNames()


def _flag(struct: str, name: str) -> Column:
    return F.col(struct).getField(name)


def score_stats(condition: Column | None = None) -> Column:
    """Struct of min / mean / max of the three pathogenicity scores, as doubles; nulls are skipped."""
    fields = []
    for prefix, field in SCORES.items():
        score = F.col(f"transcript_consequence.{field}").cast("double")
        if condition is not None:
            score = F.when(condition, score)
        fields += [
            F.min(score).alias(f"{prefix}_min"),
            F.mean(score).alias(f"{prefix}_mean"),
            F.max(score).alias(f"{prefix}_max"),
        ]
    return F.struct(*fields)


def _measure(flag: Column, measure: Measure, condition: Column | None = None) -> Column:
    """Aggregate one flag: how often it is set, or how rare its rarest carrier is (0 when never set)."""
    if measure == "count":
        value = flag.cast("long")
    else:
        value = F.when(flag, 1 - F.col("INFO_AF")).otherwise(F.lit(0.0))
    if condition is not None:
        value = F.when(condition, value)
    return F.sum(value) if measure == "count" else F.max(value)


def _burden_struct(joined: DataFrame, measure: Measure, condition: Column | None = None) -> list[Column]:
    flags = [
        F.struct(
            *[_measure(_flag(s, name), measure, condition).alias(name) for name in _flag_names(joined, s)]
        ).alias(s)
        for s in FLAG_STRUCTS
    ]
    return [*flags, score_stats(condition).alias("scores")]


def _per_state(joined: DataFrame, measure: Measure) -> DataFrame:
    return joined.groupBy(
        "contigName",
        F.col("genotype.gt.sampleId").alias("sampleId"),
        F.col("genotype.num_alt_alleles").alias("num_alt_alleles"),
        F.col("transcript_consequence.gene_id").alias("gene_id"),
    ).agg(*_burden_struct(joined, measure))


def count_consequences(joined: DataFrame) -> DataFrame:
    """Per (contig, sample, genotype state, gene): number of consequences with each flag, and score statistics."""
    return _per_state(joined, "count")


def min_af_consequences(joined: DataFrame) -> DataFrame:
    """As ``count_consequences``, but ``1 - INFO_AF`` of the rarest variant with each flag."""
    return _per_state(joined, "min_af")


def pivot_zygosity(counts: DataFrame) -> DataFrame:
    """Genotype states 1 and 2 side by side as the structs ``heterozygous`` and ``homozygous``.

    Samples seen only in other states keep a row, with null fields inside non-null structs.
    """
    structs = [*FLAG_STRUCTS, "scores"]
    sums = F.struct(
        *[F.struct(*[F.sum(_flag(s, n)).alias(n) for n in _flag_names(counts, s)]).alias(s) for s in structs]
    )
    wide = counts.groupBy(*GENE_SAMPLE).pivot("num_alt_alleles", list(ZYGOSITIES.values())).agg(sums)
    return wide.withColumnsRenamed({str(state): name for name, state in ZYGOSITIES.items()})


def gene_burden(joined: DataFrame, measure: Measure = "count") -> DataFrame:
    """The pivoted burden table in a single aggregation of the joined rows."""
    state = F.col("genotype.num_alt_alleles")
    return joined.groupBy(
        "contigName",
        F.col("transcript_consequence.gene_id").alias("gene_id"),
        F.col("genotype.gt.sampleId").alias("sampleId"),
    ).agg(
        *[F.struct(*_burden_struct(joined, measure, state == n)).alias(name) for name, n in ZYGOSITIES.items()]
    )


def site_gene_consequences(annotations: DataFrame, terms: Iterable[str], measure: Measure = "count") -> DataFrame:
    """Sum up transcript consequences per (site, gene); ``start`` stays 1-based.

    Columns: one per flag (``<struct>__<flag>``: count, or whether any is set) and four per score (min, max, sum, n).
    """
    exploded = explode_transcript_consequences(annotations)
    flags = consequence_flags(terms)
    rows = exploded.select(
        F.col("seq_region_name").alias("contigName"),
        "start",
        "end",
        F.col("transcript_consequence.gene_id").alias("gene_id"),
        *[column.alias(name) for name, column in flags.items()],
        *[F.col(f"transcript_consequence.{field}").cast("double").alias(field) for field in SCORES.values()],
    )
    aggregates = []
    for struct in FLAG_STRUCTS:
        for name in _flag_names(rows, struct):
            flag = _flag(struct, name)
            merged = F.sum(flag.cast("long")) if measure == "count" else F.max(F.coalesce(flag, F.lit(False)))
            aggregates.append(merged.alias(f"{struct}__{name}"))
    for field in SCORES.values():
        aggregates += [
            F.min(field).alias(f"{field}__min"),
            F.max(field).alias(f"{field}__max"),
            F.sum(field).alias(f"{field}__sum"),
            F.count(field).alias(f"{field}__n"),
        ]
    return rows.groupBy("contigName", "start", "end", "gene_id").agg(*aggregates)


#: 128 bits that stand for a variant's list of samples.
LIST_KEY = ("__list_high", "__list_low")


def _list_key(samples: Column) -> list[Column]:
    return [F.xxhash64(samples).alias(LIST_KEY[0]), F.xxhash64(F.lit(1), samples).alias(LIST_KEY[1])]


def _with_lists(per_state: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows of list keys become a row for each sample of the list."""
    # Carriers have no list. A key that no list has keeps their rows from meeting in one task.
    spread = per_state.withColumn(LIST_KEY[0], F.coalesce(LIST_KEY[0], F.xxhash64("gene_id", "sampleId")))
    listed = spread.join(lists.distinct(), list(LIST_KEY), "left")
    return listed.withColumn("sampleId", F.explode(F.coalesce("all", F.array("sampleId")))).drop("all", *LIST_KEY)


def gene_burden_from_tables(
    variants: DataFrame,
    annotations: DataFrame,
    terms: Sequence[str],
    measure: Measure = "count",
    shift_start_by: int = 1,
    complete: bool = True,
) -> DataFrame:
    """The burden table from the variant table (nested ``genotypes``) and the annotation table.

    Without ``complete`` only carriers get rows: for tables whose ``genotypes`` list nobody else, as after
    ``keep_rare_genotypes``, the result is the same, and no sample lists are read, passed on or joined.
    """
    per_gene = site_gene_consequences(annotations, terms, measure)
    # Everything the burden needs of a genotype; Parquet nested pruning keeps the rest on disk.
    samples = F.col("genotypes.sampleId")
    pairs = F.arrays_zip(samples.alias("sampleId"), genotype_states("genotypes").alias("state"))
    slim = variants.filter(F.size(samples) > 0).select(
        "contigName",
        (F.col("start") + shift_start_by).alias("start"),
        "end",
        *(["INFO_AF"] if measure == "min_af" else []),
        *(_list_key(samples) if complete else []),
        F.filter(pairs, lambda p: p.getField("state").isin(*ZYGOSITIES.values())).alias("carriers"),
    )
    # Merged: a variant's carriers may be far more than the size that Spark takes its file for.
    joined = slim.hint("merge").join(per_gene, ["contigName", "start", "end"], "inner")

    # Carriers become rows. The other samples only have to show up in the result, so each joined row passes on the key of
    # its whole sample list as one more entry; the lists, few different ones as a rule, come back after the aggregation.
    keys = LIST_KEY if complete else ()
    none = [F.lit(None).cast("long").alias(name) for name in keys]
    entries = F.transform("carriers", lambda c: F.struct(c.alias("carrier"), *none))
    if complete:
        nobody = F.struct(F.lit(None).cast("string").alias("sampleId"), F.lit(None).cast("int").alias("state"))
        entries = F.concat(entries, F.array(F.struct(nobody.alias("carrier"), *keys)))
    rows = joined.withColumn("entry", F.explode(entries)).drop("carriers", *keys)

    def flag_value(column: Column) -> Column:
        if measure == "count":
            return column
        return F.when(column, 1 - F.col("INFO_AF")).otherwise(F.lit(0.0))

    reduce = F.sum if measure == "count" else F.max
    flags = [c for c in per_gene.columns if c.split("__")[0] in FLAG_STRUCTS]
    merged = [reduce(flag_value(quoted(c))).alias(c) for c in flags]
    for prefix, field in SCORES.items():
        n = F.nullif(F.sum(f"{field}__n"), F.lit(0))
        merged += [
            F.min(f"{field}__min").alias(f"scores__{prefix}_min"),
            (F.sum(f"{field}__sum") / n).alias(f"scores__{prefix}_mean"),
            F.max(f"{field}__max").alias(f"scores__{prefix}_max"),
        ]
    per_state = rows.groupBy(
        "contigName",
        "gene_id",
        F.col("entry.carrier.sampleId").alias("sampleId"),
        F.col("entry.carrier.state").alias("state"),
        *[F.col(f"entry.{name}").alias(name) for name in keys],
    ).agg(*merged)
    per_sample = _with_lists(per_state, variants.filter(F.size(samples) > 0).select(*_list_key(samples), samples.alias("all"))) if complete else per_state

    def zygosity(state: int) -> Column:
        # At most one row per sample has this state, so max only picks it.
        structs = []
        for struct in (*FLAG_STRUCTS, "scores"):
            columns = [c for c in per_state.columns if c.startswith(f"{struct}__")]
            picked = [F.max(F.when(F.col("state") == state, quoted(c))).alias(c.removeprefix(f"{struct}__")) for c in columns]
            structs.append(F.struct(*picked).alias(struct))
        return F.struct(*structs)

    return per_sample.groupBy(*GENE_SAMPLE).agg(*[zygosity(n).alias(name) for name, n in ZYGOSITIES.items()])


# --- samples as bits -----------------------------------------------------------------------------------------------


def sample_dictionary(variants: DataFrame) -> DataFrame:
    """(sampleId, bucket, bit): each sample's place in bitmaps of 32,768 bits, by name. Distinct lists are taken apart once."""
    lists = variants.select(F.col("genotypes.sampleId").alias("all")).distinct()
    names = lists.select(F.explode("all").alias("sampleId")).distinct().where("sampleId is not null")
    # One row per sample: few enough for one window, whatever the number of variants.
    numbered = names.withColumn("number", F.row_number().over(Window.orderBy("sampleId")).cast("long"))
    return numbered.select(
        "sampleId", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("bit")
    )


def carrier_bitmaps(variants: DataFrame, sites: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(contigName, gene_id, bucket, carriers, listed): bitmaps of the samples that carry an allele, or are listed at all, at
    one of the gene's sites.

    ``sites`` are (contigName, start, end, gene_id) in the variants' coordinates, each once. Only bitmaps, single carriers
    and keys of sample lists are shuffled.
    """
    samples = F.col("genotypes.sampleId")
    pairs = F.arrays_zip(samples.alias("sampleId"), genotype_states("genotypes").alias("state"))
    carried = F.filter(pairs, lambda p: p.getField("state").isin(*ZYGOSITIES.values()))
    slim = variants.filter(F.size(samples) > 0).select(
        "contigName", "start", "end", *_list_key(samples), F.transform(carried, lambda p: p["sampleId"]).alias("carriers")
    )
    joined = slim.join(sites, ["contigName", "start", "end"])
    gene = ["contigName", "gene_id"]
    single = joined.select(*gene, F.explode("carriers").alias("sampleId")).distinct().join(dictionary, "sampleId")
    carriers = single.groupBy(*gene, "bucket").agg(F.bitmap_construct_agg("bit").alias("carriers"))
    lists = variants.filter(F.size(samples) > 0).select(*_list_key(samples), samples.alias("all")).distinct()
    placed = lists.select(*LIST_KEY, F.explode("all").alias("sampleId")).distinct().join(dictionary, "sampleId")
    bits = placed.groupBy(*LIST_KEY, "bucket").agg(F.bitmap_construct_agg("bit").alias("list"))
    listed = joined.select(*gene, *LIST_KEY).distinct().join(bits, list(LIST_KEY))
    listed = listed.groupBy(*gene, "bucket").agg(F.bitmap_or_agg("list").alias("listed"))
    right = carriers.withColumnsRenamed({name: f"__{name}" for name in (*gene, "bucket")})
    same = [F.col(name).eqNullSafe(F.col(f"__{name}")) for name in (*gene, "bucket")]
    return listed.join(right, reduce(and_, same), "left").drop(*[f"__{name}" for name in (*gene, "bucket")])


def _bit(bitmap: Column) -> Column:
    """Whether bit ``bit`` of a bitmap is set; false for a null bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce((F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)) % 2) == 1, F.lit(False))


def gene_burden_by_bitmaps(
    variants: DataFrame, annotations: DataFrame, terms: Sequence[str], measure: Measure = "count", shift_start_by: int = 1
) -> DataFrame:
    """The burden table with the samples that carry nothing told from bitmaps: only carriers are aggregated.

    The rows of the others, whose structs hold nulls, are what is listed but does not carry: they are made at the end, from a
    join of each gene's bitmaps with the dictionary, and never shuffled one by one.
    """
    kept = gene_burden_from_tables(variants, annotations, terms, measure, shift_start_by, complete=False)
    genes = annotations.select(
        F.col("seq_region_name").alias("contigName"),
        (F.col("start") - shift_start_by).alias("start"),
        "end",
        F.explode("transcript_consequences.gene_id").alias("gene_id"),
    ).distinct()
    dictionary = sample_dictionary(variants)
    bitmaps = carrier_bitmaps(variants, genes, dictionary)
    others = bitmaps.join(dictionary, "bucket").where(_bit(F.col("listed")) & ~_bit(F.col("carriers")))
    nothing = [_nulls(kept.schema[name].dataType).alias(name) for name in ZYGOSITIES]
    return kept.unionByName(others.select(*GENE_SAMPLE, *nothing))


def _nulls(dtype: T.DataType) -> Column:
    """A struct that is not null, of structs that are not, of nulls."""
    if isinstance(dtype, T.StructType):
        return F.struct(*[_nulls(f.dataType).alias(f.name) for f in dtype.fields])
    return F.lit(None).cast(dtype)
