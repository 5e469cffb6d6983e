"""The registered queries: every operator, run over the driver's whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlake import operators as op
from varlake._shared import scratch
from varlake.functions import (
    call_summary_stats,
    depth_summary_stats,
    quality_summary_stats,
    variant_spdi,
)
from varlake.operators.consequences import term_rows
from varlake.plans import views, workflows
from varlake.schema.annotation import AnnotationSchema, infer_schema_of_all, parse_annotations, preset
from varlake.sources.bgzip import read_vcf_blocks, write_vcf_blocks
from varlake.sources.fasta import index_fasta, read_indexed_bases, read_reference_bases
from varlake.sources.gtf import parse_gtf_lines, read_gtf
from varlake.sources.pipe import annotate, pipe_lines, pipe_resumable
from varlake.sources.tables import read_table, select_site_columns, write_and_check, write_site_table, write_table
from varlake.sources.vcf import VcfHeader, format_vcf_lines, infer_vcf_header, parse_vcf_lines, read_vcf, write_vcf

Query = Callable[[SparkSession, str], DataFrame]

#: A quality that about half of the orders reach; the usual 99 would keep all, and the queries that filter show nothing.
MIN_QUAL = 150_000
#: Annotation records of a bucket of stored sites, beyond 16 buckets.
BUCKET_ROWS = 1 << 18
SAMPLES = [f"S{k}" for k in range(views.N_SAMPLES)]

_registry: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registry[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_registry)


# --- burden ---------------------------------------------------------------------------------------------------------


@query
def gene_burden_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: consequences per gene, sample and zygosity, summed up per site before the join."""
    burden = workflows.burden_table(views.variants(spark, sf_dir), views.annotations(spark, sf_dir), "count", views.TERMS)
    return op.flatten(burden)


@query
def gene_burden_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship with samples as bits."""
    kept = op.scalarise_biallelic(op.filter_quality(views.variants(spark, sf_dir)))
    return op.flatten(op.gene_burden_by_bitmaps(kept, views.annotations(spark, sf_dir), views.TERMS))


@query
def gene_burden_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = workflows.joined_genotypes(views.variants(spark, sf_dir), views.annotations(spark, sf_dir), views.TERMS)
    return op.flatten(op.gene_burden(joined))


@query
def gene_burden_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = workflows.joined_genotypes(views.variants(spark, sf_dir), views.annotations(spark, sf_dir), views.TERMS)
    return op.flatten(op.pivot_zygosity(op.count_consequences(joined)))


@query
def gene_burden_min_af(spark: SparkSession, sf_dir: str) -> DataFrame:
    burden = workflows.burden_table(
        views.variants(spark, sf_dir),
        op.first_colocated(views.annotations(spark, sf_dir)),
        "min_af",
        views.TERMS,
        "or",
        MIN_QUAL,
    )
    return op.flatten(burden)


@query
def gene_burden_min_af_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = workflows.joined_genotypes(
        views.variants(spark, sf_dir), views.annotations(spark, sf_dir), views.TERMS, "or", MIN_QUAL
    )
    return op.flatten(op.pivot_zygosity(op.min_af_consequences(joined)))


@query
def gene_burden_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.flatten(
        workflows.rare_burden_table(
            views.variants(spark, sf_dir), views.annotations(spark, sf_dir), views.TERMS
        )
    )


@query
def count_consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = workflows.joined_genotypes(views.variants(spark, sf_dir), views.annotations(spark, sf_dir), views.TERMS)
    return op.flatten(op.count_consequences(joined))


@query
def min_af_consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = workflows.joined_genotypes(views.variants(spark, sf_dir), views.annotations(spark, sf_dir), views.TERMS)
    return op.flatten(op.min_af_consequences(joined))


# --- genotypes ------------------------------------------------------------------------------------------------------


@query
def genotype_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = op.with_genotype_states(views.variants(spark, sf_dir))
    return states.select("contigName", "start", F.array_join("num_alt_alleles", ",").alias("states"))


@query
def zygosity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = op.with_zygosity(op.with_genotype_states(views.variants(spark, sf_dir)))
    fields = op.expand_struct(counted.withColumn("z", F.col("zygosity").withField("start", F.col("start"))), "z")
    return fields.withColumn("other", F.array_join("other", ","))


@query
def single_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.explode_genotypes(op.with_genotype_states(views.variants(spark, sf_dir)))
    return rows.select(
        "contigName",
        "start",
        "genotype.gt.sampleId",
        "genotype.gt.phased",
        "genotype.gt.depth",
        "genotype.num_alt_alleles",
    )


@query
def rare_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = workflows.prepare_variants(views.variants(spark, sf_dir))
    rare = op.explode_rare_genotypes(prepared, 2, 1)
    return rare.select("contigName", "start", "genotype.gt.sampleId", "genotype.num_alt_alleles")


@query
def rare_genotypes_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = workflows.prepare_variants(views.variants(spark, sf_dir))
    rare = op.filter_rare(op.explode_genotypes(prepared), 2, 1)
    return rare.select("contigName", "start", "genotype.gt.sampleId", "genotype.num_alt_alleles")


@query
def call_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = views.variants(spark, sf_dir).select("start", call_summary_stats().alias("s")).select("start", "s.*")
    lists = ("nHomozygous", "alleleCounts")
    return stats.select(
        *[c for c in stats.columns if c not in (*lists, "alleleFrequencies")],
        *[F.array_join(c, ",").alias(c) for c in lists],
        F.get("alleleFrequencies", F.lit(1)).alias("alt_frequency"),
    )


@query
def depth_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = views.variants(spark, sf_dir).select(
        "start", depth_summary_stats().alias("dp"), quality_summary_stats().alias("gq")
    )
    flat = op.flatten(stats)
    return flat.withColumns({c: F.round(c, 6) for c in flat.columns if c.endswith(("mean", "stdDev"))})


@query
def allele_count_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.allele_counts(workflows.prepare_variants(views.variants(spark, sf_dir)))


@query
def ecdf_allele_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = op.allele_counts(workflows.prepare_variants(views.variants(spark, sf_dir)))
    return op.ecdfs(counts, ["INFO_AC", "n_homo", "n_hetero"]).withColumn("value", F.col("value").cast("int"))


@query
def ecdf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ecdf(views.variants(spark, sf_dir), "qual")


# --- identifiers, reshaping ------------------------------------------------------------------------------------------


@query
def spdi_biallelic(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = op.split_multiallelics(views.multiallelic(spark, sf_dir))
    return split.select(variant_spdi(alt=F.get("alternateAlleles", F.lit(0))).alias("variant_id"))


@query
def spdi_multiallelic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.multiallelic(spark, sf_dir)
    return rows.select(variant_spdi(alt="alternateAlleles", join_alternate_alleles=True).alias("variant_id"))


@query
def zip_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.array("l_quantity", "l_extendedprice", "l_tax").alias("numbers"),
        F.array("l_returnflag", "l_linestatus").alias("flags"),
    )
    exploded = op.zip_explode_cols(rows, ["numbers", "flags"], "z", {"numbers": "number"})
    return exploded.select("l_orderkey", "l_partkey", "z.number", F.col("z.flags").alias("flag"))


@query
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = views.table(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", F.struct("l_partkey", F.array("l_quantity", "l_tax").alias("values")).alias("in")).alias("s"),
        F.array(
            F.struct(
                F.col("l_linenumber").alias("n"),
                F.struct(F.col("l_returnflag").alias("f")).alias("deep"),
                F.array(F.struct(F.col("l_suppkey").alias("k"))).alias("list"),
            )
        ).alias("a"),
        F.array(F.array("l_discount")).alias("plain"),
    )
    flat = op.flatten(nested)
    return flat.select(
        "s_l_orderkey",
        "s_in_l_partkey",
        F.get("s_in_values", F.lit(1)).alias("value_1"),
        F.get("a_n", F.lit(0)).alias("a_n"),
        F.get("a_deep_f", F.lit(0)).alias("a_deep_f"),
        F.get(F.get("a_list_k", F.lit(0)), F.lit(0)).alias("a_list_k"),
        F.get(F.get("plain", F.lit(0)), F.lit(0)).alias("plain"),
    )


@query
def normalise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(" order key "),
        F.struct(F.col("o_totalprice").alias("total-price"), F.col("o_orderstatus").alias("a.b")).alias("the struct"),
    )
    named = op.normalise_field_names(rows)
    return named.select(
        "order_key",
        "the_struct.total_price",
        "the_struct.a_b",
    )


@query
def scalarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    scalar = op.scalarise_biallelic(views.variants(spark, sf_dir))
    return scalar.select("start", "alternateAllele", "INFO_AC", "INFO_AF", "INFO_MLEAC", "INFO_MLEAF")


@query
def first_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_colocated(views.annotations(spark, sf_dir)).select(
        "seq_region_name", "start", F.col("colocated_variant.id").alias("known_id")
    )


@query
def shift_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.shift_start(select_site_columns(views.variants(spark, sf_dir))).select("contigName", "start", "end")


@query
def split_multiallelics(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = op.split_multiallelics(views.multiallelic(spark, sf_dir))
    calls = F.transform("genotypes", lambda g: F.array_join(g.getField("calls"), "/"))
    return split.select(
        "o_orderkey",
        F.get("alternateAlleles", F.lit(0)).alias("alt"),
        F.array_join("INFO_AC", ",").alias("ac"),
        "INFO_DP",
        F.array_join(calls, ",").alias("calls"),
        "splitFromMultiAllelic",
    )


@query
def normalise_trim_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left alignment in repeats, from VCF text to identifiers."""
    table = views.repeat_variants(spark, sf_dir)
    header = VcfHeader.parse(infer_vcf_header(table.schema))
    parsed = parse_vcf_lines(format_vcf_lines(table), header)
    done = workflows.ingest_variants(parsed, views.repeat_genome(spark, sf_dir), chunk=views.STRETCH)
    return done.select(
        F.get("names", F.lit(0)).alias("id"),
        "start",
        "end",
        variant_spdi(alt=F.get("alternateAlleles", F.lit(0))).alias("variant_id"),
    )


@query
def unstack_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.array("l_quantity", "l_discount", "l_tax").alias("value"),
        F.array(F.col("l_quantity") > 25, F.col("l_discount") == 0, F.lit(None).cast("boolean")).alias("missing"),
        F.array(F.lit("quantity"), F.lit("discount"), F.lit("tax")).alias("gene"),
    )
    return op.unstack_arrays(dense, "label", ["value"], labels="gene", missing="missing")


@query
def unstack_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.when(F.col("l_quantity") <= 25, F.col("l_quantity")).alias("quantity"),
        F.col("l_discount").alias("discount"),
    )
    return op.unstack_columns(wide, ["l_orderkey", "l_partkey"], ["quantity", "discount"], "label", "value")


@query
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", (F.col("l_quantity") > 25).alias("missing")
    )
    return op.drop_missing(rows).drop("missing")


# --- filters --------------------------------------------------------------------------------------------------------


@query
def quality_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_quality(views.variants(spark, sf_dir), "and", MIN_QUAL).select("contigName", "start", "qual")


@query
def quality_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.filter_quality(views.variants(spark, sf_dir), "or", MIN_QUAL).select("contigName", "start", "qual")


# --- consequences and joins -------------------------------------------------------------------------------------------


@query
def consequence_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_rows(views.annotations(spark, sf_dir))


@query
def transcript_consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = op.explode_transcript_consequences(views.annotations(spark, sf_dir))
    fields = ("gene_id", "impact", "lof", "sift_score", "polyphen_score", "cadd_raw")
    return exploded.select(
        "seq_region_name", "start", "end", *[F.col(f"transcript_consequence.{f}").alias(f) for f in fields]
    ).withColumns({f: F.col(f).cast("double") for f in fields if f.endswith(("score", "raw"))})


@query
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = workflows.prepare_consequences(views.annotations(spark, sf_dir))
    return op.flatten(
        flagged.select(
            "start",
            F.col("transcript_consequence.gene_id").alias("gene_id"),
            "consequences",
            "impact_level",
            "lof_level",
        )
    )


@query
def onehot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = op.explode_transcript_consequences(views.annotations(spark, sf_dir))
    terms = exploded.select("start", F.col("transcript_consequence.consequence_terms").alias("terms"))
    return op.flatten(op.array_to_onehot_columns(terms, "terms", "has").drop("terms"))


def _joined_columns(joined: DataFrame) -> DataFrame:
    return joined.select(
        "contigName",
        "genotype.gt.sampleId",
        "genotype.num_alt_alleles",
        F.col("transcript_consequence.gene_id").alias("gene_id"),
        F.col("transcript_consequence.cadd_raw").cast("double").alias("cadd_raw"),
    )


def _genotype_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.explode_genotypes(op.with_genotype_states(views.variants(spark, sf_dir)))


@query
def join_consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    consequences = op.explode_transcript_consequences(views.annotations(spark, sf_dir))
    return _joined_columns(op.join_consequences(_genotype_rows(spark, sf_dir), consequences))


@query
def join_consequences_unshifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join on the start as it is, with annotations that are 0-based too."""
    consequences = op.shift_start(op.explode_transcript_consequences(views.annotations(spark, sf_dir)), -1)
    return _joined_columns(op.join_consequences(_genotype_rows(spark, sf_dir), consequences, shift_start_by=0))


@query
def join_consequences_on_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    genotypes = _genotype_rows(spark, sf_dir).withColumn("id", F.get("names", F.lit(0)))
    consequences = op.explode_transcript_consequences(views.annotations(spark, sf_dir))
    return _joined_columns(op.join_consequences(genotypes, consequences, on_id=True))


@query
def join_stored_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables stored in buckets by site: they meet without an exchange, one row a variant and record, and are spread out then."""
    names = [f"varlake_{part}_{uuid.uuid4().hex}" for part in ("variants", "annotations")]
    buckets = max(16, views.table(spark, sf_dir, "lineitem").count() // BUCKET_ROWS)
    variants = write_site_table(op.shift_start(views.variants(spark, sf_dir)), names[0], scratch(spark, "sites"), buckets)
    keys = ("seq_region_name", "start", "end")
    annotations = write_site_table(views.annotations(spark, sf_dir), names[1], scratch(spark, "records"), buckets, keys)
    sites = op.with_genotype_states(op.scalarise_biallelic(variants))
    joined = op.join_consequences(sites, annotations, shift_start_by=0)
    return _joined_columns(op.explode_genotypes(op.explode_transcript_consequences(joined)))


# --- annotation joins -------------------------------------------------------------------------------------------------

_SITE = ["contigName", "start", "end"]


def _number(name: str) -> Column:
    """The number in a name. Minima of strings would need a sorting aggregation; those of numbers are hashed."""
    return F.regexp_extract(name, "([0-9]+)$", 1).cast("long")


@query
def annotate_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.annotate_overlap(
        views.repeated(views.sites(spark, sf_dir)), views.features(spark, sf_dir), "feature", ["size", "brand"], nested=False
    )
    return rows.groupBy(*_SITE).agg(
        F.count("feature").alias("n_features"),
        F.min(_number("feature.name")).alias("first_name"),
        F.max("feature.fields.size").alias("max_size"),
        F.max(_number("feature.fields.brand")).alias("last_brand"),
    )


@query
def annotate_overlap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of at most two features a row; none is lost."""
    rows = op.annotate_overlap(views.repeated(views.sites(spark, sf_dir)), views.features(spark, sf_dir), "feature", ["size"], page_size=2)
    return rows.groupBy(*_SITE).agg(
        F.sum(F.coalesce(F.size("feature"), F.lit(0))).cast("long").alias("n_features"),
        F.coalesce(F.max(F.size("feature")) <= 2, F.lit(True)).alias("bounded"),
        F.sum(F.aggregate(F.coalesce("feature.fields.size", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda s, x: s + x)).alias("sizes"),
    )


@query
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = op.overlap_pairs(views.sites(spark, sf_dir), views.features(spark, sf_dir))
    return pairs.select("contigName", "start", "end", "feature_start", "feature_end", "name")


@query
def annotate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = op.scalarise_biallelic(select_site_columns(views.variants(spark, sf_dir)))
    rows = op.annotate_exact(
        views.repeated(variants.select(*_SITE, "alternateAllele")),
        views.known_variants(spark, sf_dir),
        "known",
        ["quantity"],
        name_col="id",
        allele_col="allele",
        variant_allele_col="alternateAllele",
        nested=False,
    )
    return rows.groupBy("contigName", "start", "alternateAllele").agg(
        F.count("known").alias("n_known"),
        F.min(_number("known.name")).alias("first_name"),
        F.count_if(F.col("known.allele") == F.col("alternateAllele")).alias("n_allele"),
        F.sum("known.fields.quantity").alias("quantity"),
    )


@query
def annotate_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.annotate_colocated(
        views.repeated(views.variants(spark, sf_dir).select(*_SITE)), views.known_variants(spark, sf_dir), nested=False
    )
    known = "colocated_variants"
    return rows.groupBy("contigName", "start").agg(
        F.count(known).alias("n_known"),
        F.min(_number(f"{known}.id")).alias("first_id"),
        F.count_if(F.col(f"{known}.allele_string") == "R/F").alias("n_alleles"),
        F.max(f"{known}.start").alias("known_start"),
        F.sum(f"{known}.strand").alias("strands"),
    )


def _listed(entries: str, *parts: str) -> Column:
    """A list of annotations as text, in its own order."""
    texts = F.transform(entries, lambda e: F.concat_ws("|", *[F.coalesce(_path(e, p).cast("string"), F.lit("-")) for p in parts]))
    return F.array_join(texts, ";")


def _path(entry: Column, path: str) -> Column:
    for name in path.split("."):
        entry = entry.getField(name)
    return entry


@query
def annotate_overlap_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = views.repeated(views.sites(spark, sf_dir))
    rows = op.annotate_overlap(sites, views.features(spark, sf_dir), "feature", ["size", "brand"])
    return rows.select(*_SITE, _listed("feature", "name", "allele", "fields.size", "fields.brand").alias("features"))


@query
def annotate_exact_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = op.scalarise_biallelic(select_site_columns(views.variants(spark, sf_dir)))
    rows = op.annotate_exact(
        views.repeated(variants),
        views.known_variants(spark, sf_dir),
        "known",
        ["quantity"],
        name_col="id",
        allele_col="allele",
        variant_allele_col="alternateAllele",
    )
    return rows.select("contigName", "start", _listed("known", "name", "allele", "fields.quantity").alias("known"))


@query
def annotate_exact_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles of different padding meet; features are named by their coordinates."""
    base = op.scalarise_biallelic(select_site_columns(views.variants(spark, sf_dir)))
    # The same change with two more bases on the left and one on the right.
    padded = base.withColumns(
        {
            "start": F.col("start") - 2,
            "end": F.col("end") + 1,
            "referenceAllele": F.concat(F.lit("GT"), "referenceAllele", F.lit("C")),
            "alternateAllele": F.concat(F.lit("GT"), "alternateAllele", F.lit("C")),
        }
    )
    rows = op.annotate_exact(
        base,
        padded.withColumn("quality", F.col("end") - F.col("start")),
        "padded",
        ["quality"],
        name_col=None,
        allele_col="alternateAllele",
        variant_allele_col="alternateAllele",
        ref_col="referenceAllele",
        variant_ref_col="referenceAllele",
    )
    return rows.select("contigName", "start", _listed("padded", "name", "allele", "fields.quality").alias("padded"))


@query
def annotate_colocated_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.annotate_colocated(
        views.repeated(views.variants(spark, sf_dir).select(*_SITE)), views.known_variants(spark, sf_dir)
    )
    return rows.select(
        "contigName", "start", _listed("colocated_variants", "seq_region_name", "strand", "start", "end", "id", "allele_string").alias("known")
    )


@query
def annotate_cadd(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = op.scalarise_biallelic(select_site_columns(views.variants(spark, sf_dir)))
    base = views.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.expr("concat('chr', cast(o_orderkey % 22 + 1 as string))").alias("contigName"),
        F.expr("o_orderkey * 10").alias("start"),
        F.expr("substr('ACGT', cast(o_orderkey % 4 as int) + 1, 1)").alias("referenceAllele"),
        F.expr("substr('CGTA', cast(o_orderkey % 4 as int) + 1, 1)").alias("alternateAllele"),
    )
    snvs = base.filter("o_orderkey % 2 = 0").selectExpr(
        "*", "o_custkey % 50 / 8D as cadd_raw", "o_custkey % 40 / 4D as cadd_phred"
    )
    indels = base.filter("o_orderkey % 3 = 0").selectExpr(
        "*", "o_custkey % 37 / 8D as cadd_raw", "o_custkey % 31 / 4D as cadd_phred"
    )
    scored = op.annotate_cadd(variants, snvs, indels)
    return scored.select("start", *[F.col(c).cast("double").alias(c) for c in ("cadd_raw", "cadd_phred")])


@query
def annotate_transcript_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    consequences = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.expr("concat('T', cast(l_partkey as string))").alias("transcript_id"),
        F.col("l_linenumber").alias("protein_start"),
        F.expr("concat(l_returnflag, '/', l_linestatus)").alias("amino_acids"),
    )
    scores = views.table(spark, sf_dir, "part").selectExpr(
        "concat('T', cast(p_partkey as string)) as transcript_id",
        "explode(sequence(1, 7)) as protein_start",
        "if(p_size % 2 = 0, 'R/F', 'N/O') as amino_acids",
        "if(p_size > 25, 'deleterious', 'tolerated') as prediction",
        "p_size / 64D as score",
    )
    sift = op.annotate_transcript_scores(consequences, scores, "sift", "b")
    both = op.annotate_transcript_scores(sift, scores, "polyphen", "s")
    return both.withColumns({c: F.col(c).cast("double") for c in ("sift_score", "polyphen_score")})


# --- text, JSON, pipe ---------------------------------------------------------------------------------------------------


@query
def parse_annotation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON text, parsed with every optional part of the schema."""
    custom = F.array(
        F.struct(
            F.col("id").alias("name"),
            F.lit("A").alias("allele"),
            F.struct((F.col("start") % 64 / F.lit(64.0)).alias("AF")).alias("fields"),
        )
    )
    records = views.annotations(spark, sf_dir).withColumns(
        {"custom_annotations": F.struct(custom.alias("GnomADg_v3")), "input": F.lit("not kept")}
    )
    text = records.select(F.to_json(F.struct(*records.columns)).alias("text"))
    schema = AnnotationSchema().with_sift().with_polyphen().with_cadd().with_colocated().with_predefined()
    parsed = parse_annotations(text, schema)
    first = F.get("transcript_consequences", F.lit(0))
    return parsed.select(
        "seq_region_name",
        "start",
        "id",
        "most_severe_consequence",
        first["gene_id"].alias("gene_id"),
        first["lof"].alias("lof"),
        first["sift_score"].cast("double").alias("sift_score"),
        first["polyphen_score"].cast("double").alias("polyphen_score"),
        first["cadd_raw"].cast("double").alias("cadd_raw"),
        F.size("transcript_consequences").alias("n_transcripts"),
        F.get("colocated_variants", F.lit(0))["id"].alias("known_id"),
        F.get("custom_annotations.GnomADg_v3", F.lit(0))["fields"]["AF"].cast("double").alias("af"),
    )


@query
def parse_event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events")
    schema = T.StructType().add("k", "long").add("absent", "string")
    return parse_annotations(events, schema, text="props")


@query
def gtf_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_gtf_lines(views.gtf_lines(spark, sf_dir), ("gene_id", "transcript_id", "exon_number"))


@query
def promoter_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = op.filter_feature(parse_gtf_lines(views.gtf_lines(spark, sf_dir)))
    return op.promoter_regions(transcripts).select("Chromosome", "Start", "End", "Strand", "gene_id", "transcript_id")


@query
def vcf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = {f"INFO_X{j}": F.expr(f"cast((INFO_AC[0] + {j}) % 97 as int)") for j in range(50)}
    table = views.variants(spark, sf_dir, spread=True).withColumns(more)
    header = VcfHeader.parse(infer_vcf_header(table.schema, SAMPLES))
    parsed = op.with_genotype_states(parse_vcf_lines(format_vcf_lines(table, SAMPLES), header))
    return parsed.select(
        sum((F.col(name) for name in more), F.lit(0)).cast("long").alias("sum_x"),
        "contigName",
        "start",
        "end",
        F.array_join("names", ",").alias("names"),
        "referenceAllele",
        F.array_join("alternateAlleles", ",").alias("alts"),
        "qual",
        F.array_join("filters", ",").alias("filters"),
        F.get("INFO_AC", F.lit(0)).alias("ac"),
        F.get("INFO_AF", F.lit(0)).alias("af"),
        F.array_join("genotypes.sampleId", ",").alias("samples"),
        F.array_join("num_alt_alleles", ",").alias("states"),
        F.array_join("genotypes.depth", ",", "-").alias("depths"),
        F.array_join("genotypes.phased", ",").alias("phased"),
    )


@query
def vcf_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of files with different INFO keys and differently ordered samples, read as one table."""
    table = views.variants(spark, sf_dir, spread=True)
    even = F.col("start") % 20 == 0
    backwards = F.reverse("genotypes")
    one, two = scratch(spark, "vcf"), scratch(spark, "vcf")
    write_vcf(table.filter(even).withColumns({"INFO_E": F.col("start"), "genotypes": backwards}), one, SAMPLES)
    write_vcf(table.filter(~even).drop("INFO_AF").withColumn("INFO_O", F.lit(True)), two, SAMPLES)
    read = op.with_genotype_states(read_vcf(spark, [one, two]))
    return read.select(
        "start",
        "INFO_E",
        "INFO_O",
        F.get("INFO_AC", F.lit(0)).alias("ac"),
        F.get("INFO_AF", F.lit(0)).alias("af"),
        F.array_join("genotypes.sampleId", ",").alias("samples"),
        F.array_join("num_alt_alleles", ",").alias("states"),
    )


@query
def vcf_block_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted, block-compressed files with an index, each read back by several tasks."""
    path = scratch(spark, "vcf-blocks")
    write_vcf_blocks(views.variants(spark, sf_dir), path, SAMPLES)
    read = op.with_genotype_states(read_vcf_blocks(spark, path, part_bytes=1 << 18))
    return read.select(
        "contigName",
        "start",
        F.get("INFO_AC", F.lit(0)).alias("ac"),
        F.get("INFO_AF", F.lit(0)).alias("af"),
        F.array_join("genotypes.sampleId", ",").alias("samples"),
        F.array_join("num_alt_alleles", ",").alias("states"),
    )


@query
def vcf_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region and a quality, handed down to the index and the scan."""
    path = scratch(spark, "vcf-region")
    write_vcf_blocks(select_site_columns(views.variants(spark, sf_dir), "qual"), path)
    where = f"contigName in ('chr3', 'chr7') and start >= 2000 and end <= 400000 and qual > {MIN_QUAL}"
    return read_vcf_blocks(spark, path, where=where).select("contigName", "start", "end", "qual")


@query
def pipe_added_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command that declares and adds an INFO key."""
    program = (
        '/^#CHROM/ { print "##INFO=<ID=CSQ,Number=1,Type=String,Description=\\"\\">" } /^#/ { print; next }'
        ' { $8 = "CSQ=" $4 $5; print }'
    )
    sites = select_site_columns(views.variants(spark, sf_dir))
    piped = pipe_lines(sites, ["awk", "-F", "\t", "-v", "OFS=\t", program], output_format="vcf")
    return piped.select("contigName", "start", "INFO_CSQ")


@query
def gtf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "gtf")
    views.gtf_lines(spark, sf_dir).write.text(path)
    return read_gtf(spark, path, ("gene_id", "transcript_id", "exon_number"))


@query
def fasta_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contig of 64 bases in lines of 30 for each order, read in chunks of 32."""
    path = scratch(spark, "fasta")
    genome = views.repeat_genome(spark, sf_dir)
    contig = F.concat(F.lit(">"), "contigName", F.lit("_"), F.col("chunk_id").cast("string"))
    lines = F.regexp_replace("bases", "(.{30})", "$1\n")
    genome.select(F.concat(contig, F.lit(" some text\n"), lines).alias("value")).write.text(path)
    return read_reference_bases(spark, path, chunk=32, overlap=8).select("contigName", "chunk_id", "chunk_start", "bases")


@query
def fasta_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contigs of ``fasta_file`` by an index, those chunks that variants need."""
    path = scratch(spark, "fasta-indexed")
    genome = views.repeat_genome(spark, sf_dir)
    contig = F.concat("contigName", F.lit("_"), F.col("chunk_id").cast("string"))
    lines = F.rtrim(F.regexp_replace("bases", "(.{30})", "$1\n"))
    genome.select(F.concat(F.lit(">"), contig, F.lit(" some text\n"), lines).alias("value")).write.text(path)
    index_fasta(spark, path)
    events = views.repeat_variants(spark, sf_dir).select(
        F.concat("contigName", F.lit("_"), F.expr(f"cast(start div {views.STRETCH} as string)")).alias("contigName"),
        F.expr(f"start % {views.STRETCH} div 32").alias("chunk_id"),
    )
    return read_indexed_bases(spark, path, events, chunk=32, overlap=8)


def _long_repeats(spark: SparkSession, sf_dir: str, by_index: bool) -> DataFrame:
    path = scratch(spark, "long-repeats")
    views.long_repeat_lines(spark, sf_dir).write.text(path)
    if by_index:
        index_fasta(spark, path)
    reference: DataFrame | str = path
    if not by_index:
        # Stored, because every round of the join reads it.
        chunks = scratch(spark, "chunks")
        write_table(read_reference_bases(spark, path), chunks)
        reference = read_table(spark, chunks)
    done = workflows.ingest_variants(views.long_repeat_variants(spark, sf_dir), reference)
    alternate = F.get("alternateAlleles", F.lit(0))
    return done.select(F.get("names", F.lit(0)).alias("id"), "start", "normalized", variant_spdi(alt=alternate).alias("variant_id"))


@query
def normalise_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left alignment over many chunks by reads of an indexed genome."""
    return _long_repeats(spark, sf_dir, True)


@query
def normalise_long_repeats_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a table of chunks, which is joined in rounds."""
    return _long_repeats(spark, sf_dir, False)


@query
def pipe_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    piped = pipe_lines(select_site_columns(views.variants(spark, sf_dir)), ["cat"], output_format="vcf")
    return piped.select(
        "contigName", "start", "end", "referenceAllele", F.array_join("alternateAlleles", ",").alias("alts")
    )


@query
def pipe_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command run part by part, each output line held against the line that it came from."""
    sites = select_site_columns(views.variants(spark, sf_dir)).withColumn("id", F.concat(F.lit("v"), "start"))
    program = '!/^#/ { print $3 " " $4 $5 }'
    path = scratch(spark, "resumable")
    done = pipe_resumable(sites, ["awk", "-F", "\t", program], path, "split(text, ' ')[0]", parts=12, parts_at_once=8)
    return done.select("key", F.split("text", " ")[1].alias("alleles"))


@query
def schema_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of which all records are looked at; half of them hold a number where the others hold text."""
    mixed = F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise(F.concat(F.lit('"n'), "k", F.lit('"')))
    body = [F.lit('{"k":'), "k", F.lit(',"m":'), mixed, F.lit(',"a":[{"b":'), F.col("k") / 4, F.lit("}]}")]
    events = views.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    text = events.select("event_id", F.concat(*body).alias("text"))
    schema, conflicts = infer_schema_of_all(text)
    parsed = text.select("event_id", F.from_json("text", schema).alias("record"))
    return parsed.select(
        "event_id",
        "record.k",
        "record.m",
        F.get("record.a", F.lit(0))["b"].alias("b"),
        F.lit(",".join(conflicts)).alias("conflicts"),
    )


@query
def schema_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields of the packaged schema, looked up by their paths, parse records."""
    schema = AnnotationSchema(struct=T.StructType.fromJson(preset("vep/basic_schema")["version_99"]))
    transcripts = T.ArrayType(schema.field("transcript_consequences"))
    wanted = T.StructType().add("id", schema.field("id")).add("transcript_consequences", transcripts)
    records = views.annotations(spark, sf_dir)
    parsed = parse_annotations(records.select(F.to_json(F.struct(*records.columns)).alias("text")), wanted)
    first = F.get("transcript_consequences", F.lit(0))
    return parsed.select("id", first["gene_id"].alias("gene_id"), F.size("transcript_consequences").alias("n_transcripts"))


@query
def annotate_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``annotate_pipe``, for tables with one allele and one name a row."""
    program = '!/^#/ { printf "{\\"seq_region_name\\":\\"%s\\",\\"start\\":%d,\\"id\\":\\"%s\\",\\"input\\":\\"%s\\"}\\n", $1, $2, $3, $5 }'
    sites = op.scalarise_biallelic(select_site_columns(views.variants(spark, sf_dir)))
    scalar = {"alt": "alternateAllele", "alt_is_array": False, "id": "concat('v', start)", "id_is_array": False}
    return annotate(sites, ["awk", "-F", "\t", program], **scalar).select("seq_region_name", "start", "id")


@query
def write_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table stored, read back and shown whole."""
    nations = views.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return spark.createDataFrame(write_and_check(nations, scratch(spark, "check"), nrows=100))


@query
def annotate_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command that writes one JSON record per variant line."""
    record = (
        r'{"seq_region_name":"%s","start":%d,"id":"%s","input":"x","transcript_consequences":'
        r'[{"gene_id":"%s","consequence_terms":["%s"]}]}\n'
    )
    program = f"!/^#/ {{ printf \"{record.replace(chr(34), chr(92) + chr(34))}\", $1, $2, $3, $4, $5 }}"
    records = annotate(views.variants(spark, sf_dir), ["awk", "-F", "\t", program])
    consequence = F.get("transcript_consequences", F.lit(0))
    return records.select(
        "seq_region_name",
        "start",
        "id",
        consequence["gene_id"].alias("gene_id"),
        F.get(consequence["consequence_terms"], F.lit(0)).alias("term"),
    )


# --- layout and storage ----------------------------------------------------------------------------------------------


@query
def position_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = op.scalarise_biallelic(select_site_columns(views.variants(spark, sf_dir)))
    return op.layout_by_position(table)


@query
def position_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sort_by_position(op.scalarise_biallelic(select_site_columns(views.variants(spark, sf_dir))))


def _disorder(ordered: DataFrame) -> DataFrame:
    """Rows, and how many of them come before their predecessor inside a partition or over partitions."""
    at = F.struct("contigName", "start", "end", "referenceAllele")
    placed = ordered.select(at.alias("at"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    inside = Window.partitionBy("part").orderBy("row")
    stepped = placed.withColumn("back", F.coalesce(F.lag("at").over(inside) > F.col("at"), F.lit(False)))
    parts = stepped.groupBy("part").agg(
        F.count("*").alias("n"), F.count_if("back").alias("back"), F.min("at").alias("low"), F.max("at").alias("high")
    )
    # One row per partition.
    over = F.coalesce(F.lag("high").over(Window.orderBy("part")) > F.col("low"), F.lit(False))
    return parts.withColumn("over", over).agg(
        F.sum("n").alias("n_rows"), F.sum("back").alias("n_back"), F.count_if("over").alias("n_overlapping")
    )


@query
def position_layout_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _disorder(position_layout(spark, sf_dir))


@query
def position_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _disorder(position_sort(spark, sf_dir))


@query
def write_read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in position order to the cluster's shared folder, and read back."""
    path = scratch(spark, "table")
    write_table(op.layout_by_position(select_site_columns(views.variants(spark, sf_dir))), path)
    return op.scalarise_biallelic(read_table(spark, path))
