"""The driver's tables seen as variant tables.

Every view is a row-local projection of a given table (plus one key join for annotations): nested lists are built
from a row's own columns, never by collecting a group, so no list grows with the data or with a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlake.functions._columns import with_computed

N_SAMPLES = 8

#: Vocabulary of the transcript consequences (the part types).
TERMS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


#: Session setting: partitions that the fact tables are dealt to right after the scan. A file of a single row group is one
#: split, which keeps all row-local steps on one core; unset, as it should be for large tables, nothing is dealt out.
SCAN_PARTITIONS = "spark.varlake.scan.partitions"
_ROW_KEYS = {"orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    stored = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    partitions = spark.conf.get(SCAN_PARTITIONS, None)
    return stored.repartition(int(partitions), *_ROW_KEYS[name]) if partitions and name in _ROW_KEYS else stored


def _contig(key: str):
    return F.expr(f"concat('chr', cast({key} % 22 + 1 as string))")


def spread_out(rows: DataFrame) -> DataFrame:
    """The rows in tasks of equal size, whatever the splits of the file: before steps that cost far more than reading."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def variants(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """One biallelic variant per order, with the genotypes of eight samples; ``spread``: see ``spread_out``."""
    genotype = """
        transform(sequence(0, 7), k -> named_struct(
            'sampleId', concat('S', cast(k as string)),
            'phased', k % 2 = 1,
            'calls', case when (o_orderkey % 13 * (k + 1) + o_custkey + k * k) % 9 = 0 then array(0, -1)
                          when (o_orderkey % 13 * (k + 1) + o_custkey + k * k) % 9 <= 4 then array(0, 0)
                          when (o_orderkey % 13 * (k + 1) + o_custkey + k * k) % 9 <= 6 then array(0, 1)
                          when (o_orderkey % 13 * (k + 1) + o_custkey + k * k) % 9 = 7 then array(1, 1)
                          else array(1, 2) end,
            'depth', case when (o_custkey + k) % 11 = 0 then null else cast((o_custkey + 7 * k) % 60 as int) end,
            'conditionalQuality', cast((o_orderkey + k) % 99 as int)))
    """
    orders = table(spark, sf_dir, "orders")
    return with_computed(spread_out(orders) if spread else orders, "genotypes", F.expr(genotype)).select(
        _contig("o_orderkey").alias("contigName"),
        F.expr("o_orderkey * 10").alias("start"),
        F.expr("o_orderkey * 10 + 1").alias("end"),
        F.expr("array(concat('rs', cast(o_orderkey as string)))").alias("names"),
        F.expr("substr('ACGT', cast(o_orderkey % 4 as int) + 1, 1)").alias("referenceAllele"),
        F.expr("array(substr('CGTA', cast(o_orderkey % 4 as int) + 1, 1))").alias("alternateAlleles"),
        F.col("o_totalprice").alias("qual"),
        F.expr(
            "case o_orderstatus when 'F' then array('PASS') when 'O' then array('LowQual', 'q10')"
            " else cast(array() as array<string>) end"
        ).alias("filters"),
        F.expr("array(cast(o_custkey % 9 as int))").alias("INFO_AC"),
        F.expr("array((o_orderkey % 64 + 1) / 128D)").alias("INFO_AF"),
        F.expr("array(cast((o_custkey + 1) % 9 as int))").alias("INFO_MLEAC"),
        F.expr("array((o_orderkey % 32 + 1) / 64D)").alias("INFO_MLEAF"),
        "genotypes",
    )


def multiallelic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``variants``, but every fifth order has two alternate alleles."""
    two = "o_orderkey % 5 = 0"
    genotype = """
        transform(sequence(0, 3), k -> named_struct(
            'sampleId', concat('S', cast(k as string)),
            'calls', array(cast((o_orderkey + k) % 2 as int), cast((o_custkey + k) % 4 as int) - 1)))
    """
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        _contig("o_orderkey").alias("contigName"),
        F.expr("o_orderkey * 10").alias("start"),
        F.expr("o_orderkey * 10 + 1").alias("end"),
        F.lit("A").alias("referenceAllele"),
        F.expr(f"case when {two} then array('C', 'AT') else array('G') end").alias("alternateAlleles"),
        F.expr(
            f"case when {two} then array(cast(o_custkey % 9 as int), cast(o_custkey % 7 as int))"
            " else array(cast(o_custkey % 5 as int)) end"
        ).alias("INFO_AC"),
        F.expr("cast(o_custkey as int)").alias("INFO_DP"),
        F.expr(genotype).alias("genotypes"),
    )


def repeated(rows: DataFrame, key: str = "start") -> DataFrame:
    """``rows`` with every third site (by its order) once more: repeated variants."""
    return rows.select("*", F.explode(F.expr(f"array_repeat(1, if({key} div 10 % 3 = 0, 2, 1))")).alias("__copy")).drop("__copy")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site intervals of 1 to 50 bases, one per order."""
    return table(spark, sf_dir, "orders").select(
        _contig("o_orderkey").alias("contigName"),
        F.expr("o_orderkey * 10").alias("start"),
        F.expr("o_orderkey * 10 + 1 + o_custkey % 50").alias("end"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of 40 to 2,000 bases, one per part."""
    return table(spark, sf_dir, "part").select(
        _contig("p_partkey").alias("contigName"),
        F.expr("p_partkey * 70").alias("start"),
        F.expr("p_partkey * 70 + p_size * 40").alias("end"),
        F.expr("concat('F', cast(p_partkey as string))").alias("name"),
        F.col("p_size").alias("size"),
        F.col("p_brand").alias("brand"),
    )


def known_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known variants at order sites, one per line item."""
    return table(spark, sf_dir, "lineitem").select(
        _contig("l_orderkey").alias("contigName"),
        F.expr("l_orderkey * 10").alias("start"),
        F.expr("l_orderkey * 10 + 1").alias("end"),
        F.expr("cast(l_linenumber % 2 * 2 - 1 as int)").alias("strand"),
        F.expr("concat('rs', cast(l_partkey as string))").alias("id"),
        F.expr("concat(l_returnflag, '/', l_linestatus)").alias("allele_string"),
        F.expr("substr('CGTA', cast((l_orderkey + l_linenumber % 2) % 4 as int) + 1, 1)").alias("allele"),
        F.expr("cast(l_quantity as int)").alias("quantity"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation record per line item, with one or two transcript consequences; 1-based coordinates."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "inner"
    )
    first = """
        named_struct(
            'gene_id', p_brand,
            'impact', element_at(array('HIGH', 'MODERATE', 'LOW', 'MODIFIER'), p_size % 4 + 1),
            'lof', case p_size % 5 when 0 then 'HC' when 1 then 'LC' end,
            'consequence_terms', array_distinct(array(p_type, if(l_returnflag = 'R', 'PROMO', p_type))),
            'sift_score', cast(l_quantity / 64D as float),
            'polyphen_score', cast(if(p_size % 7 = 0, null, p_size / 64D) as float),
            'cadd_raw', cast(l_linenumber / 4D as float))
    """
    second = """
        named_struct(
            'gene_id', concat('Gene#', cast(p_size % 40 as string)),
            'impact', element_at(array('HIGH', 'MODERATE', 'LOW', 'MODIFIER'), (p_size + 1) % 4 + 1),
            'lof', cast(null as string),
            'consequence_terms', array(if(l_linestatus = 'O', 'LARGE', 'SMALL')),
            'sift_score', cast(null as float),
            'polyphen_score', cast(l_linenumber / 8D as float),
            'cadd_raw', cast(l_quantity / 4D as float))
    """
    return lines.select(
        _contig("l_orderkey").alias("seq_region_name"),
        F.expr("l_orderkey * 10 + 1").alias("start"),
        F.expr("l_orderkey * 10 + 1").alias("end"),
        F.expr("concat('rs', cast(l_orderkey as string))").alias("id"),
        F.col("p_type").alias("most_severe_consequence"),
        F.expr(
            "if(l_returnflag = 'N', array(named_struct('impact', 'MODIFIER', 'consequence_terms',"
            " array(concat('intergenic_', l_linestatus)))), null)"
        ).alias("intergenic_consequences"),
        F.expr("array(named_struct('consequence_terms', cast(array() as array<string>)))").alias(
            "motif_feature_consequences"
        ),
        F.expr(
            "array(named_struct('consequence_terms', array(concat('regulatory_', cast(p_size % 3 as string)))))"
        ).alias("regulatory_feature_consequences"),
        F.expr(f"if(l_linenumber % 2 = 0, array({first}, {second}), array({first}))").alias("transcript_consequences"),
        F.expr(
            "if(l_linenumber <= 3, array(named_struct('id', concat('rs', cast(l_partkey as string)),"
            " 'strand', 1)), cast(array() as array<struct<id: string, strand: int>>))"
        ).alias("colocated_variants"),
    )


# --- a repetitive genome ---------------------------------------------------------------------------------------------
#
# Every order owns a stretch of 64 bases: a G, then 3 to 12 copies of a unit without G, then G to the end. Variants add
# or remove copies somewhere inside; left-aligned, they all sit at the stretch's first base.

STRETCH = 64

_UNIT = "element_at(array('CA', 'T', 'CTA'), cast(o_custkey % 3 as int) + 1)"
_N = "cast(o_custkey % 10 + 3 as int)"


def _stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        _contig("o_orderkey").alias("contigName"),
        F.expr("o_orderkey div 22").alias("chunk_id"),
        F.expr(_UNIT).alias("unit"),
        F.expr(_N).alias("n"),
    )


def repeat_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference chunks without overlap."""
    return _stretches(spark, sf_dir).select(
        "contigName",
        "chunk_id",
        F.expr(f"chunk_id * {STRETCH}").alias("chunk_start"),
        F.expr(f"rpad(concat('G', repeat(unit, n)), {STRETCH}, 'G')").alias("bases"),
    )


def repeat_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not normalised variants in the repeats: substitutions, deletions, insertions and two-allele deletions."""
    rows = _stretches(spark, sf_dir).withColumns(
        {
            # The event follows the j-th copy; two copies and a trailing one always fit behind it.
            "j": F.expr("cast(o_orderkey % (n - 2) as int)"),
            "kind": F.expr("o_orderkey % 5"),
        }
    )
    anchored = rows.withColumn("anchor", F.expr("if(j = 0, 'G', right(unit, 1))"))
    inside = f"chunk_id * {STRETCH} + j * length(unit)"
    return anchored.select(
        "contigName",
        F.expr(f"case when kind <= 1 then chunk_id * {STRETCH} else {inside} end").alias("start"),
        F.expr("array(concat('rs', cast(o_orderkey as string)))").alias("names"),
        F.expr(
            """
            case kind when 0 then 'G'
                      when 1 then concat('G', unit)
                      when 2 then concat(anchor, unit, unit, unit)
                      when 3 then concat(anchor, unit)
                      else concat(anchor, unit, unit) end
            """
        ).alias("referenceAllele"),
        F.expr(
            """
            case kind when 0 then array('T')
                      when 1 then array(concat('T', unit))
                      when 2 then array(concat(anchor, unit), concat(anchor, unit, unit))
                      when 3 then array(concat(anchor, unit, unit, unit))
                      else array(concat(anchor, unit)) end
            """
        ).alias("alternateAlleles"),
    ).withColumn("end", F.col("start") + F.length("referenceAllele"))


# --- long repeats ----------------------------------------------------------------------------------------------------
#
# Every customer owns a contig of LONG bases: a G, then copies of a unit without G over several chunks, then G to the end. The
# events lie behind the last copy but one; left-aligned, they all sit at the contig's first base.

LONG = 5_000


def _long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.expr("concat('c', cast(c_custkey as string))").alias("contigName"),
        "c_custkey",
        F.expr("element_at(array('CA', 'T', 'CTA'), cast(c_custkey % 3 as int) + 1)").alias("unit"),
        F.expr("cast(1100 + c_custkey % 400 as int)").alias("n"),
    )


def long_repeat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA text with 70 bases a line."""
    bases = F.expr(f"rpad(concat('G', repeat(unit, n)), {LONG}, 'G')")
    lines = F.regexp_replace(bases, "(.{70})", "$1\n")
    # A few bytes of the table become 5,000 of text.
    return spread_out(_long_repeats(spark, sf_dir)).select(F.concat(F.lit(">"), "contigName", F.lit("\n"), F.rtrim(lines)).alias("value"))


def long_repeat_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deletion, an insertion or both deletions of one and two copies at each contig's last copies."""
    rows = _long_repeats(spark, sf_dir).withColumns({"anchor": F.expr("right(unit, 1)"), "kind": F.expr("c_custkey div 3 % 3")})
    return rows.select(
        "contigName",
        F.expr("cast((n - 3) * length(unit) as bigint)").alias("start"),
        F.expr("array(concat('rs', cast(c_custkey as string)))").alias("names"),
        F.expr(
            "case kind when 0 then concat(anchor, unit) when 1 then anchor else concat(anchor, unit, unit) end"
        ).alias("referenceAllele"),
        F.expr(
            "case kind when 0 then array(anchor) when 1 then array(concat(anchor, unit, unit))"
            " else array(concat(anchor, unit), anchor) end"
        ).alias("alternateAlleles"),
    ).withColumn("end", F.col("start") + F.length("referenceAllele"))


# --- text -----------------------------------------------------------------------------------------------------------


def gtf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene-model lines, one per part."""
    return table(spark, sf_dir, "part").select(
        F.expr(
            r"""
            concat_ws('\t',
                concat('chr', cast(p_partkey % 22 + 1 as string)),
                'model',
                element_at(array('transcript', 'exon', 'gene'), p_size % 3 + 1),
                cast(p_partkey * 70 + 1 as string),
                cast(p_partkey * 70 + p_size * 40 as string),
                if(p_size % 2 = 0, '.', cast(p_size / 4D as string)),
                if(p_partkey % 2 = 0, '+', '-'),
                if(p_size % 4 = 3, '.', cast(p_size % 4 as string)),
                concat('gene_id "', p_brand, '"; transcript_id "T', cast(p_partkey as string), '";',
                       if(p_size % 3 = 1, concat(' exon_number ', cast(p_size as string), ';'), '')))
            """
        ).alias("value")
    )
