"""The same results in plain SQL (DuckDB dialect), written from the views' definitions, not from the Spark plans."""

from __future__ import annotations

from varlake.plans.catalog import MIN_QUAL
from varlake.plans.views import N_SAMPLES, STRETCH, TERMS

IMPACTS = ("HIGH", "MODERATE", "LOW", "MODIFIER")
LOFS = ("HC", "LC")

_VARIANT = """
variant as (
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
           'chr' || (o_orderkey % 22 + 1) as contig, o_orderkey * 10 as start0,
           substr('ACGT', cast(o_orderkey % 4 as int) + 1, 1) as ref,
           substr('CGTA', cast(o_orderkey % 4 as int) + 1, 1) as alt,
           cast((o_orderkey % 64 + 1) / 128.0 as double) as af
    from orders
)"""

_GT = f"""
gt as (
    select *, 'S' || k as sample,
           case when mix = 0 then -1 when mix <= 4 then 0 when mix <= 6 then 1 when mix = 7 then 2 else 3 end as n_alt,
           case when mix = 0 then [0, -1] when mix <= 4 then [0, 0] when mix <= 6 then [0, 1]
                when mix = 7 then [1, 1] else [1, 2] end as calls,
           case when (o_custkey + k) % 11 = 0 then null else cast((o_custkey + 7 * k) % 60 as int) end as depth,
           cast((o_orderkey + k) % 99 as int) as gq
    from (
        select v.*, cast(t.k as int) as k, (o_orderkey % 13 * (t.k + 1) + o_custkey + t.k * t.k) % 9 as mix
        from variant v, range({N_SAMPLES}) t(k)
    )
)"""

_CSQ = """
csq as (
    select l_orderkey, 'chr' || (l_orderkey % 22 + 1) as contig, l_orderkey * 10 as start0, p_brand as gene_id,
           (['HIGH', 'MODERATE', 'LOW', 'MODIFIER'])[p_size % 4 + 1] as impact,
           case p_size % 5 when 0 then 'HC' when 1 then 'LC' end as lof,
           list_distinct([p_type, case when l_returnflag = 'R' then 'PROMO' else p_type end]) as terms,
           l_quantity / 64 as sift, case when p_size % 7 = 0 then null else p_size / 64.0::double end as polyphen,
           l_linenumber / 4.0::double as cadd
    from lineitem join part on l_partkey = p_partkey
    union all
    select l_orderkey, 'chr' || (l_orderkey % 22 + 1), l_orderkey * 10, 'Gene#' || (p_size % 40),
           (['HIGH', 'MODERATE', 'LOW', 'MODIFIER'])[(p_size + 1) % 4 + 1], null,
           [case when l_linestatus = 'O' then 'LARGE' else 'SMALL' end],
           null, l_linenumber / 8.0::double, l_quantity / 4
    from lineitem join part on l_partkey = p_partkey where l_linenumber % 2 = 0
)"""

_ZYGOSITY = """
zyg as (
    select o_orderkey as zkey, count(*) filter (n_alt = 2) as n_homo, count(*) filter (n_alt = 1) as n_hetero,
           count(*) filter (n_alt = 0) as n_ref, count(*) filter (n_alt = -1) as n_not_measured
    from gt group by o_orderkey
)"""

AND_99 = "o_orderstatus = 'F' and o_totalprice >= 99"
AND_QUAL = f"o_orderstatus = 'F' and o_totalprice >= {MIN_QUAL}"
OR_QUAL = f"(o_orderstatus = 'F' or o_totalprice >= {MIN_QUAL})"


def _flag_columns() -> list[tuple[str, str]]:
    """(result name, condition) of every flag."""
    return [
        *[(f"consequences_{t}", f"list_contains(terms, '{t}')") for t in TERMS],
        *[(f"impact_level_{i}", f"impact = '{i}'") for i in IMPACTS],
        *[(f"lof_level_{l}", f"lof = '{l}'") for l in LOFS],
    ]


def _measures(measure: str, where: str, prefix: str) -> list[str]:
    guard = f" filter ({where})" if where else ""
    out = []
    for name, flag in _flag_columns():
        if measure == "count":
            out.append(f"cast(sum(cast({flag} as int)){guard} as bigint) as {prefix}{name}")
        else:
            out.append(f"max(case when {flag} then 1 - af else 0.0::double end){guard} as {prefix}{name}")
    for score in ("sift", "polyphen", "cadd"):
        for fn, suffix in (("min", "min"), ("avg", "mean"), ("max", "max")):
            out.append(f"{fn}({score}){guard} as {prefix}scores_{score}_{suffix}")
    return out


def _burden(measure: str, where: str) -> str:
    columns = [*_measures(measure, "n_alt = 1", "heterozygous_"), *_measures(measure, "n_alt = 2", "homozygous_")]
    return f"""
        with {_VARIANT}, {_GT}, {_CSQ}, {_ZYGOSITY}
        select gt.contig as "contigName", gene_id, sample as "sampleId", {", ".join(columns)}
        from gt join csq on gt.contig = csq.contig and gt.start0 = csq.start0 join zyg on zkey = gt.o_orderkey
        where {where} group by gt.contig, gene_id, sample
    """


def _per_state(measure: str) -> str:
    return f"""
        with {_VARIANT}, {_GT}, {_CSQ}
        select gt.contig as "contigName", sample as "sampleId", cast(n_alt as int) as num_alt_alleles, gene_id,
               {", ".join(_measures(measure, "", ""))}
        from gt join csq on gt.contig = csq.contig and gt.start0 = csq.start0
        where {AND_99} group by gt.contig, sample, n_alt, gene_id
    """


_JOINED = f"""
    with {_VARIANT}, {_GT}, {_CSQ}
    select gt.contig as "contigName", sample as "sampleId", cast(n_alt as int) as num_alt_alleles, gene_id,
           cadd as cadd_raw
    from gt join csq on gt.contig = csq.contig and gt.start0 = csq.start0
"""

_RARE = f"""
    with {_VARIANT}, {_GT}, {_ZYGOSITY}
    select contig as "contigName", start0 as start, sample as "sampleId", cast(n_alt as int) as num_alt_alleles
    from gt join zyg on zkey = o_orderkey
    where {AND_99} and ((n_alt = 1 and n_hetero <= 2) or (n_alt = 2 and n_homo <= 1))
"""

_MULTI = """
multi as (
    select *, 'chr' || (o_orderkey % 22 + 1) as contig, o_orderkey * 10 as start0,
           case when o_orderkey % 5 = 0 then ['C', 'AT'] else ['G'] end as alts,
           case when o_orderkey % 5 = 0 then [o_custkey % 9, o_custkey % 7] else [o_custkey % 5] end as ac
    from orders
)"""

_SITES = """
site as (
    select 'chr' || (o_orderkey % 22 + 1) as contig, o_orderkey * 10 as s, o_orderkey * 10 + 1 + o_custkey % 50 as e
    from orders
), site_copy as (
    select * from site union all select * from site where s // 10 % 3 = 0
), feature as (
    select 'chr' || (p_partkey % 22 + 1) as contig, p_partkey * 70 as fs, p_partkey * 70 + p_size * 40 as fe,
           'F' || p_partkey as name, p_size as size, p_brand as brand
    from part
)"""

_KNOWN = """
variant_copy as (
    select * from variant union all select * from variant where o_orderkey % 3 = 0
), known as (
    select l_orderkey, 'rs' || l_partkey as id, l_returnflag || '/' || l_linestatus as alleles,
           l_linenumber % 2 * 2 - 1 as strand, l_quantity as quantity,
           substr('CGTA', cast((l_orderkey + l_linenumber % 2) % 4 as int) + 1, 1) as allele
    from lineitem
)"""

_REPEATS = f"""
repeats as (
    select *, (['CA', 'T', 'CTA'])[o_custkey % 3 + 1] as unit, o_orderkey % 5 as kind,
           o_orderkey // 22 * {STRETCH} as start0
    from orders
), canonical as (
    select o_orderkey, start0, 'G' as ref, 'T' as alt, unit, o_orderkey as k from repeats where kind <= 1
    union all select o_orderkey, start0, 'G' || unit || unit, 'G', unit, o_orderkey from repeats where kind = 2
    union all select o_orderkey, start0, 'G' || unit, 'G', unit, o_orderkey from repeats where kind in (2, 4)
    union all select o_orderkey, start0, 'G', 'G' || unit || unit, unit, o_orderkey from repeats where kind = 3
)"""


_LONG_REPEATS = """
    with owned as (
        select c_custkey, (['CA', 'T', 'CTA'])[c_custkey % 3 + 1] as unit, c_custkey // 3 % 3 as kind from customer
    ), canonical as (
        select c_custkey, 'G' || unit as ref, 'G' as alt from owned where kind in (0, 2)
        union all select c_custkey, 'G', 'G' || unit || unit from owned where kind = 1
        union all select c_custkey, 'G' || unit || unit, 'G' from owned where kind = 2
    )
    select 'rs' || c_custkey as id, cast(0 as bigint) as start, true as normalized,
           'c' || c_custkey || ':0:' || ref || ':' || alt as variant_id
    from canonical
"""


def _ecdf(value: str, source: str) -> str:
    return f"""
        select v as {value}, count(*) as n, any_value(c) as ecdf
        from (select {source} as v, cume_dist() over (order by {source}) as c from base) group by v
    """


def _ecdf_named(name: str) -> str:
    return f"""
        select '{name}' as quantity, cast(v as int) as value, count(*) as n, any_value(c) as ecdf
        from (select {name} as v, cume_dist() over (order by {name}) as c from base) group by v
    """


_GTF = """
gtf as (
    select 'chr' || (p_partkey % 22 + 1) as chrom, (['transcript', 'exon', 'gene'])[p_size % 3 + 1] as feature,
           p_partkey * 70 as s, p_partkey * 70 + p_size * 40 as e,
           case when p_size % 2 = 0 then null else p_size / 4.0::double end as score,
           case when p_partkey % 2 = 0 then '+' else '-' end as strand,
           case when p_size % 4 = 3 then null else p_size % 4 end as frame,
           p_brand as gene_id, 'T' || p_partkey as transcript_id,
           case when p_size % 3 = 1 then cast(p_size as varchar) end as exon_number
    from part
)"""

_SITE_ROWS = f"""
    with {_VARIANT}
    select contig as "contigName", start0 as start, start0 + 1 as "end", ref as "referenceAllele",
           alt as "alternateAllele" from variant
"""


_ORDERED = """
    select cast(count(*) as bigint) as n_rows, cast(0 as bigint) as n_back, cast(0 as bigint) as n_overlapping from orders
"""


def all_oracles() -> dict[str, str]:
    burden = _burden("count", AND_99)
    min_af = _burden("min_af", OR_QUAL)
    flags = _flag_columns()
    return {
        "gene_burden_counts": burden,
        "gene_burden_one_pass": burden,
        "gene_burden_bitmaps": burden,
        "gene_burden_two_step": burden,
        "gene_burden_min_af": min_af,
        "gene_burden_min_af_two_step": min_af,
        "gene_burden_rare": _burden(
            "count", f"{AND_99} and ((n_alt = 1 and n_hetero <= 2) or (n_alt = 2 and n_homo <= 2))"
        ),
        "count_consequences": _per_state("count"),
        "min_af_consequences": _per_state("min_af"),
        "genotype_states": f"""
            with {_VARIANT}, {_GT}
            select contig as "contigName", start0 as start, string_agg(cast(n_alt as varchar), ',' order by k) as states
            from gt group by contig, start0
        """,
        "zygosity_summary": f"""
            with {_VARIANT}, {_GT}
            select start0 as start, cast(count(*) as int) as n_samples, cast(count(*) filter (n_alt = 2) as int) as n_homo,
                   cast(count(*) filter (n_alt = 1) as int) as n_hetero,
                   cast(count(*) filter (n_alt = 0) as int) as n_ref,
                   cast(count(*) filter (n_alt = -1) as int) as n_not_measured,
                   case when count(*) filter (n_alt = 3) > 0 then '3' else '' end as other
            from gt group by start0
        """,
        "single_genotypes": f"""
            with {_VARIANT}, {_GT}
            select contig as "contigName", start0 as start, sample as "sampleId", k % 2 = 1 as phased, depth,
                   cast(n_alt as int) as num_alt_alleles from gt
        """,
        "rare_genotypes": _RARE,
        "rare_genotypes_filter": _RARE,
        "call_summary": f"""
            with {_VARIANT}, {_GT}, per as (
                select start0, n_alt, list_filter(calls, lambda c: c >= 0) as called, calls from gt
            )
            select start0 as start, count(*) filter (n_alt >= 0) / cast(count(*) as double) as "callRate",
                   cast(count(*) filter (n_alt >= 0) as int) as "nCalled",
                   cast(count(*) filter (n_alt < 0) as int) as "nUncalled",
                   cast(count(*) filter (n_alt in (1, 3)) as int) as "nHet",
                   cast(sum((calls[1] > 0)::int + (calls[2] > 0)::int) as int) as "nNonRef",
                   cast(sum(len(called)) as int) as "nAllelesCalled",
                   count(*) filter (n_alt = 0) || ',' || count(*) filter (n_alt = 2) as "nHomozygous",
                   cast(sum((calls[1] = 0)::int + (calls[2] = 0)::int) as int) || ','
                       || cast(sum((calls[1] = 1)::int + (calls[2] = 1)::int) as int) as "alleleCounts",
                   cast(sum((calls[1] = 1)::int + (calls[2] = 1)::int) as int)
                       / cast(sum(len(called)) as double) as alt_frequency
            from per group by start0
        """,
        "depth_quality_summary": f"""
            with {_VARIANT}, {_GT}
            select start0 as start,
                   round(avg(depth), 6) as dp_mean, round(stddev_samp(depth), 6) as "dp_stdDev",
                   cast(min(depth) as double) as dp_min, cast(max(depth) as double) as dp_max,
                   round(avg(gq), 6) as gq_mean, round(stddev_samp(gq), 6) as "gq_stdDev",
                   cast(min(gq) as double) as gq_min, cast(max(gq) as double) as gq_max
            from gt group by start0
        """,
        "allele_count_table": f"""
            with {_VARIANT}, {_GT}
            select cast(any_value(o_custkey % 9) as int) as "INFO_AC", cast(count(*) as int) as n_samples,
                   cast(count(*) filter (n_alt = 2) as int) as n_homo,
                   cast(count(*) filter (n_alt = 1) as int) as n_hetero,
                   cast(count(*) filter (n_alt = 0) as int) as n_ref,
                   cast(count(*) filter (n_alt = -1) as int) as n_not_measured
            from gt where {AND_99} group by o_orderkey
        """,
        "ecdf_allele_counts": f"""
            with {_VARIANT}, {_GT}, {_ZYGOSITY},
            base as (select o_custkey % 9 as INFO_AC, n_homo, n_hetero from variant join zyg on zkey = o_orderkey
                     where {AND_99})
            {_ecdf_named("INFO_AC")} union all {_ecdf_named("n_homo")} union all {_ecdf_named("n_hetero")}
        """,
        "ecdf_quality": f"with base as (select o_totalprice from orders) {_ecdf('qual', 'o_totalprice')}",
        "spdi_biallelic": f"""
            with {_MULTI} select contig || ':' || start0 || ':A:' || a as variant_id
            from (select contig, start0, unnest(alts) as a from multi)
        """,
        "spdi_multiallelic": f"""
            with {_MULTI} select contig || ':' || start0 || ':A:' || array_to_string(alts, ',') as variant_id from multi
        """,
        "zip_explode": """
            select l_orderkey, l_partkey, l_quantity as number, l_returnflag as flag from lineitem
            union all select l_orderkey, l_partkey, l_extendedprice, l_linestatus from lineitem
            union all select l_orderkey, l_partkey, l_tax, null from lineitem
        """,
        "flatten_nested": """
            select l_orderkey as s_l_orderkey, l_partkey as s_in_l_partkey, l_tax as value_1, l_linenumber as a_n,
                   l_returnflag as a_deep_f, l_suppkey as a_list_k, l_discount as plain from lineitem
        """,
        "normalise_names": """
            select o_orderkey as order_key, o_totalprice as total_price, o_orderstatus as a_b from orders
        """,
        "scalarise": f"""
            with {_VARIANT}
            select start0 as start, alt as "alternateAllele", cast(o_custkey % 9 as int) as "INFO_AC", af as "INFO_AF",
                   cast((o_custkey + 1) % 9 as int) as "INFO_MLEAC",
                   cast((o_orderkey % 32 + 1) / 64.0 as double) as "INFO_MLEAF" from variant
        """,
        "first_colocated": """
            select 'chr' || (l_orderkey % 22 + 1) as seq_region_name, l_orderkey * 10 + 1 as start,
                   case when l_linenumber <= 3 then 'rs' || l_partkey end as known_id
            from lineitem join part on l_partkey = p_partkey
        """,
        "shift_start": f"""
            with {_VARIANT} select contig as "contigName", start0 + 1 as start, start0 + 1 as "end" from variant
        """,
        "split_multiallelics": f"""
            with {_MULTI}, alleles as (
                select *, unnest(range(1, len(alts) + 1)) as p from multi
            ), recoded as (
                select o_orderkey, p, alts, ac, o_custkey, k,
                       (o_orderkey + k) % 2 as c1, (o_custkey + k) % 4 - 1 as c2
                from alleles, range(4) t(k)
            )
            select o_orderkey, alts[p] as alt, cast(ac[p] as varchar) as ac, cast(any_value(o_custkey) as int) as "INFO_DP",
                   string_agg(
                       case when len(alts) = 1 then c1 || '/' || c2
                            else (case when c1 = p then 1 when c1 = 0 then 0 else -1 end) || '/'
                                 || (case when c2 = p then 1 when c2 = 0 then 0 else -1 end) end, ',' order by k) as calls,
                   len(alts) > 1 as "splitFromMultiAllelic"
            from recoded group by o_orderkey, p, alts, ac
        """,
        "normalise_trim_shift": f"""
            with {_REPEATS}
            select 'rs' || o_orderkey as id, start0 as start, start0 + length(ref) as "end",
                   'chr' || (o_orderkey % 22 + 1) || ':' || start0 || ':' || ref || ':' || alt as variant_id
            from canonical
        """,
        "unstack_long": """
            select l_orderkey, l_partkey, 'quantity' as label, l_quantity as value from lineitem where l_quantity <= 25
            union all select l_orderkey, l_partkey, 'discount', l_discount from lineitem where l_discount <> 0
            union all select l_orderkey, l_partkey, 'tax', l_tax from lineitem
        """,
        "unstack_columns": """
            select l_orderkey, l_partkey, 'quantity' as label, l_quantity as value from lineitem where l_quantity <= 25
            union all select l_orderkey, l_partkey, 'discount', l_discount from lineitem
        """,
        "drop_missing": "select l_orderkey, l_quantity from lineitem where not l_quantity > 25",
        "quality_and": f"""
            with {_VARIANT} select contig as "contigName", start0 as start, o_totalprice as qual from variant
            where {AND_QUAL}
        """,
        "quality_or": f"""
            with {_VARIANT} select contig as "contigName", start0 as start, o_totalprice as qual from variant
            where {OR_QUAL}
        """,
        "consequence_terms": f"""
            with {_CSQ}, lines as (select * from lineitem join part on l_partkey = p_partkey)
            select distinct 'transcript_consequences' as csq_type, unnest(terms) as term from csq
            union all select distinct 'intergenic_consequences', 'intergenic_' || l_linestatus from lines
                      where l_returnflag = 'N'
            union all select distinct 'regulatory_feature_consequences', 'regulatory_' || (p_size % 3) from lines
        """,
        "transcript_consequences": f"""
            with {_CSQ}
            select contig as seq_region_name, start0 + 1 as start, start0 + 1 as "end", gene_id, impact, lof,
                   sift as sift_score, polyphen as polyphen_score, cadd as cadd_raw from csq
        """,
        "one_hot": f"""
            with {_CSQ} select start0 + 1 as start, gene_id, {", ".join(f"{flag} as {name}" for name, flag in flags)}
            from csq
        """,
        "onehot_columns": f"""
            with {_CSQ} select start0 + 1 as start, {", ".join(f"list_contains(terms, '{t}') as has_{t}" for t in TERMS)}
            from csq
        """,
        "join_consequences": _JOINED,
        "join_consequences_unshifted": _JOINED,
        "join_consequences_on_id": _JOINED,
        "join_stored_sites": _JOINED,
        "annotate_overlap_pages": f"""
            with {_SITES}
            select site.contig as "contigName", s as start, e as "end", count(name) as n_features, true as bounded,
                   cast(coalesce(sum(size), 0) as bigint) as sizes
            from site_copy site left join feature on site.contig = feature.contig and s < fe and fs < e
            group by site.contig, s, e
        """,
        "annotate_overlap": f"""
            with {_SITES}
            select site.contig as "contigName", s as start, e as "end", count(name) as n_features,
                   min(cast(substr(name, 2) as bigint)) as first_name, max(size) as max_size,
                   max(cast(split_part(brand, '#', 2) as bigint)) as last_brand
            from site_copy site left join feature on site.contig = feature.contig and s < fe and fs < e
            group by site.contig, s, e
        """,
        "annotate_overlap_nested": f"""
            with {_SITES}, lists as (
                select site.contig, s, e,
                       string_agg(name || '|-|' || size || '|' || brand, ';' order by name, size, brand) as features
                from site join feature on site.contig = feature.contig and s < fe and fs < e group by site.contig, s, e
            )
            select contig as "contigName", s as start, e as "end", features from site_copy left join lists using (contig, s, e)
        """,
        "annotate_exact_nested": f"""
            with {_VARIANT}, {_KNOWN}, lists as (
                select l_orderkey, allele, string_agg(id || '|' || allele || '|' || cast(quantity as int), ';' order by id, cast(quantity as int)) as known
                from known group by l_orderkey, allele
            )
            select contig as "contigName", start0 as start, known
            from variant_copy left join lists on l_orderkey = o_orderkey and allele = alt
        """,
        "annotate_exact_coordinates": f"""
            with {_VARIANT}
            select contig as "contigName", start0 as start,
                   contig || ':' || (start0 - 1) || '-' || (start0 + 2) || '|GT' || alt || 'C|4' as padded
            from variant
        """,
        "annotate_colocated_nested": f"""
            with {_VARIANT}, {_KNOWN}, lists as (
                select l_orderkey, string_agg('chr' || (l_orderkey % 22 + 1) || '|' || strand || '|' || (l_orderkey * 10 + 1) || '|'
                           || (l_orderkey * 10 + 1) || '|' || id || '|' || alleles, ';' order by strand, id, alleles) as known
                from known group by l_orderkey
            )
            select contig as "contigName", start0 as start, known from variant_copy left join lists on l_orderkey = o_orderkey
        """,
        "overlap_pairs": f"""
            with {_SITES}
            select site.contig as "contigName", s as start, e as "end", fs as feature_start, fe as feature_end, name
            from site join feature on site.contig = feature.contig and s < fe and fs < e
        """,
        "annotate_exact": f"""
            with {_VARIANT}, {_KNOWN}
            select contig as "contigName", start0 as start, alt as "alternateAllele", count(id) as n_known,
                   min(cast(substr(id, 3) as bigint)) as first_name, count(id) as n_allele,
                   cast(sum(quantity) as bigint) as quantity
            from variant_copy v
                 left join known on l_orderkey = o_orderkey and allele = alt
            group by contig, start0, alt
        """,
        "annotate_colocated": f"""
            with {_VARIANT}, {_KNOWN}
            select contig as "contigName", start0 as start, count(id) as n_known,
                   min(cast(substr(id, 3) as bigint)) as first_id, count(*) filter (alleles = 'R/F') as n_alleles, case when count(id) > 0 then start0 + 1 end as known_start,
                   cast(sum(strand) as bigint) as strands
            from variant_copy v left join known on l_orderkey = o_orderkey
            group by contig, start0
        """,
        "annotate_cadd": f"""
            with {_VARIANT}, scored as (
                select *, case when o_orderkey % 2 = 0 then o_custkey % 50 / 8.0::double end as raw1,
                       o_custkey % 40 / 4.0::double as phred1,
                       case when o_orderkey % 3 = 0 then o_custkey % 37 / 8.0::double end as raw2,
                       o_custkey % 31 / 4.0::double as phred2
                from variant
            )
            select start0 as start, greatest(raw1, raw2) as cadd_raw,
                   case when raw1 is null and raw2 is null then null
                        when raw2 is null or raw1 > raw2 then phred1
                        when raw1 is null or raw2 > raw1 then phred2
                        else greatest(phred1, phred2) end as cadd_phred
            from scored
        """,
        "annotate_transcript_scores": """
            with c as (select *, l_returnflag || '/' || l_linestatus as aa from lineitem)
            select l_orderkey, 'T' || l_partkey as transcript_id, l_linenumber as protein_start, aa as amino_acids,
                   case when p_size > 25 then 'deleterious' when p_size is not null then 'tolerated' end as sift_prediction,
                   p_size / 64.0::double as sift_score, cast(null as varchar) as polyphen_prediction,
                   p_size / 64.0::double as polyphen_score
            from c left join part on l_partkey = p_partkey and aa = case when p_size % 2 = 0 then 'R/F' else 'N/O' end
        """,
        "parse_annotation_json": """
            select 'chr' || (l_orderkey % 22 + 1) as seq_region_name, l_orderkey * 10 + 1 as start,
                   'rs' || l_orderkey as id, p_type as most_severe_consequence, p_brand as gene_id,
                   case p_size % 5 when 0 then 'HC' when 1 then 'LC' end as lof, l_quantity / 64 as sift_score,
                   case when p_size % 7 = 0 then null else p_size / 64.0::double end as polyphen_score,
                   l_linenumber / 4.0::double as cadd_raw,
                   case when l_linenumber % 2 = 0 then 2 else 1 end as n_transcripts,
                   case when l_linenumber <= 3 then 'rs' || l_partkey end as known_id,
                   cast((l_orderkey * 10 + 1) % 64 / 64.0 as double) as af
            from lineitem join part on l_partkey = p_partkey
        """,
        "parse_event_json": """
            select cast(json_extract(props, '$.k') as bigint) as k, cast(null as varchar) as absent from events
        """,
        "gtf_parse": f"""
            with {_GTF}
            select chrom as "Chromosome", 'model' as "Source", feature as "Feature", s as "Start", e as "End",
                   score as "Score", strand as "Strand", frame as "Frame", gene_id, transcript_id, exon_number from gtf
        """,
        "promoter_regions": f"""
            with {_GTF}
            select chrom as "Chromosome", case when strand = '+' then s - 1000 else e end as "Start",
                   case when strand = '+' then s else e + 1000 end as "End", strand as "Strand", gene_id, transcript_id
            from gtf where feature = 'transcript'
        """,
        "vcf_round_trip": f"""
            with {_VARIANT}, {_GT}
            select contig as "contigName", start0 as start, start0 + 1 as "end", 'rs' || o_orderkey as names,
                   ref as "referenceAllele", alt as alts, o_totalprice as qual,
                   case o_orderstatus when 'F' then 'PASS' when 'O' then 'LowQual,q10' else '' end as filters,
                   cast(o_custkey % 9 as int) as ac, af,
                   (select cast(sum((o_custkey % 9 + t.x) % 97) as bigint) from range(50) t(x)) as sum_x,
                   string_agg(sample, ',' order by k) as samples,
                   string_agg(cast(n_alt as varchar), ',' order by k) as states,
                   string_agg(coalesce(cast(depth as varchar), '-'), ',' order by k) as depths,
                   string_agg(case when k % 2 = 1 then 'true' else 'false' end, ',' order by k) as phased
            from gt group by contig, start0, o_orderkey, ref, alt, o_totalprice, o_orderstatus, o_custkey, af
        """,
        "vcf_file_round_trip": f"""
            with {_VARIANT}, {_GT}
            select start0 as start, case when o_orderkey % 2 = 0 then cast(start0 as int) end as "INFO_E", o_orderkey % 2 = 1 as "INFO_O",
                   cast(o_custkey % 9 as int) as ac, case when o_orderkey % 2 = 0 then af end as af,
                   string_agg(sample, ',' order by k) as samples,
                   string_agg(cast(n_alt as varchar), ',' order by k) as states
            from gt group by start0, o_orderkey, o_custkey, af
        """,
        "vcf_block_round_trip": f"""
            with {_VARIANT}, {_GT}
            select contig as "contigName", start0 as start, cast(o_custkey % 9 as int) as ac, af,
                   string_agg(sample, ',' order by k) as samples,
                   string_agg(cast(n_alt as varchar), ',' order by k) as states
            from gt group by contig, start0, o_orderkey, o_custkey, af
        """,
        "vcf_region": f"""
            with {_VARIANT} select contig as "contigName", start0 as start, start0 + 1 as "end", o_totalprice as qual from variant
            where contig in ('chr3', 'chr7') and start0 >= 2000 and start0 + 1 <= 400000 and o_totalprice > {MIN_QUAL}
        """,
        "pipe_added_info": f"""
            with {_VARIANT} select contig as "contigName", start0 as start, ref || alt as "INFO_CSQ" from variant
        """,
        "gtf_file": f"""
            with {_GTF}
            select chrom as "Chromosome", 'model' as "Source", feature as "Feature", s as "Start", e as "End",
                   score as "Score", strand as "Strand", frame as "Frame", gene_id, transcript_id, exon_number from gtf
        """,
        "fasta_file": f"""
            with {_REPEATS}, contigs as (
                select 'chr' || (o_orderkey % 22 + 1) || '_' || o_orderkey // 22 as name,
                       rpad('G' || repeat(unit, cast(o_custkey % 10 + 3 as int)), {STRETCH}, 'G') as bases
                from repeats
            )
            select name as "contigName", cast(0 as bigint) as chunk_id, cast(0 as bigint) as chunk_start,
                   substr(bases, 1, 32) as bases from contigs
            union all select name, 1, 24, substr(bases, 25, 40) from contigs
        """,
        "fasta_indexed": f"""
            with {_REPEATS}, contigs as (
                select 'chr' || (o_orderkey % 22 + 1) || '_' || o_orderkey // 22 as name,
                       rpad('G' || repeat(unit, cast(o_custkey % 10 + 3 as int)), {STRETCH}, 'G') as bases,
                       case when kind <= 1 then 0 else (o_orderkey % (o_custkey % 10 + 1)) * length(unit) end as place
                from repeats
            )
            select name as "contigName", cast(place // 32 as bigint) as chunk_id, cast(case when place < 32 then 0 else 24 end as bigint) as chunk_start,
                   case when place < 32 then substr(bases, 1, 32) else substr(bases, 25, 40) end as bases from contigs
        """,
        "normalise_long_repeats": _LONG_REPEATS,
        "normalise_long_repeats_chunks": _LONG_REPEATS,
        "pipe_cat": f"""
            with {_VARIANT}
            select contig as "contigName", start0 as start, start0 + 1 as "end", ref as "referenceAllele", alt as alts
            from variant
        """,
        "pipe_resumed": f"""
            with {_VARIANT} select 'v' || start0 as key, ref || alt as alleles from variant
        """,
        "schema_inferred": """
            with e as (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events)
            select event_id, k, case when k % 2 = 0 then cast(k as varchar) else 'n' || k end as m, k / 4.0::double as b,
                   'm' as conflicts from e
        """,
        "schema_preset": """
            select 'rs' || l_orderkey as id, p_brand as gene_id, case when l_linenumber % 2 = 0 then 2 else 1 end as n_transcripts
            from lineitem join part on l_partkey = p_partkey
        """,
        "annotate_scalars": f"""
            with {_VARIANT} select contig as seq_region_name, start0 + 1 as start, 'v' || start0 as id from variant
        """,
        "write_check": "select n_nationkey, n_name from nation",
        "annotate_pipe": f"""
            with {_VARIANT}
            select contig as seq_region_name, start0 + 1 as start,
                   contig || ':' || start0 || ':' || ref || ':' || alt as id, ref as gene_id, alt as term from variant
        """,
        "position_layout": _SITE_ROWS,
        "position_sort": _SITE_ROWS,
        "position_layout_order": _ORDERED,
        "position_sort_order": _ORDERED,
        "write_read_table": _SITE_ROWS,
    }
