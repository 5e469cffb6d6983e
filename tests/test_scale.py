"""Steps that stay in proportion: rows dealt out before costly steps, buckets that grow with the table, work done once."""

import pytest

from varlake.operators.genotypes import with_genotype_states
from varlake.plans import catalog, views
from varlake.sources.vcf import VcfHeader, format_vcf_lines, infer_vcf_header, parse_vcf_lines
from test_plans import plan


@pytest.fixture()
def tables(spark, tmp_path):
    """Orders, line items and parts in one file of one split each; keys repeat and are null."""
    orders = [(k if k != 7 else None, k % 11 if k != 5 else None, "FOP"[k % 3], float(k)) for k in [*range(1, 60), 3]]
    lines = [(k, k % 9 + 1, n, "RNA"[k % 3], "OF"[n % 2], float(k % 50)) for k in range(1, 60) for n in range(1, 1 + k % 4)]
    parts = [(p, f"Brand#{p}", p * 3, ("PROMO", "LARGE")[p % 2]) for p in range(1, 11)]
    kinds = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double"),
        "part": (parts, "p_partkey long, p_brand string, p_size int, p_type string"),
    }
    for name, (rows, schema) in kinds.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_variants_are_spread_before_they_are_written(spark, tables):
    spread = views.variants(spark, tables, spread=True)
    assert spread.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted(map(str, spread.collect())) == sorted(map(str, views.variants(spark, tables).collect()))
    assert catalog.vcf_round_trip(spark, tables).count() == 60
    # The row without a start is in neither folder.
    assert catalog.vcf_file_round_trip(spark, tables).count() == 59
    assert "RoundRobinPartitioning" in plan(catalog.vcf_round_trip(spark, tables))


def test_genome_text_is_spread_before_it_is_made(spark, tmp_path):
    spark.range(1, 40).selectExpr("id as c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert views.long_repeat_lines(spark, str(tmp_path)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_stored_sites_meet_as_one_row_each_in_buckets_by_size(spark, tables, monkeypatch):
    joined = catalog.join_stored_sites(spark, tables)
    want = sorted(map(str, joined.collect()))
    assert len(want) > 100
    assert want == sorted(map(str, catalog.join_consequences(spark, tables).collect()))
    # Below the join no row is spread out: the explodes of one value that compute the states once do not count.
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    above = text[: text.index("Join")]
    assert "explode(arrays_zip" in above and "explode(transcript_consequences" in above
    assert plan(joined).count("16 out of 16") == 2
    monkeypatch.setattr(catalog, "BUCKET_ROWS", 4)
    more = catalog.join_stored_sites(spark, tables)
    n = views.table(spark, tables, "lineitem").count() // 4
    assert n > 16 and plan(more).count(f"{n} out of {n}") == 2 and "Exchange" not in plan(more)
    assert sorted(map(str, more.collect())) == want


def test_calls_are_written_and_read_without_patterns_or_throws(spark):
    kind = "contigName string, start long, referenceAllele string, alternateAlleles array<string>, genotypes array<struct<sampleId:string,phased:boolean,calls:array<int>>>"
    calls = [[0, 1], [-1, 10], [], None, [2], [None, 1], [0, -1, 3]]
    rows = [("1", 5, "A", ["C"], [(f"s{i}", phased, c) for i, c in enumerate(calls)]) for phased in (True, False, None)]
    table = spark.createDataFrame(rows, kind)
    samples = [f"s{i}" for i in range(len(calls))]
    lines = format_vcf_lines(table, samples)
    assert [r.value.split("\t")[9:] for r in lines.collect()] == [
        [f"0{x}1", f".{x}10", ".", ".", "2", f".{x}1", f"0{x}.{x}3"] for x in ("|", "/", "/")
    ]
    parsed = parse_vcf_lines(lines, VcfHeader.parse(infer_vcf_header(table.schema, samples)))
    text = parsed._jdf.queryExecution().optimizedPlan().toString()
    # The genotype's text is made once; the separator is no pattern.
    assert "[/|]" not in text and text.count("array_join(transform(lambda") <= 2
    got = parsed.collect()
    assert [g.calls for g in got[0].genotypes] == [[0, 1], [-1, 10], [-1], [-1], [2], [-1, 1], [0, -1, 3]]
    assert [[g.phased for g in r.genotypes][:3] for r in got] == [[True, True, False], [False] * 3, [False] * 3]
    assert with_genotype_states(parsed).first().num_alt_alleles == [1, -1, -1, -1, 2, -1, -1]
    odd = spark.createDataFrame([("1\t6\t.\tA\tC\t.\t.\t.\tGT\t0/x\t1|.\t./",)], "value string")
    header = VcfHeader.parse(['##FORMAT=<ID=GT,Number=1,Type=String,Description="">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc"])
    assert [g.calls for g in parse_vcf_lines(odd, header).first().genotypes] == [[0, -1], [1, -1], [-1, -1]]
