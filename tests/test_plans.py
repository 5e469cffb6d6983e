"""What the physical plans must look like."""

import contextlib
import io
import re

import pytest

import varlake as v
from varlake.operators.burden import site_gene_consequences
from varlake.plans import workflows
from test_burden import RECORDS, TERMS, VARIANTS


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def read_schemas(text):
    return re.findall(r"ReadSchema: (.*)", text)


@pytest.fixture
def stored(spark, tmp_path):
    full = VARIANTS.replace("calls:array<int>", "calls:array<int>,depth:int,conditionalQuality:int,phredLikelihoods:array<int>")
    spark.createDataFrame([], full).write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([], RECORDS).write.parquet(str(tmp_path / "a"))
    return v.read_table(spark, str(tmp_path / "v")), v.read_table(spark, str(tmp_path / "a"))


def test_only_needed_genotype_fields_are_read(stored):
    text = plan(v.with_genotype_states(stored[0]).select("start", "num_alt_alleles"))
    assert read_schemas(text) == ["struct<start:bigint,genotypes:array<struct<calls:array<int>>>>"]
    text = plan(stored[0].select(v.depth_summary_stats().alias("d")))
    assert read_schemas(text) == ["struct<genotypes:array<struct<depth:int>>>"]


def test_quality_reaches_the_scan_through_the_derived_columns(stored):
    prepared = workflows.prepare_variants(stored[0])
    assert "GreaterThanOrEqual(qual,99.0)" in plan(prepared.filter("start > 5"))
    assert "GreaterThan(start,5)" in plan(prepared.filter("start > 5"))


def test_burden_reads_and_shuffles_little(stored):
    text = plan(workflows.burden_table(*stored, "count", TERMS))
    lists, variants, records = sorted(read_schemas(text), key=lambda s: ("genotypes" not in s, "calls" in s))
    assert lists == "struct<qual:double,filters:array<string>,genotypes:array<struct<sampleId:string>>>"
    assert "depth" not in variants and "phredLikelihoods" not in variants and "names" not in variants
    assert "struct<gene_id" in records and "Python" not in text
    # Lists of samples are a grouping key only where different ones are found, once per variant.
    keys = re.findall(r"Keys \[\d+\]: (.*)", text)
    assert any("__list_high" in k for k in keys) and not any("gene_id" in k and re.search(r"\ball#", k) for k in keys)
    assert text.count("CartesianProduct") == text.count("BroadcastNestedLoopJoin") == 0


def test_site_sums_are_combined_before_the_shuffle(stored):
    text = plan(site_gene_consequences(stored[1], TERMS))
    assert "partial_sum" in text and text.count("\n* Exchange") + text.count("Exchange (") >= 1
    assert "SortAggregate" not in text


def test_overlap_is_an_equi_join(spark):
    a = spark.createDataFrame([], "contigName string, start long, end long")
    text = plan(v.overlap_pairs(a, a.selectExpr("*", "1 as x")))
    assert "NestedLoop" not in text and "Cartesian" not in text and "__block" in text


def test_stored_sites_join_without_an_exchange(spark, tmp_path):
    sites = [(f"chr{i % 5}", i * 10, i * 10 + 1) for i in range(500)]
    variants = spark.createDataFrame([(*s, i) for i, s in enumerate(sites)], "contigName string, start long, end long, v int")
    records = spark.createDataFrame([(*s, i) for i, s in enumerate(sites[::2])], "seq_region_name string, start long, end long, a int")
    left = v.write_site_table(variants, "test_sites", str(tmp_path / "sites"), 4)
    right = v.write_site_table(records, "test_records", str(tmp_path / "records"), 4, ("seq_region_name", "start", "end"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        joined = v.join_consequences(left, right, shift_start_by=0)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted((r.v, r.a) for r in joined.collect()) == [(2 * i, i) for i in range(250)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table test_sites")
        spark.sql("drop table test_records")
