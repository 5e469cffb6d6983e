import pytest
from pyspark.sql import functions as F

import varlake as v
from varlake.operators.burden import FLAG_STRUCTS
from varlake.plans import workflows

VARIANTS = (
    "contigName string, start long, end long, names array<string>, alternateAlleles array<string>, qual double,"
    "filters array<string>, INFO_AC array<int>, INFO_AF array<double>, INFO_MLEAC array<int>, INFO_MLEAF array<double>,"
    "genotypes array<struct<sampleId:string,calls:array<int>>>"
)
RECORDS = (
    "seq_region_name string, start long, end long, id string, transcript_consequences array<struct<gene_id:string,"
    "impact:string,lof:string,consequence_terms:array<string>,sift_score:float,polyphen_score:float,cadd_raw:float>>"
)
TERMS = ["missense", "stop"]


def _variant(start, af, genotypes):
    return ("1", start, start + 1, [f"v{start}"], ["T"], 100.0, ["PASS"], [1], [af], [1], [af], genotypes)


@pytest.fixture
def tables(spark):
    variants = [
        _variant(10, 0.25, [("a", [0, 1]), ("b", [1, 1]), ("c", [0, 0]), ("d", [-1, 0])]),
        _variant(20, 0.5, [("a", [0, 1]), ("b", [0, 1]), ("c", [1, 2])]),
        _variant(20, 0.125, [("a", [1, 1]), ("b", [0, 0])]),
        _variant(30, 0.5, []),
        _variant(40, 0.5, [("z", [0, 1])]),
    ]
    g1 = ("g1", "HIGH", "HC", ["missense", "stop"], 0.5, None, 2.0)
    g1b = ("g1", "LOW", None, ["missense"], 0.25, None, 1.0)
    g2 = ("g2", "LOW", None, [], None, None, None)
    records = [
        ("1", 11, 11, "v10", [g1, g1b, g2]),
        ("1", 21, 21, "v20", [g1b]),
        ("1", 21, 21, "v20", [g1]),
        ("1", 31, 31, "v30", [g1]),
        ("1", 41, 41, "v40", None),
        ("2", 11, 11, "x", [g1]),
    ]
    return spark.createDataFrame(variants, VARIANTS), spark.createDataFrame(records, RECORDS)


def _rows(df):
    flat = v.flatten(df)
    names = sorted(flat.columns)
    return sorted(tuple(str(r[n]) for n in names) for r in flat.collect()), names


@pytest.mark.parametrize("measure", ["count", "min_af"])
def test_three_plans_agree(tables, measure):
    joined = workflows.joined_genotypes(*tables, TERMS)
    level = v.count_consequences if measure == "count" else v.min_af_consequences
    two_step = v.pivot_zygosity(level(joined))
    one_pass = v.gene_burden(joined, measure)
    early = workflows.burden_table(*tables, measure, TERMS)
    kept = v.scalarise_biallelic(v.filter_quality(tables[0]))
    bitmaps = v.gene_burden_by_bitmaps(kept, tables[1], TERMS, measure)
    assert _rows(two_step) == _rows(one_pass) == _rows(early) == _rows(bitmaps)
    assert one_pass.schema.simpleString() == early.schema.simpleString() == two_step.schema.simpleString()


def test_values_and_untouched_samples(tables):
    got = {(r.gene_id, r.sampleId): r for r in workflows.burden_table(*tables, "count", TERMS).collect()}
    assert set(got) == {("g1", s) for s in "abcd"} | {("g2", s) for s in "abcd"}
    a = got["g1", "a"]
    assert a.heterozygous.consequences.missense == 4 and a.heterozygous.consequences.stop == 2
    assert a.homozygous.consequences.missense == 2 and a.homozygous.lof_level.HC == 1
    assert a.heterozygous.scores.sift_mean == 0.375 and a.heterozygous.scores.polyphen_min is None
    # Not a carrier in states 1 or 2, yet present: structs that are not null, with null fields.
    d = got["g1", "d"]
    assert d.heterozygous is not None and d.heterozygous.consequences.missense is None
    assert got["g2", "a"].heterozygous.lof_level.HC is None and got["g2", "a"].heterozygous.consequences.stop == 0


def test_min_af(tables):
    got = {(r.gene_id, r.sampleId): r for r in workflows.burden_table(*tables, "min_af", TERMS).collect()}
    assert got["g1", "a"].heterozygous.consequences.stop == 0.75
    assert got["g1", "a"].homozygous.consequences.stop == 0.875
    assert got["g2", "a"].heterozygous.lof_level.HC == 0.0
    assert got["g1", "c"].heterozygous.consequences.stop is None


def test_rare_equals_filtered_rows(tables):
    prepared = workflows.prepare_variants(tables[0])
    rows = v.filter_rare(v.explode_genotypes(prepared), 1, 1)
    slow = v.gene_burden(v.join_consequences(rows, workflows.prepare_consequences(tables[1], TERMS)))
    assert _rows(slow) == _rows(workflows.rare_burden_table(*tables, TERMS, 1, 1))


def test_terms_are_found(tables):
    found = workflows.burden_table(*tables)
    assert found.schema["heterozygous"].dataType["consequences"].dataType.fieldNames() == TERMS


def test_join_keys(tables, spark):
    singlegt = v.explode_genotypes(v.with_genotype_states(tables[0]))
    consequences = v.explode_transcript_consequences(tables[1])
    assert v.join_consequences(singlegt, consequences, shift_start_by=0).count() == 0
    ids = singlegt.withColumn("id", F.get("names", F.lit(0)))
    assert v.join_consequences(ids, consequences, on_id=True).count() == v.join_consequences(singlegt, consequences).count()


def test_vocabulary_and_onehot(spark):
    df = spark.createDataFrame(
        [([("x", ["a", "b"]), ("y", None)], None), ([("z", ["b", "c"])], [("q", ["t"])]), (None, None)],
        "transcript_consequences array<struct<i:string,consequence_terms:array<string>>>,"
        "intergenic_consequences array<struct<i:string,consequence_terms:array<string>>>",
    )
    kinds = ["transcript_consequences", "intergenic_consequences"]
    assert v.vocabulary(df, kinds)["intergenic_consequences"] == ["t"]
    assert v.vocabulary(df, kinds)["transcript_consequences"][-1:] == ["c"]
    assert sorted(r.term for r in v.consequence_terms(df).collect()) == v.vocabulary(df, kinds)["transcript_consequences"]
    assert len(v.collect_terms(spark.range(5000).selectExpr("cast(id as string)"))) == 5000
    hot = v.array_to_onehot_columns(spark.createDataFrame([(["a"],), (["b"],)], "t array<string>"), "t", "h")
    assert sorted(tuple(r.h) for r in hot.collect()) == [(False, True), (True, False)]


def test_explode_keeps_or_drops(tables):
    assert v.explode_transcript_consequences(tables[1]).count() == 7
    assert v.explode_transcript_consequences(tables[1], outer=True).count() == 8


def test_flag_structs_are_named():
    assert FLAG_STRUCTS == ("consequences", "impact_level", "lof_level")


def test_samples_of_several_bitmaps(spark):
    names = [f"s{i:05d}" for i in range(40_000)]
    genotypes = [(name, [0, 1] if i in (5, 32_767, 32_768, 39_999) else [0, 0]) for i, name in enumerate(names)]
    variants = spark.createDataFrame([_variant(10, 0.25, genotypes), _variant(20, 0.25, [("other", [0, 0]), ("s00007", [1, 1])])], VARIANTS)
    gene = ("g1", "HIGH", "HC", ["missense"], 0.5, None, 2.0)
    records = spark.createDataFrame([("1", 11, 11, "v10", [gene]), ("1", 21, 21, "v20", [gene])], RECORDS)
    kept = v.scalarise_biallelic(variants)
    rows = v.gene_burden_by_bitmaps(kept, records, TERMS).select("sampleId", "heterozygous.consequences.missense", "homozygous.consequences.missense").collect()
    carried = {r[0]: (r[1], r[2]) for r in rows if r[1] is not None or r[2] is not None}
    assert len(rows) == 40_001 == len({r[0] for r in rows})
    assert carried == {**{names[i]: (1, None) for i in (5, 32_767, 32_768, 39_999)}, "s00007": (None, 1)}
