import random

import pytest

import varlake as v
from brute import overlaps

SITE = "contigName string, start long, end long"


def test_overlap_pairs_equal_brute_force(spark):
    rng = random.Random(5)

    def interval():
        start = rng.choice([rng.randint(0, 40), rng.randint(0, 300_000), 65536 * rng.randint(0, 4)])
        return start, start + rng.choice([0, 1, 1, 1, rng.randint(2, 40), rng.randint(2, 5000), rng.randint(2, 400_000)])

    left = sorted({(rng.choice("12"), *interval()) for _ in range(400)})
    right = [(rng.choice("12"), *interval(), i) for i in range(300)]
    got = v.overlap_pairs(
        spark.createDataFrame(left, SITE), spark.createDataFrame(right, SITE + ", i int")
    ).select("contigName", "start", "end", "i").collect()
    wanted = [(c, s, e, i) for c, s, e in left for d, t, u, i in right if c == d and overlaps((s, e), (t, u))]
    assert sorted(map(tuple, got)) == sorted(wanted)


@pytest.fixture
def variants(spark):
    return spark.createDataFrame(
        [("1", 10, 11, "C"), ("1", 10, 11, "C"), ("1", 50, 51, "G"), ("2", 10, 11, "C")], SITE + ", alternateAllele string"
    )


def test_nested_shape(spark, variants):
    features = spark.createDataFrame(
        [("1", 0, 20, "b", 0.5), ("1", 5, 11, "a", None), ("1", 11, 20, "no", 0.1)], SITE + ", name string, AF float"
    )
    got = v.annotate_overlap(variants, features, "Set", ["AF"])
    assert got.schema["Set"].dataType.simpleString() == (
        "array<struct<name:string,allele:string,fields:struct<AF:float>>>"
    )
    rows = {(r.contigName, r.start): r.Set for r in got.collect()}
    assert [x.name for x in rows["1", 10]] == ["a", "b"] and rows["1", 50] is None
    assert got.count() == 4
    assert v.annotate_overlap(variants, features, "Set", ["AF"], nested=False).count() == 6


def test_exact_with_and_without_allele(spark, variants):
    features = spark.createDataFrame(
        [("1", 10, 11, "x", "C"), ("1", 10, 11, "y", "T"), ("1", 9, 11, "z", "C")], SITE + ", name string, alt string"
    )
    loose = v.annotate_exact(variants, features, "S", ["alt"], allele_col="alt").collect()
    assert sorted(len(r.S or []) for r in loose) == [0, 0, 2, 2]
    strict = v.annotate_exact(variants, features, "S", ["alt"], allele_col="alt", variant_allele_col="alternateAllele")
    assert sorted(len(r.S or []) for r in strict.collect()) == [0, 0, 1, 1]


def test_colocated(spark, variants):
    known = spark.createDataFrame([("1", 10, 11, 1, "rs1", "A/C")], SITE + ", strand int, id string, allele_string string")
    got = v.annotate_colocated(variants, known)
    expected = v.AnnotationSchema().with_colocated().struct["colocated_variants"].dataType
    assert got.schema["colocated_variants"].dataType.simpleString() == expected.simpleString()
    assert [r.colocated_variants[0].start for r in got.collect() if r.colocated_variants] == [11, 11]


def test_cadd(spark):
    score = "contigName string, start long, referenceAllele string, alternateAllele string, cadd_raw double, cadd_phred double"
    variants = spark.createDataFrame([("1", 1, "A", "C"), ("1", 1, "A", "AT"), ("1", 2, "A", "C")], score.split(", cadd")[0])
    snv = spark.createDataFrame([("1", 1, "A", "C", 1.5, 10.0), ("1", 1, "A", "C", 0.5, 99.0)], score)
    indel = spark.createDataFrame([("1", 1, "A", "AT", 2.5, 20.0)], score)
    got = sorted((r.start, r.alternateAllele, r.cadd_raw, r.cadd_phred) for r in v.annotate_cadd(variants, snv, indel).collect())
    assert got == [(1, "AT", 2.5, 20.0), (1, "C", 1.5, 10.0), (2, "C", None, None)]


def test_transcript_scores(spark):
    key = "transcript_id string, protein_start long, amino_acids string"
    consequences = spark.createDataFrame([("t", 5, "A/V"), ("t", 6, "A/V")], key)
    scores = spark.createDataFrame([("t", 5, "A/V", "bad", 0.01)], key + ", prediction string, score double")
    both = v.annotate_transcript_scores(consequences, scores, "sift")
    assert both.columns[3:] == ["sift_prediction", "sift_score"] and both.dtypes[4][1] == "float"
    for letter, (p, s) in {"p": ("bad", None), "s": (None, pytest.approx(0.01)), "b": ("bad", pytest.approx(0.01))}.items():
        rows = {r.protein_start: r for r in v.annotate_transcript_scores(consequences, scores, "sift", letter).collect()}
        assert rows[5].sift_prediction == p and rows[5].sift_score == s and rows[6].sift_score is None
    with pytest.raises(ValueError):
        v.annotate_transcript_scores(consequences, scores, "sift", "x")


def test_promoters(spark):
    df = spark.createDataFrame(
        [(500, 900, "+", "transcript", 1.0), (500, 900, "-", "transcript", 1.0), (500, 900, ".", "exon", 1.0)],
        "Start long, End long, Strand string, Feature string, Score double",
    )
    got = v.promoter_regions(v.filter_feature(df))
    assert got.columns == ["Start", "End", "Strand"]
    assert sorted(map(tuple, got.collect())) == [(-500, 500, "+"), (900, 1900, "-")]
    assert v.promoter_regions(df, 600, clamp=True).first().Start == 0


def test_ecdf_equals_cume_dist(spark):
    rng = random.Random(3)
    values = [rng.choice([1, 1, 1, 2, rng.randint(0, 10**6)]) for _ in range(3000)] + [None]
    df = spark.createDataFrame([(x,) for x in values], "x long")
    df.createOrReplaceTempView("ecdf_in")
    wanted = spark.sql(
        "select x, count(*) n, max(c) e from (select x, cume_dist() over (order by x) c from ecdf_in where x is not null) group by x"
    )
    got = v.ecdf(df, "x")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert v.ecdf(df.filter("x < 0"), "x").count() == 0


def test_pages_bound_the_lists_of_a_crowded_site(spark):
    features = [("1", 100, 200, f"f{i}", i) for i in range(1_000)] + [("1", 150, 151, "same", 7)] * 40 + [("2", 0, 5, "g", 1)]
    df = spark.createDataFrame(features, "contigName string, start long, end long, name string, size int").repartition(7)
    variants = spark.createDataFrame([("1", 150, 151, "a"), ("1", 150, 151, "b"), ("2", 3, 4, "c"), ("3", 1, 2, "d")], "contigName string, start long, end long, id string")
    rows = v.annotate_overlap(variants, df, "hit", ["size"], page_size=16).collect()
    found = {}
    for row in rows:
        assert row.hit is None or len(row.hit) <= 16
        assert (row.id, row.page) not in {key[:2] for key in found.get("pages", [])}
        found.setdefault(row.id, []).extend(one.name for one in row.hit or [])
    want = sorted([f"f{i}" for i in range(1_000)] + ["same"] * 40)
    assert sorted(found["a"]) == sorted(found["b"]) == want and found["c"] == ["g"] and found["d"] == []
    assert len({(r.id, r.page) for r in rows}) == len(rows) > 2 * 1_040 / 16
