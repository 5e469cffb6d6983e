import statistics

import pytest
from pyspark.sql import functions as F

import varlake as v

GENOTYPES = "g array<struct<sampleId:string,calls:array<int>,depth:int,conditionalQuality:int>>"


def test_genotype_states(spark):
    rows = [([("a", [0, 1], 1, 2), ("b", [1, 1], 1, 2), ("c", [0, -1], 1, 2), ("d", [], 1, 2), ("e", None, 1, 2),
              ("f", [1, 2], 1, 2), ("g", [0, None], 1, 2)],), (None,), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, GENOTYPES).select(v.genotype_states("g")).collect()]
    assert got == [[1, 2, -1, -1, -1, 3, -1], None, []]


def test_zygosity_counts_and_null(spark):
    df = spark.createDataFrame([([0, 1, 1, 2, -1, 3, 5, 3],), (None,), ([],)], "num_alt_alleles array<int>")
    some, none, empty = [r[0] for r in df.select(v.zygosity_summary()).collect()]
    assert some.asDict() == {"n_samples": 8, "n_homo": 1, "n_hetero": 2, "n_ref": 1, "n_not_measured": 1, "other": [3, 5]}
    assert set(none.asDict().values()) == {None}
    assert empty.n_samples == 0 and empty.other == []


def test_moments(spark):
    values = [3, None, 7, 20, 7]
    rows = [([("s", [0, 0], x, x) for x in values],), ([("s", [0, 0], 4, None)],), ([],)]
    df = spark.createDataFrame(rows, GENOTYPES)
    many, one, none = [r[0] for r in df.select(v.depth_summary_stats("g")).collect()]
    known = [x for x in values if x is not None]
    assert many.mean == pytest.approx(statistics.mean(known)) and many.stdDev == pytest.approx(statistics.stdev(known))
    assert (many.min, many.max) == (3, 20)
    assert (one.mean, one.stdDev, one.min) == (4, None, 4)
    assert (none.mean, none.stdDev, none.min, none.max) == (None, None, None, None)
    assert df.select(v.quality_summary_stats("g")).collect()[1][0].mean is None


def test_call_summary(spark):
    rows = [(["C", "T"], [("a", [0, 1], 1, 1), ("b", [1, 2], 1, 1), ("c", [-1, 0], 1, 1), ("d", [2, 2], 1, 1)]), (["C"], [])]
    df = spark.createDataFrame(rows, "alternateAlleles array<string>, " + GENOTYPES)
    s, empty = [r[0] for r in df.select(v.call_summary_stats("g")).collect()]
    assert (s.callRate, s.nCalled, s.nUncalled, s.nHet, s.nHomozygous) == (0.75, 3, 1, 2, [0, 0, 1])
    assert (s.nNonRef, s.nAllelesCalled, s.alleleCounts) == (5, 7, [2, 2, 3])
    assert s.alleleFrequencies == pytest.approx([2 / 7, 2 / 7, 3 / 7])
    assert empty.callRate is None and empty.alleleFrequencies == [None, None]


def test_spdi(spark):
    df = spark.createDataFrame(
        [("20", 9, "A", ["C", "GG"]), ("20", 9, "A", ["C", None]), (None, 9, "A", ["C"]), ("20", 9, "A", None)],
        "contigName string, start long, referenceAllele string, alternateAlleles array<string>",
    )
    ids = df.select(v.variant_spdi(alt="alternateAlleles", join_alternate_alleles=True)).collect()
    assert [r[0] for r in ids] == ["20:9:A:C,GG", "20:9:A:C", None, None]
    first = df.select(v.variant_spdi(alt=F.get("alternateAlleles", F.lit(1)))).first()[0]
    assert first == "20:9:A:GG"


def test_flags(spark):
    df = spark.createDataFrame([(["x", "y"], "HC"), ([], "LC"), (None, None)], "t array<string>, l string")
    flags = df.select(v.flag_struct("t", ["x", "z"], is_array=True), v.flag_struct("l", ["HC"])).collect()
    assert [(tuple(a), tuple(b)) for a, b in flags] == [((True, False), (True,)), ((False, False), (False,)), ((None, None), (None,))]


def test_normaliser():
    assert v.field_name_normaliser()(" a-b (c) ") == "a_b_c_"
    assert v.field_name_normaliser(".")("a  b") == "a.b"
