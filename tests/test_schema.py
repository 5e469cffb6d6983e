import json

import pytest
from pyspark.sql import types as T

import varlake as v


def full():
    return v.AnnotationSchema().with_sift().with_polyphen().with_predefined("GnomADg_v3").with_cadd().with_colocated()


def test_fields():
    base = v.AnnotationSchema()
    assert len(base.struct.fields) == 16 and len(base.field("transcript_consequences").fields) == 43
    assert not base.struct["start"].nullable and base.struct["end"].nullable
    added = {"cadd_phred", "cadd_raw", "sift_prediction", "sift_score", "polyphen_prediction", "polyphen_score"}
    assert added <= set(full().field("transcript_consequences").fieldNames())
    assert not added & set(base.field("transcript_consequences").fieldNames())
    assert set(full().field("colocated_variants").fieldNames()) == {"allele_string", "end", "id", "seq_region_name", "start", "strand"}
    frequencies = full().field(["custom_annotations", "GnomADg_v3", "fields"])
    assert len(frequencies.fields) == 31 and {f.dataType for f in frequencies.fields} == {T.FloatType()}


def test_applying_twice_changes_nothing():
    assert full().with_sift().with_colocated().with_predefined().struct == full().struct


def test_two_custom_sets():
    schema = v.AnnotationSchema().with_custom("a", [("x", "float")]).with_custom("b", [("y", T.LongType())])
    assert schema.field("custom_annotations").fieldNames() == ["a", "b"]
    assert schema.field(["custom_annotations", "b", "fields", "y"]) == T.LongType()


def test_lookup():
    schema = v.AnnotationSchema()
    with pytest.raises(ValueError):
        schema.field("nope")
    made = schema.field("nope", create_if_missing=T.StructField("nope", T.StructType()))
    assert made == T.StructType()
    assert schema.with_field("nope", T.StructField("x", T.LongType())).field(["nope", "x"]) == T.LongType()
    with pytest.raises(ValueError):
        v.AnnotationSchema("version_1")
    with pytest.raises(ValueError):
        schema.with_predefined("unknown")


def test_presets():
    assert T.StructType.fromJson(v.preset("vep/basic_schema")["version_99"]) == v.AnnotationSchema().struct
    assert len(v.preset("vep/predefined_custom_annot")["GnomADg_v3"]) == 31
    with pytest.raises(ValueError):
        v.preset("vep/other")


def test_parse(spark):
    good = json.dumps({"seq_region_name": "1", "start": 5, "input": "x", "transcript_consequences": [{"gene_id": "g", "sift_score": 0.5}]})
    df = spark.createDataFrame([(good,), ("{broken",), (None,)], "text string")
    parsed = v.parse_annotations(df, full())
    assert "input" not in parsed.columns
    a, b, c = parsed.collect()
    assert a.transcript_consequences[0].sift_score == 0.5 and a.start == 5
    assert set(b.asDict().values()) == {None} == set(c.asDict().values())
    kept = v.parse_annotations(df, full(), corrupt_record="_bad").collect()
    assert [r._bad for r in kept] == [None, "{broken", None]


def test_infer(spark):
    assert v.infer_schema(spark, {"a": 1, "b": [{"c": "x"}]}).simpleString() == "struct<a:bigint,b:array<struct<c:string>>>"


def test_variant_schema(spark):
    assert v.VARIANT_SCHEMA.fieldNames()[:3] == ["contigName", "start", "end"]
    assert spark.createDataFrame([], v.VARIANT_SCHEMA).count() == 0


def test_schema_of_all_records(spark):
    texts = [
        '{"a": 1, "b": {"c": "x"}, "d": [{"e": 1}], "n": null}',
        '{"a": 2.5, "b": {"c": 3}, "d": [{"e": 2, "f": true}], "n": null}',
        '{"d": [], "odd name": "y"}',
        "not json",
        "[1, 2]",
        None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    schema, conflicts = v.infer_schema_of_all(df)
    assert conflicts == ["b.c"]
    assert schema["a"].dataType.simpleString() == "double"
    assert schema["b"].dataType.simpleString() == "struct<c:string>"
    assert schema["d"].dataType.simpleString() == "array<struct<e:bigint,f:boolean>>"
    assert schema["n"].dataType.simpleString() == "string" and "odd name" in schema.fieldNames()
    parsed = v.parse_annotations(df, schema).collect()
    assert sorted((r["b"]["c"] if r["b"] else "") for r in parsed) == ["", "", "", "", "3", "x"]
    assert v.infer_schema_of_all(df.where("text is null"))[0].fieldNames() == []
