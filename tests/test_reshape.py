import pytest
from pyspark.sql import functions as F

import varlake as v


def test_zip_explode_of_split_strings(spark):
    df = spark.createDataFrame([("abc, def, ghi", "1.0, 2.0, 3.0")], "column_1 string, column_2 string")
    df = df.select(*[F.split(c, " *, *").alias(c) for c in df.columns])
    got = v.zip_explode_cols(df, ["column_1", "column_2"], "zip_exploded", {"column_1": "column_renamed_1"})
    assert got.columns == ["column_1", "column_2", "zip_exploded"]
    assert got.schema["zip_exploded"].dataType.simpleString() == "struct<column_renamed_1:string,column_2:string>"
    assert [tuple(r.zip_exploded) for r in got.collect()] == [("abc", "1.0"), ("def", "2.0"), ("ghi", "3.0")]


def test_zip_explode_edges(spark):
    df = spark.createDataFrame([([1, 2], [3]), ([], []), (None, [1])], "a array<int>, b array<int>")
    assert [tuple(r.z) for r in v.zip_explode_cols(df, ["a", "b"], "z").collect()] == [(1, 3), (2, None)]
    assert v.zip_explode_cols(df, ["a", "b"], "z", outer=True).count() == 4


def test_flatten(spark):
    df = spark.sql(
        """select named_struct('a', 1, 'b c', named_struct('x', 2)) as s,
                  array(named_struct('p', 1, 'q', array(named_struct('r', 5), named_struct('r', 6)))) as arr,
                  array(array(1, 2)) as m, array(array(named_struct('z', 9))) as deep, 7 as `d.e`"""
    )
    flat = v.flatten(df)
    assert flat.columns == ["s_a", "s_b_c_x", "arr_p", "arr_q_r", "m", "deep__z", "d_e"]
    assert list(flat.first()) == [1, 2, [1], [[5, 6]], [[1, 2]], [[9]], 7]
    assert v.flatten(df, v.field_name_normaliser(".")).columns[:2] == ["s.a", "s.b.c.x"]


def test_normalise_names(spark):
    df = spark.sql("select array(named_struct('a b', 1, 'c', named_struct('d-e', 'x'))) as `the list`")
    got = v.normalise_field_names(df)
    assert got.schema.simpleString() == "struct<the_list:array<struct<a_b:int,c:struct<d_e:string>>>>"
    assert got.first()[0][0].c.d_e == "x"


def test_scalarise(spark):
    df = spark.createDataFrame([(["C"], [3]), ([], None)], "alternateAlleles array<string>, INFO_AC array<int>")
    got = v.scalarise_biallelic(df)
    assert got.columns == ["alternateAllele", "INFO_AC"]
    assert [tuple(r) for r in got.collect()] == [("C", 3), (None, None)]


def test_unstack(spark):
    df = spark.createDataFrame(
        [("t", [1.0, 2.0, 3.0], [False, True, None], ["g1", "g2", "g3"])],
        "tissue string, value array<double>, missing array<boolean>, gene array<string>",
    )
    got = v.unstack_arrays(df, "gene", ["value"], labels="gene", missing="missing")
    assert [tuple(r) for r in got.collect()] == [("t", "g1", 1.0), ("t", "g3", 3.0)]
    assert [r.pos for r in v.unstack_arrays(df, "pos", ["value"]).collect()] == [0, 1, 2]


def test_preview_and_struct(spark):
    assert len(v.display_head(spark.range(10), 3)) == 3
    assert v.expand_struct(spark.sql("select named_struct('a', 1, 'b', 2) as s"), "s").columns == ["a", "b"]


def test_filters(spark):
    df = spark.createDataFrame([(["PASS"], 99.0), (["PASS"], 1.0), ([], 100.0), (None, None)], "filters array<string>, qual double")
    assert v.filter_quality(df).count() == 1
    assert v.filter_quality(df, "or").count() == 3
    with pytest.raises(ValueError):
        v.filter_quality(df, "xor")


def test_rare_filters_agree(spark):
    rows = [([("a", [0, 1]), ("b", [1, 1]), ("c", [0, 1]), ("d", [0, 0]), ("e", [-1, 0])],), ([("a", [0, 1]), ("b", [1, 1])],), ([],), (None,)]
    df = spark.createDataFrame(rows, "genotypes array<struct<sampleId:string,calls:array<int>>>").withColumn("id", F.monotonically_increasing_id())
    prepared = v.with_zygosity(v.with_genotype_states(df))
    for het, hom in [(1, 1), (2, 0), (0, 1), (0, 0)]:
        slow = v.filter_rare(v.explode_genotypes(prepared), het, hom)
        fast = v.explode_rare_genotypes(prepared, het, hom)
        key = lambda d: sorted((r.id, r.genotype.gt.sampleId, r.genotype.num_alt_alleles) for r in d.collect())
        assert key(slow) == key(fast)


def test_row_local_operators_run_on_streams(spark, tmp_path):
    rows = [(["PASS"], 100.0, ["x"], [("a", [0, 1]), ("b", [1, 1])])]
    schema = "filters array<string>, qual double, names array<string>, genotypes array<struct<sampleId:string,calls:array<int>>>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = v.flatten(v.explode_genotypes(v.with_zygosity(v.with_genotype_states(v.filter_quality(stream)))))
    started = out.writeStream.format("memory").queryName("rowlocal").start()
    try:
        started.processAllAvailable()
        assert spark.table("rowlocal").count() == 2
    finally:
        started.stop()


def test_layout(spark):
    df = spark.range(1000).selectExpr("concat('chr', id % 3) as contigName", "1000 - id as start", "1001 - id as end")
    laid = v.layout_by_position(df, 4)
    parts = laid.withColumn("p", F.spark_partition_id()).collect()
    ordered = [(r.contigName, r.start) for r in parts]
    assert ordered == sorted(ordered) and len({r.p for r in parts}) == 4
    assert [r.start for r in v.sort_by_position(df).limit(2).collect()] == [1, 4]
