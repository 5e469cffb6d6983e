import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_each_stage_on_what_the_one_before_left(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        if at < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            seen.append(docs.count())
    start, clean, single, cut, mixed = seen
    assert start > clean > single == cut and mixed > 0
    sizes = docs.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert sizes.max() <= 1024


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_take_odd_rows(spark, odd, none, tmp_path):
    for start in ("odd", "none"):
        docs = {"odd": odd, "none": none}[start]
        for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{start}{at}")
            docs = spark.read.parquet(f"{tmp_path}/{start}{at}")
        assert (docs.count() > 0) == (start == "odd")
