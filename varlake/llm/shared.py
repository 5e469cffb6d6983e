"""Helpers that several operators of this package use."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that are turned into Python objects at a time; bounds what a task holds of long texts.
SLICE = 256


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; only a local master may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="varlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder; one that is gone, or whose session has ended, is no error."""
    if spark.sparkContext._jsc is None:
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared scratch folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def extended(schema: T.StructType, **kinds: str) -> T.StructType:
    """``schema`` with further fields, name=type."""
    return T.StructType([*schema.fields, *(T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in kinds.items())])


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps now, not when the driver next collects garbage."""
    spark.sparkContext._jvm.System.gc()


def map_slices(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``step`` over Arrow batches of at most SLICE rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield step(batch.slice(at, SLICE))

    return df.mapInArrow(run, schema)


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts as empty."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    spaces = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.when(F.length(squeezed) == 0, F.lit(0)).otherwise(spaces + 1).cast("long")
