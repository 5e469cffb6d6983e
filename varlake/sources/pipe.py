"""Feeding rows to an external command."""

from __future__ import annotations

import subprocess
import threading
from collections.abc import Iterator, Mapping, Sequence
from itertools import groupby
from typing import Literal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlake._shared import scratch
from varlake.functions._columns import as_column
from varlake.functions.identifiers import variant_spdi
from varlake.schema.annotation import AnnotationSchema, parse_annotations
from varlake.sources.vcf import (
    VcfHeader,
    format_vcf_lines,
    header_of_lines,
    infer_vcf_header,
    parse_vcf_lines,
    sample_ids_of,
)

_BATCH = 10_000


def _through_command(command: Sequence[str], header: Sequence[str], env: Mapping[str, str] | None):
    """A partition function: header and rows go to stdin while stdout lines come back, both as streams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        process = subprocess.Popen(
            list(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8", env=env
        )
        failure: list[BaseException] = []

        def feed() -> None:
            try:
                with process.stdin as sink:
                    sink.writelines(f"{line}\n" for line in header)
                    sink.writelines(f"{line}\n" for line in first["value"])
                    for batch in batches:
                        sink.writelines(f"{line}\n" for line in batch["value"])
            except BrokenPipeError:
                # The command stopped reading; its exit code tells whether that was an error.
                for _ in batches:
                    pass
            except BaseException as error:
                failure.append(error)
                process.kill()

        feeder = threading.Thread(target=feed, daemon=True)
        feeder.start()
        try:
            lines: list[str] = []
            for line in process.stdout:
                lines.append(line.rstrip("\n"))
                if len(lines) >= _BATCH:
                    yield pd.DataFrame({"text": lines})
                    lines = []
            feeder.join()
            code = process.wait()
            if failure:
                raise failure[0]
            if code != 0:
                raise RuntimeError(f"command {list(command)!r} failed with exit code {code}")
            if lines:
                yield pd.DataFrame({"text": lines})
        finally:
            if process.poll() is None:
                process.kill()
                process.wait()

    return run


def pipe_lines(
    df: DataFrame,
    command: Sequence[str],
    input_format: Literal["vcf", "text"] = "vcf",
    header: Literal["infer"] | Sequence[str] = "infer",
    output_format: Literal["text", "vcf"] = "text",
    env: Mapping[str, str] | None = None,
) -> DataFrame:
    """Run a command once per partition, with the partition's rows as lines on its standard input.

    ``vcf`` input writes a header before each partition's lines; ``text`` input needs a column ``value``. ``text``
    output is one column ``text``. ``vcf`` output is parsed with the header that the command writes, so what it declares
    becomes columns; to read that header the command runs at once, and its output is kept in the shared folder. Where it
    writes none, the input's header counts. A failing command fails the task; give it arguments as a list, no shell is
    involved.
    """
    if input_format == "vcf":
        samples = sample_ids_of(df) if header == "infer" and "genotypes" in df.columns else None
        if header == "infer":
            header = infer_vcf_header(df.schema, samples or ())
        elif "genotypes" in df.columns:
            samples = VcfHeader.parse(header).sample_ids
        lines = format_vcf_lines(df, samples)
    else:
        header = [] if header == "infer" else header
        lines = df.select("value")
    text = lines.mapInPandas(_through_command(list(command), list(header), dict(env) if env else None), "text string")
    if output_format == "text":
        return text
    path = scratch(df.sparkSession, "pipe")
    text.withColumnRenamed("text", "value").write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    written = header_of_lines(kept)
    return parse_vcf_lines(kept, VcfHeader.parse(header) if written.column_line is None else written)


def pipe_resumable(
    df: DataFrame,
    command: Sequence[str],
    path: str,
    output_key: str,
    key: str = "id",
    parts: int = 200,
    parts_at_once: int = 50,
    lines_each: Literal["one", "some", "any"] = "one",
    env: Mapping[str, str] | None = None,
) -> DataFrame:
    """``pipe_lines`` of VCF input, in parts that are kept: (key, text). Calling it again with the same ``path`` goes on.

    Each row's key, unique and without blanks, is the line's ID; the SQL expression ``output_key`` finds it in an output line
    (column ``text``). Input lines are dealt into ``parts`` by key and stored in ``path``, in the shared store; the command runs
    once a part, and each set of ``parts_at_once`` is written, and then listed in a manifest, before the next. Where the command
    fails, what is listed stays, and another call runs only the other parts. A part that was written but not listed is replaced.
    At the end output is held against input: keys with no output line, or with several (``lines_each`` "some" allows several,
    "any" none too), and lines of unknown keys are an error; ``pipe_report`` lists them.
    """
    spark = df.sparkSession
    lines, out, manifest = (f"{path.rstrip('/')}/{name}" for name in ("input", "output", "manifest"))
    if not _stored(spark, lines):
        named = df.withColumn("names", F.array(F.col(key).cast("string"))).drop(*(["id"] if key != "id" else []))
        text = format_vcf_lines(named, sample_ids_of(df) if "genotypes" in df.columns else None)
        keyed = text.select(F.split("value", "\t")[2].alias("key"), "value")
        part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
        keyed.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(lines)
    samples = sample_ids_of(df) if "genotypes" in df.columns else ()
    through = _through_command(list(command), infer_vcf_header(df.schema, samples), dict(env) if env else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = ((part, rows) for batch in batches for part, rows in batch.groupby("part", sort=False))
        for part, some in groupby(pieces, key=lambda piece: piece[0]):
            for found in through(rows for _, rows in some):
                yield found.assign(part=part)

    stored = spark.read.schema("key string, value string, part int").parquet(lines)
    every = sorted(row["part"] for row in stored.select("part").distinct().collect())
    done = {row["part"] for row in spark.read.parquet(manifest).collect()} if _stored(spark, manifest) else set()
    waiting = [part for part in every if part not in done]
    for at in range(0, len(waiting), parts_at_once):
        some = waiting[at : at + parts_at_once]
        rows = stored.where(F.col("part").isin(some)).repartition(len(some), "part").sortWithinPartitions("part")
        written = rows.select("part", "value").mapInPandas(run, "text string, part int")
        written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(out)
        spark.createDataFrame([(part,) for part in some], "part int").coalesce(1).write.mode("append").parquet(manifest)
    wrong = pipe_report(spark, path, output_key, lines_each)
    some = wrong.limit(5).collect()
    if some:
        raise ValueError(f"output does not match input, for example: {[row.asDict() for row in some]}")
    return _piped(spark, path, output_key)


def pipe_report(spark: SparkSession, path: str, output_key: str, lines_each: Literal["one", "some", "any"] = "one") -> DataFrame:
    """(key, n_in, n_out) of the keys whose output lines are not as ``pipe_resumable`` wants them; n_in 0: unknown keys."""
    keys = spark.read.schema("key string, value string, part int").parquet(f"{path.rstrip('/')}/input")
    given = keys.groupBy("key").agg(F.count("*").alias("n_in"))
    found = _piped(spark, path, output_key).groupBy("key").agg(F.count("*").alias("n_out"))
    both = given.join(found.withColumnRenamed("key", "__key"), F.col("key").eqNullSafe(F.col("__key")), "full")
    counts = both.select(F.coalesce("key", "__key").alias("key"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_in", "n_out")])
    fits = {"one": F.col("n_out") == 1, "some": F.col("n_out") >= 1, "any": F.lit(True)}[lines_each]
    return counts.where(~((F.col("n_in") == 1) & fits))


def _piped(spark: SparkSession, path: str, output_key: str) -> DataFrame:
    return spark.read.schema("text string, part int").parquet(f"{path.rstrip('/')}/output").select(F.expr(output_key).alias("key"), "text")


def _stored(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def annotate(
    df: DataFrame,
    command: Sequence[str],
    schema: AnnotationSchema | T.StructType | None = None,
    contig: str | Column = "contigName",
    start: str | Column = "start",
    end: str | Column = "end",
    ref: str | Column = "referenceAllele",
    alt: str | Column = "alternateAlleles",
    id: str | Column | None = None,
    alt_is_array: bool = True,
    id_is_array: bool = True,
) -> DataFrame:
    """Annotate variants with a command that reads VCF and writes one JSON record per line.

    Column arguments may be SQL expressions. Without ``id`` each row is named by its SPDI identifier.
    """
    alts = as_column(alt) if alt_is_array else F.array(as_column(alt))
    if id is None:
        ids = F.array(variant_spdi(contig, start, ref, alts, join_alternate_alleles=True))
    else:
        ids = as_column(id) if id_is_array else F.array(as_column(id))
    sites = df.select(
        as_column(contig).alias("contigName"),
        as_column(start).alias("start"),
        as_column(end).alias("end"),
        ids.alias("names"),
        as_column(ref).alias("referenceAllele"),
        alts.alias("alternateAlleles"),
    )
    return parse_annotations(pipe_lines(sites, command), schema or AnnotationSchema())
