"""Block-compressed VCF files: scans by ranges of bytes, region reads through an index, and a sorted, indexed sink.

Files are reached from tasks through the file system that their path names (local, or one that pyarrow knows). A scan cuts
files at any byte; every part begins at the first block header that it finds. Filters on contigName, start, end and qual are
handed down: with an index beside a file only the blocks of their region are read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from varlake.sources import blocks
from varlake.sources.vcf import VcfHeader, format_vcf_lines, header_of_lines, infer_vcf_header, parse_vcf_lines, sample_ids_of

SUFFIXES = (".vcf.bgz", ".vcf.gz", ".bgz", ".gz")
#: Compressed bytes of a part of a scan, and rows of a batch.
PART_BYTES, BATCH = 32 * 1024 * 1024, 4_096

SCHEMA = "contigName string, start long, end long, qual double, value string"
_END = re.compile(rb"(?:^|;)END=(\d+)(?:;|$)")


@dataclass(frozen=True)
class Wanted:
    """What pushed filters ask for: contigs (None: any), bounds of start and end, and the least qual."""

    contigs: frozenset[str] | None = None
    start: tuple[float, float] = (-math.inf, math.inf)
    end: tuple[float, float] = (-math.inf, math.inf)
    qual: tuple[float, float] = (-math.inf, math.inf)

    def narrowed(self, one: Filter) -> Wanted:
        """With one more filter; those it does not know, and strict bounds, are taken as wider ones."""
        name = one.attribute[0] if getattr(one, "attribute", None) and len(one.attribute) == 1 else None
        if name == "contigName" and isinstance(one, (EqualTo, In)):
            values = frozenset(one.value if isinstance(one, In) else [one.value])
            return replace(self, contigs=values if self.contigs is None else self.contigs & values)
        if name not in ("start", "end", "qual") or not isinstance(one, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            return self
        low, high = getattr(self, name)
        if not isinstance(one, (LessThan, LessThanOrEqual)):
            low = max(low, one.value)
        if not isinstance(one, (GreaterThan, GreaterThanOrEqual)):
            high = min(high, one.value)
        return replace(self, **{name: (low, high)})

    @property
    def anything(self) -> bool:
        return self == Wanted()

    def region(self) -> tuple[int, int]:
        """Positions that every wanted record overlaps."""
        low = max(self.start[0], self.end[0] - 1, 0)
        high = min(self.start[1] + 1, self.end[1])
        return int(low), int(min(high, 1 << 62))

    def holds(self, contig: str, start: int, end: int, qual: float | None) -> bool:
        if self.contigs is not None and contig not in self.contigs:
            return False
        if not (self.start[0] <= start <= self.start[1] and self.end[0] <= end <= self.end[1]):
            return False
        return self.qual == (-math.inf, math.inf) or (qual is not None and self.qual[0] <= qual <= self.qual[1])


@dataclass
class Part(InputPartition):
    """A part of a file: compressed bytes, or virtual offsets where it comes from an index."""

    path: str
    size: int
    start: int
    stop: int
    virtual: bool

    def compressed(self) -> int:
        return (self.stop >> 16) - (self.start >> 16) + blocks.LARGEST if self.virtual else self.stop - self.start


def planned(paths: Sequence[str], wanted: Wanted, part_bytes: int) -> list[Part]:
    """The parts that a scan reads. Where an index stands beside a file and a contig is asked for, only its region."""
    parts: list[Part] = []
    for path, size in blocks.listed(list(paths), SUFFIXES):
        index = None if wanted.contigs is None else blocks.Tabix.of(path)
        if index is not None:
            for contig in sorted(wanted.contigs & set(index.contigs)):
                for first, after in index.ranges(contig, *wanted.region()):
                    parts += [Part(path, size, a, b, True) for a, b in index.cut(contig, first, after, part_bytes)]
        else:
            parts += [Part(path, size, at, min(at + part_bytes, size), False) for at in range(0, size, part_bytes)]
    return parts


def _number(text: bytes) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _site(line: bytes) -> tuple[str, int, int, float | None] | None:
    """(contig, start, end, qual) of a record; None if it is none."""
    parts = line.split(b"\t", 8)
    if len(parts) < 6 or not parts[1].isdigit():
        return None
    start = int(parts[1]) - 1
    said = _END.search(parts[7].split(b"\t")[0]) if len(parts) > 7 else None
    end = int(said[1]) if said else start + len(parts[3])
    return parts[0].decode(), start, end, _number(parts[5])


class BlockReader(DataSourceReader):
    def __init__(self, paths: list[str], part_bytes: int) -> None:
        self.paths, self.part_bytes, self.wanted = paths, part_bytes, Wanted()

    def partitions(self) -> list[Part]:
        return planned(self.paths, self.wanted, self.part_bytes)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, name = blocks.located(part.path)
        rows: list[tuple] = []
        with system.open_input_file(name) as file:
            if part.virtual:
                lines = blocks.lines_of_offsets(file, part.start, part.stop)
            else:
                lines = blocks.lines_of_bytes(file, part.start, part.stop, part.size)
            for _, line in lines:
                site = None if line.startswith(b"#") else _site(line)
                if site is not None and self.wanted.holds(*site):
                    rows.append((*site, line.decode()))
                elif self.wanted.anything:
                    rows.append((None, None, None, None, line.decode()))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


class FilteringBlockReader(BlockReader):
    """Hands filters down. All of them stay with Spark too, so that what is kept here may be a little more."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            self.wanted = self.wanted.narrowed(one)
            yield one


_ARROW = pa.schema([("contigName", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("qual", pa.float64()), ("value", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, still in its own folder: (name there, final name)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class BlockFileWriter(DataSourceArrowWriter):
    """Tasks write files and their indexes to a folder of the job's own; the commit moves those of tasks that counted."""

    def __init__(self, path: str, header: list[str]) -> None:
        self.path, self.header = path.rstrip("/"), header
        self.job = uuid.uuid4().hex

    @property
    def _own(self) -> str:
        return f"{self.path}/_temporary-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        partition, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        system, root = blocks.located(f"{self._own}/{partition:05d}-{attempt}")
        name, writer, index = f"part-{partition:05d}.vcf.bgz", None, blocks.Tabix()
        sink = None
        for batch in batches:
            for value in batch.column(batch.schema.get_field_index("value")).to_pylist():
                if writer is None:
                    system.create_dir(root)
                    sink = system.open_output_stream(f"{root}/{name}", compression=None)
                    writer = blocks.BlockWriter(sink)
                    writer.write("".join(f"{line}\n" for line in self.header).encode())
                line = value.encode()
                first = writer.offset
                writer.write(line + b"\n")
                contig, start, end, _ = _site(line)
                index.add(contig, max(start, 0), max(end, start + 1, 1), first, writer.offset)
        if writer is None:
            return Written()
        writer.close()
        sink.close()
        beside = f"{name}{index.suffix}"
        with system.open_output_stream(f"{root}/{beside}", compression=None) as out:
            out.write(index.to_bytes())
        return Written([(f"{root}/{one}", one) for one in (name, beside)])

    def commit(self, messages: list[Written | None]) -> None:
        system, root = blocks.located(self.path)
        system.create_dir(root)
        files = [one for message in messages if message is not None for one in message.files]
        for made, name in files:
            system.move(made, f"{root}/{name}")
        if not files:
            # A table without rows is a file with a header.
            with system.open_output_stream(f"{root}/part-00000.vcf.bgz", compression=None) as sink:
                writer = blocks.BlockWriter(sink)
                writer.write("".join(f"{line}\n" for line in self.header).encode())
                writer.close()
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass
        self._removed()

    def abort(self, messages: list[Written | None]) -> None:
        self._removed()

    def _removed(self) -> None:
        system, own = blocks.located(self._own)
        if system.get_file_info(own).type == fs.FileType.Directory:
            system.delete_dir(own)


class BlockSource(DataSource):
    """Lines of block-compressed VCF files with the columns that filters can be handed down on, and their sink."""

    @classmethod
    def name(cls) -> str:
        return "vcf_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = FilteringBlockReader if self.options.get("pushdown") == "true" else BlockReader
        return kind(self.options["paths"].split("\n"), int(self.options.get("partBytes", PART_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BlockFileWriter(self.options["path"], self.options["header"].split("\n"))


def scan_blocks(spark: SparkSession, path: str | Sequence[str], part_bytes: int = PART_BYTES, pushdown: bool = True) -> DataFrame:
    """(contigName, start, end, qual, value) of each line of block-compressed VCF files; header lines have a value only.

    ``start`` is 0-based. Filters on the first four columns are handed down, see the module; that needs the session's
    ``spark.sql.python.filterPushdown.enabled``, which is set here. A folder stands for the files in it.
    """
    spark.dataSource.register(BlockSource)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    paths = [path] if isinstance(path, str) else list(path)
    options = {"paths": "\n".join(paths), "partBytes": str(part_bytes), "pushdown": str(pushdown).lower()}
    return spark.read.format("vcf_blocks").options(**options).load()


def in_blocks(path: str | Sequence[str]) -> bool:
    """Whether all files of a path end as block-compressed ones do and the first is one, as far as can be seen from here."""
    try:
        files = blocks.listed([path] if isinstance(path, str) else list(path), SUFFIXES)
    except (OSError, ValueError):
        return False
    return bool(files) and all(name.endswith(SUFFIXES) for name, _ in files) and blocks.is_bgzf(files[0][0])


def text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(value) of text files: by parts of each file where they are block-compressed, else as Spark reads text."""
    paths = path if isinstance(path, str) else list(path)
    return scan_blocks(spark, path).select("value") if in_blocks(path) else spark.read.text(paths)


def header_of_blocks(spark: SparkSession, path: str | Sequence[str]) -> VcfHeader:
    """The merged header of all files, of which only the first blocks are read, in one task each."""
    paths = [path] if isinstance(path, str) else list(path)
    files = blocks.listed(paths, SUFFIXES)
    names = spark.createDataFrame([(at, name, size) for at, (name, size) in enumerate(files)], "at long, path string, size long")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                system, place = blocks.located(name)
                found: list[str] = []
                with system.open_input_file(place) as file:
                    for _, line in blocks.lines_of_bytes(file, 0, size, size):
                        if not line.startswith(b"#"):
                            break
                        found.append(line.decode())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    lines = names.repartitionByRange(max(1, len(files)), "at").sortWithinPartitions("at").mapInArrow(heads, "value string")
    return header_of_lines(lines)


def read_vcf_blocks(
    spark: SparkSession,
    path: str | Sequence[str],
    include_sample_ids: bool = True,
    split_to_biallelic: bool = False,
    header: VcfHeader | None = None,
    where: str | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``read_vcf`` of block-compressed files: one file is read by as many tasks as it has parts.

    ``where`` is a condition on contigName, start (0-based), end and qual. What it says of these is handed down to the scan,
    so with an index only the blocks of a region are read, and lines that it drops are never parsed.
    """
    header = header or header_of_blocks(spark, path)
    lines = scan_blocks(spark, path, part_bytes)
    lines = lines.where(where) if where else lines
    return parse_vcf_lines(lines.select("value"), header, include_sample_ids, split_to_biallelic)


def write_vcf_blocks(
    df: DataFrame, path: str, sample_ids: Sequence[str] | None = None, partitions: int | None = None
) -> None:
    """Writes a variant table sorted by (contigName, start), as block-compressed files with an index beside each.

    The files' names ascend with their positions; indexes are tabix ones, or CSI where positions go beyond 2**29. Nothing is at ``path`` before all tasks have ended: they write to a folder
    of their own, and only the files of those that counted are moved. An existing ``path`` is an error.
    """
    if blocks.exists(path):
        raise FileExistsError(path)
    if sample_ids is None:
        sample_ids = sample_ids_of(df) if "genotypes" in df.columns else ()
    header = infer_vcf_header(df.schema, sample_ids)
    by = ["contigName", "start", "end", "referenceAllele"]
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    lines = format_vcf_lines(dealt.sortWithinPartitions(*by), sample_ids)
    df.sparkSession.dataSource.register(BlockSource)
    lines.write.format("vcf_blocks").option("header", "\n".join(header)).mode("append").save(path)
