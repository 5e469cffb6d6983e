"""Reference genomes."""

from __future__ import annotations

from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varlake.sources import blocks

#: Bases per chunk, and how many bases of the chunk before are stored in front of them.
CHUNK = 1024
OVERLAP = 128
#: Bases that an indexed read takes at a time, and how many such blocks are kept; lines of an index handed on at a time; endings of
#: FASTA files in a folder.
READ, BLOCKS = 1 << 16, 256
LINES = 10_000
SUFFIXES = (".fa", ".fasta", ".fna", ".fa.gz", ".fasta.gz", ".fna.gz", ".fa.bgz", ".txt")


def read_reference_bases(
    spark: SparkSession, path: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """FASTA → ``contigName, chunk_id, chunk_start, bases`` in upper case.

    Chunk ``i`` holds the positions from ``i * chunk - overlap`` (0 for the first chunk) to ``(i + 1) * chunk``. No
    contig is ever held in one piece: every line finds its own position. Each task goes through its file blocks line by line
    and adds up line lengths since the last header, so no line is sorted or moved for its position; between blocks only one
    row per block is passed on.
    """
    value = F.col("value")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.trim("value").alias("value"),
    )
    header = value.startswith(">")
    marked = lines.filter(F.length("value") > 0).select(
        "file",
        "block",
        F.when(header, F.regexp_extract("value", r"^>\s*(\S+)", 1)).alias("name"),
        F.when(header, F.lit("")).otherwise(value).alias("value"),
    )

    # What a block hands to the next ones: its last contig and the bases after that contig's header.
    blocks = marked.withColumn("value", F.length("value").cast("long")).mapInArrow(_block_ends, "file string, block long, last_name string, n_tail long")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    grouped = blocks.withColumn("run", F.count("last_name").over(earlier))
    in_run = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    # Bases since the latest header, at the end of each block; the first block of a run is the one with the header.
    ends = grouped.withColumns(
        {
            "open_name": F.last("last_name", ignorenulls=True).over(in_run),
            "open_bases": F.sum("n_tail").over(in_run),
        }
    )
    carried = ends.select(
        "file",
        "block",
        F.lag("open_name").over(Window.partitionBy("file").orderBy("block")).alias("carried_name"),
        F.lag("open_bases").over(Window.partitionBy("file").orderBy("block")).alias("carried_bases"),
    )
    pieces = marked.mapInArrow(
        partial(_pieces, most=chunk), "file string, block long, contigName string, at long, bases string, ends array<int>"
    )
    # One row per file block, so it is broadcast; only a block's lines before its first header need it.
    placed = pieces.join(F.broadcast(carried), ["file", "block"], "left").select(
        F.coalesce("contigName", "carried_name").alias("contigName"),
        (F.col("at") + F.when(F.col("contigName").isNull(), F.coalesce("carried_bases", F.lit(0))).otherwise(F.lit(0))).alias("at"),
        F.upper("bases").alias("bases"),
        "ends",
    )
    return _cut(placed, chunk, overlap)


class _Place:
    """Where a task is in its lines: file, block, the contig that began in this block, bases since it or the block began."""

    def __init__(self) -> None:
        self.key: tuple[str, int] | None = None
        self.contig: str | None = None
        self.at = 0
        #: The state at the end of each block that is done.
        self.ended: list[tuple[str, int, str | None, int]] = []

    def end(self) -> None:
        if self.key is not None:
            self.ended.append((*self.key, self.contig, self.at))

    def runs(self, batch: pa.RecordBatch, lengths: np.ndarray) -> Iterator[tuple[int, int]]:
        """Lines from, to of one contig in one block, by turns; the state is that before the lines while they are handled."""
        files, starts, names = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
        codes = files.dictionary_encode().indices.to_numpy()
        is_header = names.is_valid().to_numpy(zero_copy_only=False)
        changed = np.ones(len(starts), bool)
        changed[1:] = (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])
        begins = np.flatnonzero(changed | is_header).tolist()
        totals = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        for low, high in zip(begins, [*begins[1:], len(starts)]):
            if changed[low] and (key := (files[low].as_py(), int(starts[low]))) != self.key:
                self.end()
                self.key, self.contig, self.at = key, None, 0
            if is_header[low]:
                self.contig, self.at = names[low].as_py(), 0
                low += 1
            yield low, high
            self.at += totals[high] - totals[low]


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last contig (null: none begins there) and bases after its header, of each file block."""
    place = _Place()

    def out() -> pa.RecordBatch:
        columns = zip(*place.ended) if place.ended else [()] * 4
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        place.ended = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["file", "block", "last_name", "n_tail"]
        )

    for batch in batches:
        for _ in place.runs(batch, batch.column(3).to_numpy()):
            pass
        yield out()
    place.end()
    yield out()


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Whole lines of a contig put together, up to ``most`` bases (or one line), with the places at which each line ends.

    File and block are given where the contig began in an earlier block, and positions count from the block's begin then.
    """
    place = _Place()
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(3)
        lengths = pc.utf8_length(values).to_numpy()
        totals = np.concatenate([[0], np.cumsum(lengths)])
        sums = totals.tolist()
        rows, firsts, counts = [], [], []
        for low, high in place.runs(batch, lengths):
            key = place.key if place.contig is None else (None, None)
            first = low
            while first < high:
                after = min(high, max(first + 1, bisect_right(sums, sums[first] + most, first, high + 1) - 1))
                rows.append((*key, place.contig, place.at + sums[first] - sums[low]))
                firsts.append(first)
                counts.append(after - first)
                first = after
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [()] * 4, kinds)]
        # Lines follow each other in the batch's buffer, headers being empty: a piece is a stretch of it.
        wide = values.cast(pa.large_string())
        offsets = np.frombuffer(wide.buffers()[1], "i8", len(wide) + 1, wide.offset * 8)
        bounds = offsets[[*firsts, len(wide)]]
        bases = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(bounds.tobytes()), wide.buffers()[2])
        ends = totals[1:][batch.column(2).is_null().to_numpy(zero_copy_only=False)] - np.repeat(totals[firsts], counts)
        at = np.concatenate([[0], np.cumsum(counts)]).astype("i4")
        listed = pa.ListArray.from_arrays(pa.array(at), pa.array(ends.astype("i4")))
        arrays += [bases.cast(pa.string()), listed]
        yield pa.RecordBatch.from_arrays(arrays, names=["file", "block", "contigName", "at", "bases", "ends"])


def _cut(pieces: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Lines of sequence at known positions (``contigName, at, bases, ends``) → overlapping chunks of fixed size."""
    last = F.col("at") + F.length("bases") - 1
    # A base also belongs to the chunk that starts less than `overlap` bases behind it.
    ids = F.sequence(F.floor(F.col("at") / chunk), F.floor((last + overlap) / chunk))
    spread = pieces.withColumn("chunk_id", F.explode(ids)).withColumn(
        "low", F.greatest(F.col("chunk_id") * chunk - overlap, F.lit(0))
    )
    start = F.greatest("at", "low")
    stop = F.least(last + 1, (F.col("chunk_id") + 1) * chunk)
    clipped = spread.select(
        "contigName",
        "chunk_id",
        start.alias("at"),
        F.substring("bases", (start - F.col("at") + 1).cast("int"), (stop - start).cast("int")).alias("bases"),
        F.col("at").alias("piece_at"),
        "ends",
    ).filter(F.length("bases") > 0)
    # Bounded: the pieces of one chunk, at most chunk + overlap bases.
    chunks = clipped.groupBy("contigName", "chunk_id").agg(
        F.min("at").alias("chunk_start"),
        (F.sum(F.length("bases")) == F.max(F.col("at") + F.length("bases")) - F.min("at")).alias("apart"),
        F.collect_list(F.struct("at", "bases", "piece_at", "ends")).alias("parts"),
    )

    def text(parts: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(parts), lambda p: p["bases"]), "")

    def lines_of(piece: Column) -> Column:
        def line(end: Column, k: Column) -> Column:
            low = F.greatest(piece["piece_at"] + F.coalesce(F.get(piece["ends"], k - 1), F.lit(0)), piece["at"])
            high = F.least(piece["piece_at"] + end, piece["at"] + F.length(piece["bases"]))
            inside = F.substring(piece["bases"], (low - piece["at"] + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
            return F.struct(low.alias("at"), inside.alias("bases"))

        return F.filter(F.transform(piece["ends"], line), lambda one: F.length(one["bases"]) > 0)

    # Contigs of one name overlie each other, line by line.
    joined = F.when(F.col("apart"), text(F.col("parts"))).otherwise(text(F.flatten(F.transform("parts", lines_of))))
    # A chunk made only of overlap lies behind the contig's end.
    return chunks.select("contigName", "chunk_id", "chunk_start", joined.alias("bases")).filter(
        F.col("chunk_start") + F.length("bases") > F.col("chunk_id") * chunk
    )


# --- indexed reads -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class IndexedContig:
    """A line of a file's index: where a contig's bases begin, and how many bases and bytes its lines have."""

    path: str
    length: int
    offset: int
    line_bases: int
    line_bytes: int

    def place(self, position: int) -> int:
        return self.offset + position // self.line_bases * self.line_bytes + position % self.line_bases


class IndexedReference:
    """Contigs of indexed FASTA files; opens files, and keeps BLOCKS of the blocks it read, where it is used."""

    def __init__(self, contigs: dict[str, IndexedContig], places: dict[str, list[tuple[int, int]] | None]) -> None:
        self.contigs, self._places = contigs, places
        self._files: dict = {}
        self._blocks: OrderedDict[tuple[str, int, int], bytes] = OrderedDict()

    def __getstate__(self) -> tuple:
        return self.contigs, self._places

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    @classmethod
    def of(cls, path: str | Sequence[str]) -> IndexedReference:
        """By the index ``.fai`` beside each file; block-compressed files have a ``.gzi`` too. A folder is all files in it."""
        contigs: dict[str, IndexedContig] = {}
        places: dict[str, list[tuple[int, int]] | None] = {}
        for file, _ in blocks.listed([path] if isinstance(path, str) else list(path), SUFFIXES):
            system, name = blocks.located(f"{file}.fai")
            with system.open_input_file(name) as index:
                for line in index.read().decode().splitlines():
                    contig, *numbers = line.split("\t")
                    if contigs.setdefault(contig, one := IndexedContig(file, *map(int, numbers[:4]))) is not one:
                        raise ValueError(f"contig {contig} is in more than one place")
            places[file] = _places(file)
        return cls(contigs, places)

    def bases(self, contig: str, low: int, high: int) -> str:
        """Bases ``low`` to ``high`` of a contig, in upper case."""
        return self.bases_of(self.contigs[contig], low, high)

    def bases_of(self, one: IndexedContig, low: int, high: int) -> str:
        """As ``bases``, of a contig that need not be among ``contigs``."""
        out = []
        for number in range(low // READ, (high - 1) // READ + 1 if high > low else 0):
            text = self._block(one, number)
            out.append(text[max(0, low - number * READ) : high - number * READ])
        return b"".join(out).decode()

    def _block(self, one: IndexedContig, number: int) -> bytes:
        key = (one.path, one.offset, number)
        if key in self._blocks:
            self._blocks.move_to_end(key)
            return self._blocks[key]
        if one.path not in self._files:
            system, name = blocks.located(one.path)
            self._files[one.path] = system.open_input_file(name)
        if one.path not in self._places:
            self._places[one.path] = _places(one.path)
        low, high = number * READ, min((number + 1) * READ, one.length)
        text = blocks.text_range(self._files[one.path], self._places[one.path], one.place(low), one.place(high - 1) + 1)
        text = self._blocks[key] = text.replace(b"\n", b"").replace(b"\r", b"").upper()
        if len(self._blocks) > BLOCKS:
            self._blocks.popitem(last=False)
        return text


def _places(file: str) -> list[tuple[int, int]] | None:
    """Where the blocks of a block-compressed file are, by the ``.gzi`` beside it; None for plain files."""
    return blocks.gzi_places(f"{file}.gzi") if blocks.is_bgzf(file) else None


def _index_table(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The lines of all indexes: contigName, path, length, offset, line_bases, line_bytes. Genomes of many contigs have as many."""
    files = [file for file, _ in blocks.listed([path] if isinstance(path, str) else list(path), SUFFIXES)]
    for file in files:
        if not blocks.exists(f"{file}.fai"):
            raise FileNotFoundError(f"{file}.fai")
    names = spark.createDataFrame([(file,) for file in files], "path string").repartition(max(1, len(files)), "path")
    kind = "contigName string, path string, length long, offset long, line_bases long, line_bytes long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, name = blocks.located(f"{file}.fai")
                with system.open_input_stream(name, compression=None) as raw:
                    lines = _lines(raw)
                    while some := list(islice(lines, LINES)):
                        parts = [line.decode().rstrip("\r\n").split("\t") for line in some]
                        numbers = [pa.array([int(p[k]) for p in parts], pa.int64()) for k in range(1, 5)]
                        columns = [pa.array([p[0] for p in parts]), pa.array([file] * len(parts)), *numbers]
                        yield pa.RecordBatch.from_arrays(columns, names=["contigName", "path", "length", "offset", "line_bases", "line_bytes"])

    return names.mapInArrow(read, kind)


def index_bytes(path: str | Sequence[str]) -> int:
    """Size of all indexes together."""
    total = 0
    for file, _ in blocks.listed([path] if isinstance(path, str) else list(path), SUFFIXES):
        total += sum(size for _, size in blocks.listed([f"{file}.fai"], (".fai",)))
    return total


def unique_index(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The lines of all indexes; a contig that is in more than one place is an error."""
    index = _index_table(spark, path)
    twice = index.groupBy("contigName").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"contig {twice[0]['contigName']} is in more than one place")
    return index


def index_fasta(spark: SparkSession, path: str | Sequence[str]) -> None:
    """Writes ``.fai`` beside each plain FASTA file, a task for each. Lines of a contig but its last must be of one length."""
    files = blocks.listed([path] if isinstance(path, str) else list(path), SUFFIXES)
    names = spark.createDataFrame([(name,) for name, _ in files], "path string").repartition(max(1, len(files)), "path")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, place = blocks.located(f"{name}.fai")
                try:
                    with system.open_output_stream(f"{place}.part", compression=None) as out:
                        for row in _index_rows(name):
                            out.write(("\t".join(map(str, row)) + "\n").encode())
                except BaseException:
                    system.delete_file(f"{place}.part")
                    raise
                system.move(f"{place}.part", place)
            yield batch

    names.mapInArrow(index, "path string").count()


def _index_rows(path: str) -> Iterator[list]:
    """A row for each contig, handed on as soon as the next one begins."""
    one: list | None = None
    at, ended = 0, False
    system, name = blocks.located(path)
    with system.open_input_stream(name, compression=None) as raw:
        for line in _lines(raw):
            bases = line.rstrip(b"\r\n")
            if line.startswith(b">"):
                if one is not None:
                    yield _row(one)
                one = [line[1:].split()[0].decode(), 0, at + len(line), 0, 0]
                ended = False
            elif bases:
                if one is None:
                    raise ValueError(f"{path} does not begin with a contig's name")
                if not one[3]:
                    one[3:] = [len(bases), len(line)]
                if ended or len(bases) > one[3]:
                    raise ValueError(f"the lines of {one[0]} differ in length")
                ended = len(bases) < one[3]
                one[1] += len(bases)
            at += len(line)
    if one is not None:
        yield _row(one)


def _row(one: list) -> list:
    return one if one[3] else [*one[:3], 1, 1]


def _lines(raw) -> Iterator[bytes]:
    tail = b""
    while data := raw.read(1 << 20):
        *whole, tail = (tail + data).split(b"\n")
        yield from (line + b"\n" for line in whole)
    if tail:
        yield tail


def read_indexed_bases(
    spark: SparkSession,
    path: str | Sequence[str],
    wanted: DataFrame | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    partitions: int | None = None,
) -> DataFrame:
    """The chunks of ``read_reference_bases`` by the files' index: all, or those in ``wanted`` (contigName, chunk_id).

    Every task reads just the bytes around its chunks, in their order. Chunks that are wanted twice come once, those outside
    of the genome not at all.
    """
    index = unique_index(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = IndexedReference({}, {})
        for batch in batches:
            rows = []
            for contig, number, *line in zip(*[column.to_pylist() for column in batch.columns]):
                one = IndexedContig(*line)
                low, high = max(0, number * chunk - overlap), min((number + 1) * chunk, one.length)
                rows.append((contig, number, low, reference.bases_of(one, low, high)))
            columns = zip(*rows) if rows else [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["contigName", "chunk_id", "chunk_start", "bases"])

    if wanted is None:
        ids = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / chunk)))
        placed = index.where("length > 0").select("*", ids.alias("chunk_id"))
    else:
        narrow = wanted.select("contigName", F.col("chunk_id").cast("long").alias("chunk_id")).distinct()
        # Merged: Spark does not know how many contigs the index has, and there may be millions.
        held = (F.col("length") > 0) & F.col("chunk_id").between(F.lit(0), F.expr(f"(length - 1) div {chunk}"))
        placed = narrow.join(index.hint("merge"), "contigName").where(held)
    placed = placed.select("contigName", "chunk_id", "path", "length", "offset", "line_bases", "line_bytes")
    by = ["path", "offset", "chunk_id"]
    dealt = placed.repartitionByRange(partitions, *by) if partitions else placed.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by).mapInArrow(read, "contigName string, chunk_id long, chunk_start long, bases string")
