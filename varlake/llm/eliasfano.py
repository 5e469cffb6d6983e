"""Token files: concatenated ids with Elias-Fano coded document boundaries.

A file is a run of segments; each holds consecutive documents in ascending doc_id. Layout of a segment, little-endian:

    magic "EFTK", version u32, bytes of the rest u64, width of an id u32 (2 or 4), flags u32 (1: doc_ids are null),
    documents u64, ids u64, first doc_id i64, Elias-Fano list of the boundaries, Elias-Fano list of doc_id - first, ids

An Elias-Fano list of n ascending numbers up to u has l = floor(log2(u / n)) low bits per number, packed, and the high parts
as a bit vector with a one at (number >> l) + index; every SAMPLE-th one's position is kept so that ``select`` scans little.
That takes about 2 + log2(u / n) bits a number. One byte, a line feed, follows each segment: Spark's text writer puts it
there, which also gives the files its commit protocol on any file system.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varlake.llm.shared import SLICE, scratch
from varlake.llm.tokens import encoder

MAGIC = b"EFTK"
HEAD = struct.Struct("<4sIQIIQQq")
LIST = struct.Struct("<QQIIQ")
#: Ones of the high bits between two kept positions.
SAMPLE = 256
#: Ids after which a segment is closed; one longer document makes a longer segment.
SEGMENT = 2_000_000
#: Segments of a file: a task that writes more begins another one.
SEGMENTS = 32


class EliasFano:
    """Ascending unsigned numbers in near-minimal space, with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, universe: int) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples, self.universe = n, low_bits, low, high, samples, universe

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        numbers = np.asarray(numbers, "u8")
        n, universe = len(numbers), int(numbers[-1]) if len(numbers) else 0
        if n and np.any(numbers[1:] < numbers[:-1]):
            raise ValueError("the numbers must ascend")
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        if (universe >> low_bits) + n >= 1 << 32:
            raise ValueError("too many numbers for one list")
        ones = ((numbers >> np.uint64(low_bits)) + np.arange(n, dtype="u8")).astype("i8")
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, "u1")
        bits[ones] = 1
        shifts = np.arange(low_bits, dtype="u8")
        low = ((numbers[:, None] >> shifts) & np.uint64(1)).astype("u1")
        return cls(
            n,
            low_bits,
            np.packbits(low.ravel(), bitorder="little"),
            np.packbits(bits, bitorder="little"),
            ones[::SAMPLE].astype("u4"),
            universe,
        )

    def select(self, index: int) -> int:
        """Number ``index``, from the nearest kept position on."""
        if not 0 <= index < self.n:
            raise IndexError(index)
        at, missing = int(self.samples[index // SAMPLE]), index % SAMPLE
        byte = at // 8
        bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        bits[: at % 8] = 0
        while (ones := int(bits.sum())) <= missing:
            missing -= ones
            byte += 1
            bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        high = 8 * byte + int(np.flatnonzero(bits)[missing]) - index
        first = index * self.low_bits
        field = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8], bitorder="little")[first % 8 :]
        low = sum(int(bit) << place for place, bit in enumerate(field[: self.low_bits]))
        return high << self.low_bits | low

    def selected(self, first: int, stop: int) -> np.ndarray:
        """Numbers ``first`` to ``stop`` - 1: ``select`` of each, all from the kept position before the first of them on."""
        if not 0 <= first <= stop <= self.n:
            raise IndexError((first, stop))
        n, kept = stop - first, first // SAMPLE
        if not n:
            return np.empty(0, "u8")
        start = int(self.samples[kept]) // 8
        after = -(-stop // SAMPLE)
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start:end], bitorder="little")) + 8 * start
        at = int(np.searchsorted(ones, self.samples[kept])) + first - kept * SAMPLE
        high = ones[at : at + n].astype("u8") - np.arange(first, stop, dtype="u8")
        bit = first * self.low_bits
        field = np.unpackbits(self.low[bit // 8 : (stop * self.low_bits + 7) // 8], bitorder="little")
        low = field[bit % 8 : bit % 8 + n * self.low_bits].reshape(n, self.low_bits).astype("u8")
        places = (low << np.arange(self.low_bits, dtype="u8")).sum(axis=1, dtype="u8")
        return high << np.uint64(self.low_bits) | places

    def all(self) -> np.ndarray:
        return self.selected(0, self.n)

    def to_bytes(self) -> bytes:
        head = LIST.pack(self.n, self.universe, self.low_bits, len(self.samples), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The list at ``at`` and the place after it."""
        n, universe, low_bits, n_samples, n_high = LIST.unpack_from(data, at)
        at += LIST.size
        n_low = (n * low_bits + 7) // 8
        low = np.frombuffer(data, "u1", n_low, at)
        high = np.frombuffer(data, "u1", n_high, at + n_low)
        samples = np.frombuffer(data, "<u4", n_samples, at + n_low + n_high)
        return cls(n, low_bits, low, high, samples, universe), at + n_low + n_high + 4 * n_samples


def segment(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A segment of consecutive documents; ``ids`` are little-endian unsigned 32-bit. All doc_ids are null, or none is."""
    ends = np.cumsum([0, *(len(part) // 4 for part in ids)], dtype="u8")
    null = bool(doc_ids) and doc_ids[0] is None
    first = 0 if null or not doc_ids else doc_ids[0]
    offsets = np.array([0 if null else (doc_id - first) for doc_id in doc_ids], "u8")
    joined = np.frombuffer(b"".join(ids), "<u4")
    if width == 2 and len(joined) and int(joined.max()) > 0xFFFF:
        raise ValueError("an id does not fit two bytes")
    body = EliasFano.of(ends).to_bytes() + EliasFano.of(offsets).to_bytes() + joined.astype(f"<u{width}").tobytes()
    rest = len(body) + HEAD.size - 16
    return HEAD.pack(MAGIC, 1, rest, width, int(null), len(ids), int(ends[-1]), first) + body


class Segment:
    """A segment that is read: ``boundary`` and ``document`` go through the select structures."""

    def __init__(self, data: memoryview, at: int) -> None:
        magic, version, rest, width, self.null, self.n_docs, self.n_ids, self.first = HEAD.unpack_from(data, at)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        self.boundaries, place = EliasFano.read(data, at + HEAD.size)
        self.offsets, place = EliasFano.read(data, place)
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, place)
        self.end = at + 16 + rest

    def boundary(self, index: int) -> int:
        return self.boundaries.select(index)

    def document(self, index: int) -> np.ndarray:
        return self.ids[self.boundary(index) : self.boundary(index + 1)]

    def doc_ids(self, first: int = 0, stop: int | None = None) -> list[int | None]:
        stop = self.n_docs if stop is None else stop
        if self.null:
            return [None] * (stop - first)
        return [self.first + int(offset) for offset in self.offsets.selected(first, stop)]


def segments(content: bytes) -> Iterator[Segment]:
    """All segments of a file."""
    data, at = memoryview(content), 0
    while at < len(data):
        found = Segment(data, at)
        yield found
        at = found.end + 1


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 0, width: int = 2, files: int | None = None
) -> None:
    """Encodes every text and writes token files to ``path``; the files' names ascend with their doc_ids, nulls first.

    Texts are dealt into ranges of doc_id and sorted there; equal doc_ids follow each other in the order of their texts.
    Null texts are empty. A task holds the ids of one segment only. ``width`` is the bytes of an id in the file.
    """
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encoded
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment(doc_ids, ids, width)], pa.binary())], names=["value"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if doc_ids and (held >= SEGMENT or (doc_ids[-1] is None) != (doc_id is None)):
                        yield closed()
                        doc_ids, ids, held = [], [], 0
                    doc_ids.append(doc_id)
                    ids.append(encode(text) + end)
                    held += len(ids[-1]) // 4
        if doc_ids:
            yield closed()

    ranges = [F.col("doc_id").asc_nulls_first()]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    dealt = narrow.repartitionByRange(files, *ranges) if files else narrow.repartitionByRange(*ranges)
    rows = dealt.sortWithinPartitions(*ranges, F.col("text").asc_nulls_first()).mapInArrow(write, "value binary")
    # A binary column as text: the writer copies the bytes as they are.
    rows.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", SEGMENTS).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: ``start`` counts the ids of all documents before."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for number, found in enumerate(segments(content.as_buffer())):
                    # Select gives the bounds of some documents at a time; no table of all is made.
                    for first in range(0, found.n_docs, SLICE):
                        stop = min(first + SLICE, found.n_docs)
                        bounds = found.boundaries.selected(first, stop + 1).astype("i8")
                        crcs = [zlib.crc32(found.ids[a:b].astype("<u4")) for a, b in zip(bounds, bounds[1:])]
                        n = len(crcs)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([name] * n, pa.int64()),
                                pa.array([number] * n, pa.int64()),
                                pa.array(found.doc_ids(first, stop), pa.int64()),
                                pa.array(bounds[:-1], pa.int64()),
                                pa.array(np.diff(bounds), pa.int64()),
                                pa.array(crcs, pa.int64()),
                            ],
                            names=["file", "segment", "doc_id", "at", "n_tokens", "ids_crc32"],
                        )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    # A task's files are numbered after its own number.
    place = F.regexp_extract("path", r"part-(\d+)", 1).cast("long") * (1 << 24) + F.regexp_extract("path", r"-c(\d+)[^/]*$", 1).cast("long")
    found = files.select(place, "content").mapInArrow(
        read, "file long, segment long, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    # One row a segment: millions of ids each, so a plain running total over them is small.
    totals = found.groupBy("file", "segment").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file", "segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(starts, ["file", "segment"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, vocabulary: str, end_id: int | None = 0, width: int = 2) -> DataFrame:
    """Writes the files to the shared scratch folder and reads them back. An empty table gives an empty result."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_token_files(docs, path, vocabulary, end_id, width)
    return read_token_files(spark, path)
