"""WARC archives whose records are Zstandard frames sharing a dictionary.

Each file starts with a skippable frame that holds the dictionary (magic 0x184D2A5D, as the WARC-Zstandard draft has it);
each record is a frame of its own, so a reader can start at any record. Files are written by Spark's text writer, a segment of
records a row, led by the dictionary again: its line separator is set to an empty skippable frame, which decoders pass over. So
the files have Spark's commit protocol and any file system it knows, and a new one is begun after some segments, however much
one task writes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlake.llm.shared import SLICE, scratch, stored

#: Magic numbers of the format.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("ascii")

#: Bytes of records before compression from which on a segment, one row for the text writer, is closed; segments in a file.
SEGMENT_BYTES, SEGMENTS = 32 * 1024 * 1024, 8

#: Bounds of the dictionary and of what it is trained on: records, and characters of each.
DICTIONARY_BYTES = 64 * 1024
SAMPLE_RECORDS = 1000
SAMPLE_CHARS = 8192

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def trained_dictionary(pages: DataFrame, payload: str, records: int = SAMPLE_RECORDS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from a hash sample of about ``records`` archived records, at most SAMPLE_CHARS of each.

    Payloads are sampled, each but once, however often it is archived. Empty if there are too few to train on. It only affects sizes; every record is archived whole.
    """
    hashed = pages.select(F.substring(payload, 1, SAMPLE_CHARS).alias("text"), F.xxhash64(payload).alias("hash"))
    different = hashed.agg(F.approx_count_distinct("hash")).first()[0]
    # Whole 64-bit hashes are compared with the bound, so a sample of any table that is not empty has rows.
    bound = min((1 << 63) - 1, -(1 << 63) + int(min(1.0, 1.5 * records / max(1, different)) * (1 << 64)))
    rows = hashed.where(F.col("hash") <= bound).dropDuplicates(["hash"]).select("text").limit(records).collect()
    if different and not rows:
        raise RuntimeError("the sample that the dictionary is trained on is empty")
    samples = [_record("0", "0", "", "", (row[0] or "").encode(), "", None) for row in rows]
    if sum(map(len, samples)) < 20 * 1024 or len(samples) < 20:
        return b""
    size = min(size, sum(map(len, samples)) // 10)
    return zstandard.train_dictionary(size, samples, k=200, d=8, level=3).as_bytes()


def with_responses(pages: DataFrame, page_id: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: for revisits the smallest page_id of those with an equal payload, else null.

    Payloads of under ``least_bytes`` are never revisits. Rows that repeat the smallest page_id are responses too, and so is
    every row where all page_ids of a payload are null. The smallest page_id of each digest is found with map-side combining;
    of the join with the pages, whose right side has one row a digest, adaptive execution splits the pages of a hot digest.
    """
    digest = F.sha1(F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8"))
    keyed = pages.withColumn("__digest", digest)
    long_enough = F.octet_length(F.coalesce(F.col(payload), F.lit(""))) >= least_bytes
    narrow = keyed.where(long_enough).select(F.col(page_id).alias("__page"), "__digest")
    repeated = narrow.groupBy("__digest").agg(F.min("__page").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    # Stored, so that the join shuffles both sides for itself; only then can a hot digest's pages be split.
    repeated = stored(repeated.select(F.col("__digest").alias("__key"), "__first"), "digests")
    alone = F.concat(F.lit("-"), F.xxhash64(page_id).cast("string"))
    again = keyed.withColumn("__key", F.when(long_enough, F.col("__digest")).otherwise(alone))
    return (
        again.join(repeated, "__key", "left")
        .withColumn("refers_to", F.when(~F.col("__first").eqNullSafe(F.col(page_id)), F.col("__first")))
        .drop("__key", "__first", "__digest")
    )


def write_archives(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    date: str | None = None,
    segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Writes a response or revisit record for every row; a revisit keeps its HTTP header but not the payload.

    Null payloads are empty, null urls give records without a target, a null page_id gives a record without ``Page-ID``. Each
    record has an identifier of its own, made of its place, also where page_ids repeat; page_ids are in the extension fields
    ``Page-ID`` and ``Page-Refers-To``. ``date`` is that of all records (ISO 8601), by default when writing began.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    dictionary = trained_dictionary(pages, payload)
    narrow = pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(payload).cast("string"))
    narrow = narrow.toDF("page_id", "url", "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True)
        lead = [struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary] if dictionary else []
        partition, number, frames, held = TaskContext.get().partitionId(), 0, list(lead), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for page, target, html, first in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns)):
                    body = (html or "").encode()
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    record = _record(f"{partition}:{number}", "" if page is None else str(page), target or "", date, body, digest, first)
                    frames.append(compressor.compress(record))
                    number, held = number + 1, held + len(record)
                    if held >= segment_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], names=["value"])
                        frames, held = list(lead), 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], names=["value"])

    rows = with_responses(narrow, "page_id", "html", least_bytes).select("page_id", "url", "html", "refers_to")
    frames = rows.mapInArrow(write, "value binary")
    # A binary column as text: the writer copies the bytes as they are.
    frames.select(F.col("value").cast("string")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", SEGMENTS).text(path)


def _record(name: str, page: str, url: str, date: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:record:{date}:{name}>"),
        ("WARC-Date", date),
        ("Page-ID", page),
        ("WARC-Target-URI", " ".join(url.split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("Page-Refers-To", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def frames(content: memoryview) -> Iterator[tuple[int | None, memoryview]]:
    """(magic, content) of skippable frames and (None, whole frame) of compressed ones, in order."""
    at = 0
    while at < len(content):
        magic, size = struct.unpack_from("<II", content, at)
        if magic in SKIPPABLE_FRAMES:
            yield magic, content[at + 8 : at + 8 + size]
            at += 8 + size
            continue
        end = at + zstandard.frame_header_size(content[at : at + 18])
        last = False
        while not last:
            block = int.from_bytes(content[end : end + 3], "little")
            last = bool(block & 1)
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        end += 4 * zstandard.get_frame_parameters(content[at : at + 18]).has_checksum
        yield None, content[at:end]
        at = end


def records(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an archive."""
    decompressor = zstandard.ZstdDecompressor()
    for magic, frame in frames(content):
        if magic == DICTIONARY_FRAME:
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(frame)))
        elif magic is None:
            record = decompressor.decompress(frame)
            head, _, block = record.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            if version != "WARC/1.1":
                raise ValueError("not a WARC record")
            fields = dict(line.split(": ", 1) for line in lines)
            yield fields, block[: int(fields["Content-Length"])]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, html) of every record; html is null for revisits.

    A payload that does not agree with its digest or length is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "html"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for content in batch.column(0):
                for fields, block in records(memoryview(content.as_buffer())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and (len(payload), digest) != (size, base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                        raise ValueError("a payload does not agree with its header")
                    page, first = fields.get("Page-ID"), fields.get("Page-Refers-To")
                    rows.append(
                        (
                            int(page) if page else None,
                            fields.get("WARC-Target-URI"),
                            fields["WARC-Type"],
                            int(first) if revisit else None,
                            size,
                            digest,
                            None if revisit else payload.decode(),
                        )
                    )
                    if len(rows) == SLICE:
                        yield batch_of()
                        rows = []
        yield batch_of()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(
        read,
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string",
    )


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives ``pages`` (page_id, url, html) in the shared scratch folder and reads every record back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, least_bytes=least_bytes)
    return read_archives(spark, path)
