"""Exact removal of repeated byte strings with blockwise suffix sorting over a difference cover.

A string of ``length`` bytes that starts at two places is found by sorting suffixes, one bucket of suffixes at a time, and
looking at neighbours. Buckets come from the content: every window of ``length`` bytes holds one k-gram with the smallest
hash, and windows that are equal hold the same one at the same place. Consecutive windows with the same smallest k-gram make
a block. Blocks whose k-gram occurs nowhere else hold no repeated window; equal blocks repeat all of theirs; only different
blocks around one k-gram need sorting, and these make up the buckets.

Within a bucket, suffixes are compared by their first PERIOD bytes; ties go to the rank of a later suffix, whose place lies in
a difference cover modulo PERIOD and so was ranked beforehand. Ranks of the cover's suffixes double their depth until it
passes ``length``. Blocks are laid out with their k-grams at multiples of PERIOD, so tied suffixes need the same shift.

A bucket of over BUCKET blocks would not fit a task; its windows are counted by fingerprints in Spark instead, exactly but
for 128-bit collisions, which also bound the chance of error of the block keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from varlake.llm.shared import SLICE, map_slices, released, stored

#: Bytes of the k-grams.
GRAM = 48
#: Blocks around one k-gram that are sorted in one task, and blocks that are sorted at a time.
BUCKET, BATCH = 20_000, 4_000

# A perfect difference set, each residue but 0 is one difference of two of its members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)

_ODD = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, "u8") * np.uint64(2) + np.uint64(1)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, 1 << 17)
        tables = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            table = np.full(size + 1, base, "u8")
            table[0] = 1
            tables.append(np.cumprod(table))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = hashes ^ (hashes >> np.uint64(32))
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    return hashes


def blocks(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k-gram hash, block key, first start, last start, place of the k-gram) of each block; empty if ``data`` is shorter."""
    n, gram = len(data), min(GRAM, length)
    if n < length:
        return (np.empty(0, "u8"),) * 2 + (np.empty(0, "i8"),) * 3
    powers, inverses = _power(n)
    sums = np.zeros(n + 1, "u8")
    np.cumsum(_BYTES[np.frombuffer(data, "u1")] * powers[:n], out=sums[1:])
    grams = _mixed((sums[gram:] - sums[:-gram]) * inverses[: n - gram + 1])
    # The smaller of two minima with their places, over windows of 1, 2, 4, ... k-grams; the leftmost wins ties.
    width = length - gram + 1
    least = (grams & _HIGH) | np.arange(len(grams), dtype="u8")
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    chosen = (least & _LOW).astype("i8")
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [len(chosen)]]) - 1
    at = chosen[first]
    shape = (at - first).astype("u8") << np.uint64(32) | (last - first).astype("u8")
    keys = _mixed((sums[last + length] - sums[first]) * inverses[first] ^ _mixed(shape))
    return grams[at], keys, first, last, at


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, big-endian, so that numbers compare as the bytes do."""
    padded = np.concatenate([text, np.zeros(8, "u1")])
    return np.ndarray((len(text),), ">u8", padded.data, 0, (1,)).astype("u8")


def _ranked(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense ranks) of rows by their columns, the first column first."""
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), bool)
    for column in columns:
        ordered = column[order]
        fresh[1:] |= ordered[1:] != ordered[:-1]
    ranks = np.empty(len(order), "i8")
    ranks[order] = np.cumsum(fresh)
    return order, ranks


def cover_ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes whose places modulo PERIOD lie in COVER, compared over at least ``depth`` bytes; others 0."""
    n = len(words)
    places = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    padded = np.concatenate([words, np.zeros(32, "u8")])
    _, ranks = _ranked([padded[places + 8 * part] for part in range(4)])
    table = np.zeros(n, "i8")
    reach = PERIOD
    while True:
        table[places] = ranks + 1
        if reach >= depth:
            return table
        later = np.where(places + reach < n, table[np.minimum(places + reach, n - 1)], 0)
        _, ranks = _ranked([ranks, later])
        reach *= 2


def repeated_windows(texts: list[bytes], starts: list[int], anchors: list[int], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each block the starts of windows that occur in another block too, or in a block of weight over 1.

    A block is its bytes; its windows start at 0 to ``starts``, and its k-gram is at ``anchors``.
    """
    shift = {residue: next(d for d in range(PERIOD) if (residue + d) % PERIOD in COVER) for residue in range(PERIOD)}
    origins, size = [], 0
    for text, anchor in zip(texts, anchors):
        size += -(size + anchor) % PERIOD
        origins.append(size)
        size += len(text)
    joined = np.zeros(size, "u1")
    for origin, text in zip(origins, texts):
        joined[origin : origin + len(text)] = np.frombuffer(text, "u1")
    words = _words(joined)
    ranks = cover_ranks(words, length)
    counts = np.array(starts) + 1
    block = np.repeat(np.arange(len(texts)), counts)
    inside = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = np.array(origins)[block] + inside
    residues = places % PERIOD
    shifts = np.array([shift[residue] for residue in range(PERIOD)])[residues]
    padded = np.concatenate([words, np.zeros(32, "u8")])
    tied = [residues, *(padded[places + 8 * part] for part in range(4))]
    order, _ = _ranked([*tied, np.concatenate([ranks, np.zeros(PERIOD, "i8")])[places + shifts]])
    one, two = places[order[:-1]], places[order[1:]]
    same = np.arange(len(one))
    for part in [*range(0, length - 7, 8), length - 8]:
        same = same[words[one[same] + part] == words[two[same] + part]]
    equal = np.zeros(len(order), bool)
    equal[same + 1] = True
    group = np.cumsum(~equal) - 1
    total = np.bincount(group, weights[block[order]])
    hit = np.zeros(len(order), bool)
    hit[order] = total[group] > 1
    return np.split(inside[hit], np.searchsorted(block[hit], np.arange(1, len(texts))))


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers, as (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))


def _scanned(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, n_bytes, sha256, grams, keys) per row."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, grams, keys = [], [], [], []
        for text in batch.column(1).to_pylist():
            data = (text or "").encode()
            found = blocks(data, length)
            sizes.append(len(data))
            digests.append(hashlib.sha256(data).digest())
            grams.append(found[0].view("i8"))
            keys.append(found[1].view("i8"))
        columns = [
            pa.array(sizes, pa.int64()),
            pa.array(digests, pa.binary()),
            pa.array(grams, pa.list_(pa.int64())),
            pa.array(keys, pa.list_(pa.int64())),
        ]
        names = ["doc_id", "text_hash", "n_bytes", "sha256", "grams", "keys"]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=names)

    keyed = _keyed(docs)
    kind = keyed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, n_bytes long, sha256 binary, grams array<long>, keys array<long>"
    return map_slices(keyed, scan, schema)


def _joined(docs: DataFrame, found: DataFrame, once: bool) -> DataFrame:
    """Texts of the documents in ``found`` (doc_id, text_hash, ...); with ``once`` a repeated row comes a single time."""
    right = found.withColumnsRenamed({"doc_id": "__doc_id", "text_hash": "__hash"})
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_hash") == F.col("__hash"))
    joined = _keyed(docs).join(right, same)
    if once:
        place = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(0)))
        joined = joined.withColumn("__place", place).where("__place = 1").drop("__place")
    return joined.drop("__doc_id", "__hash")


def _cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(gram, n, doc_id, text_hash, first, last, anchor, bytes) of the wanted blocks (gram, key, n, doc_id, text_hash)."""
    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("gram", "key", "n")).alias("want"))
    joined = _joined(docs, lists, once=True).select("doc_id", "text_hash", "text", "want")
    kind = joined.schema["doc_id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = ["gram", "n", "row", "first", "last", "anchor", "bytes"]
        out: dict[str, list] = {name: [] for name in names}
        for row, (text, want) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            data = text.encode()
            grams, keys, first, last, at = blocks(data, length)
            place = {pair: i for i, pair in enumerate(zip(grams.view("i8").tolist(), keys.view("i8").tolist()))}
            for one in want:
                i = place[one["gram"], one["key"]]
                values = one["gram"], one["n"], row, int(first[i]), int(last[i]), int(at[i]), data[first[i] : last[i] + length]
                for name, value in zip(names, values):
                    out[name].append(value)
        rows = pa.array(out.pop("row"), pa.int64())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(values, one) for values, one in zip(out.values(), kinds)]
        columns[2:2] = [batch.column(0).take(rows), batch.column(1).take(rows)]
        return pa.RecordBatch.from_arrays(columns, names=["gram", "n", "doc_id", "text_hash", *names[3:]])

    schema = f"gram long, n long, doc_id {kind}, text_hash long, first long, last long, anchor long, bytes binary"
    return map_slices(joined, cut, schema)


def _sorted_buckets(cut: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, first, last): starts of repeated windows in blocks that occur once, by suffix sorting."""
    kind = cut.schema["doc_id"].dataType.simpleString()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def resolved() -> pa.RecordBatch:
            found = repeated_windows(
                [one["bytes"] for one in held],
                [one["last"] - one["first"] for one in held],
                [one["anchor"] - one["first"] for one in held],
                np.array([one["n"] for one in held]),
                length,
            )
            rows = [
                (one["doc_id"], one["text_hash"], one["first"] + a, one["first"] + b)
                for one, starts in zip(held, found)
                if one["n"] == 1
                for a, b in _ranges(starts)
            ]
            columns = zip(*rows) if rows else [()] * 4
            types = [doc_type, pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "text_hash", "first", "last"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, SLICE):
                for one in batch.slice(at, SLICE).to_pylist():
                    # A bucket ends where its k-gram does.
                    if len(held) >= BATCH and one["gram"] != held[-1]["gram"]:
                        yield resolved()
                        held = []
                    held.append(one)
        if held:
            yield resolved()

    dealt = cut.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(resolve, f"doc_id {kind}, text_hash long, first long, last long")


def _counted_windows(cut: DataFrame, length: int) -> DataFrame:
    """The same for buckets of any size: windows are counted by their fingerprints."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                starts = range(one["last"] - one["first"] + 1)
                prints = [hashlib.blake2b(one["bytes"][i : i + length], digest_size=16).digest() for i in starts]
                n = len(prints)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(prints, pa.binary()),
                        pa.array([one["n"]] * n, pa.int64()),
                        pa.array([one["doc_id"]] * n, batch.schema.field("doc_id").type),
                        pa.array([one["text_hash"]] * n, pa.int64()),
                        pa.array([one["first"] + i for i in starts], pa.int64()),
                    ],
                    names=["print", "n", "doc_id", "text_hash", "first"],
                )

    kind = cut.schema["doc_id"].dataType.simpleString()
    rows = cut.mapInArrow(windows, f"print binary, n long, doc_id {kind}, text_hash long, first long")
    repeated = rows.groupBy("print").agg(F.sum("n").alias("total")).where("total > 1").select("print")
    return rows.where("n = 1").join(repeated, "print").select("doc_id", "text_hash", "first", F.col("first").alias("last"))


def _removed(data: bytes, length: int, whole: list[int], ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte runs (start, stop) that the whole blocks and the ranges of starts cover."""
    spans = list(ranges)
    if whole:
        _, _, first, last, _ = blocks(data, length)
        spans += [(int(first[i]), int(last[i])) for i in whole]
    runs: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if runs and first <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(runs[-1][1], last + length)
        else:
            runs.append((first, last + length))
    return runs


def repeats(docs: DataFrame, length: int = 200) -> tuple[DataFrame, DataFrame]:
    """(per row of ``docs`` its key, n_bytes and sha256; per document with repeats its key, ``whole`` and ``ranges``).

    The key is (doc_id, text_hash). ``whole`` numbers the document's blocks (see ``blocks``) all of whose windows start
    elsewhere too, ``ranges`` are other starts of such windows. Rows that repeat a key count as that many places.
    """
    scanned = stored(_scanned(docs, length), "blocks")
    grams = scanned.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("__n")).where("__n > 1")
    # Stored, so that the join shuffles both sides for itself and adaptive execution can split a hot k-gram's rows.
    grams = stored(grams.select("gram"), "grams")
    rows = scanned.select("doc_id", "text_hash", F.posexplode(F.arrays_zip("grams", "keys")).alias("number", "block")).select(
        "doc_id", "text_hash", F.col("number").cast("int"), F.col("block.grams").alias("gram"), F.col("block.keys").alias("key")
    )
    shared = stored(rows.join(grams, "gram"), "shared")
    released(docs.sparkSession)
    different = stored(
        shared.groupBy("gram", "key").agg(
            F.count("*").alias("n"), F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash")
        ),
        "different",
    )
    whole = shared.join(different.where("n > 1").select("gram", "key"), ["gram", "key"])
    whole = stored(whole.groupBy("doc_id", "text_hash").agg(F.collect_set("number").alias("whole")), "whole")
    released(docs.sparkSession)
    sizes = different.groupBy("gram").agg(F.count("*").alias("blocks")).where("blocks > 1")
    cut = stored(_cut_out(docs, different.join(sizes, "gram"), length), "cut")
    released(docs.sparkSession)
    over = sizes.where(F.col("blocks") > BUCKET).select("gram")
    usual = cut.join(over, "gram", "left_anti")
    partly = _sorted_buckets(usual, length).unionByName(_counted_windows(cut.join(over, "gram"), length))
    ranges = partly.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    other = ranges.withColumnsRenamed({"doc_id": "__doc_id", "text_hash": "__hash"})
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("text_hash").eqNullSafe(F.col("__hash"))
    both = whole.join(other, same, "full").select(
        F.when(F.col("__hash").isNull(), F.col("doc_id")).otherwise(F.col("__doc_id")).alias("doc_id"),
        F.coalesce("text_hash", "__hash").alias("text_hash"),
        "whole",
        "ranges",
    )
    found = stored(both, "repeats")
    released(docs.sparkSession)
    return scanned.select("doc_id", "text_hash", "n_bytes", "sha256"), found


def repeat_removal(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs`` (doc_id, text).

    Every byte of a ``length``-byte string that also starts elsewhere, in this or another document, counts as removed; null
    texts are empty. Repeated rows hold each other's strings. An empty table gives an empty one. ``length`` is at least 8.
    """
    every, found = repeats(docs, length)
    joined = _joined(docs, found, once=True).select("doc_id", "text_hash", "text", "whole", "ranges")
    kind = joined.schema["doc_id"].dataType.simpleString()

    def removed(batch: pa.RecordBatch) -> pa.RecordBatch:
        lost, spans, digests = [], [], []
        for text, whole, ranges in zip(*(column.to_pylist() for column in batch.columns[2:])):
            data = text.encode()
            runs = _removed(data, length, whole or [], [(r["first"], r["last"]) for r in ranges or []])
            kept, at = hashlib.sha256(), 0
            for start, stop in runs:
                kept.update(data[at:start])
                at = stop
            kept.update(data[at:])
            lost.append(sum(stop - start for start, stop in runs))
            spans.append(len(runs))
            digests.append(kept.digest())
        columns = [pa.array(lost, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.binary())]
        names = ["__doc_id", "__hash", "lost", "spans", "kept"]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=names)

    changed = map_slices(joined, removed, f"__doc_id {kind}, __hash long, lost long, spans long, kept binary")
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_hash") == F.col("__hash"))
    return every.join(changed, same, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("lost", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.lower(F.hex(F.coalesce("kept", "sha256"))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with all columns, repeated bytes cut from ``text``. Null texts stay null.

    A cut within a character leaves the rest of it invalid; such bytes are dropped.
    """
    _, found = repeats(docs, length)
    right = found.withColumnsRenamed({"doc_id": "__doc_id", "text_hash": "__text_hash", "whole": "__whole", "ranges": "__ranges"})
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__hash") == F.col("__text_hash"))
    joined = keyed.join(right, same, "left").drop("__doc_id", "__text_hash", "__hash")
    at = docs.columns.index("text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        lists = zip(batch.column("__whole").to_pylist(), batch.column("__ranges").to_pylist())
        for row, (whole, ranges) in enumerate(lists):
            if whole or ranges:
                data = texts[row].encode()
                kept, last = [], 0
                for start, stop in _removed(data, length, whole or [], [(r["first"], r["last"]) for r in ranges or []]):
                    kept.append(data[last:start])
                    last = stop
                texts[row] = b"".join([*kept, data[last:]]).decode(errors="ignore")
        columns = batch.columns[: len(docs_columns)]
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=docs_columns)

    docs_columns = docs.columns
    return map_slices(joined, cut, docs.schema)
