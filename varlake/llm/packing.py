"""Best-fit-decreasing packing of token sequences.

Best fit only looks at lengths, and there are at most ``capacity`` different ones. So the packing runs over the histogram
of all lengths, placing all pieces of one length at a time, and gives exactly the bins that placing the pieces one by one
would. A segment tree over remaining capacities finds the tightest open bins in logarithmic time. The plan says which bins
the first, second, ... piece of a length go to; numbering the pieces of a length is left to Spark, in hashed buckets.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varlake.llm.shared import extended, map_slices, stored
from varlake.llm.tokens import encoder

#: Pieces of one length that are numbered in one group.
GROUP = 50_000


class OpenBins:
    """Intervals of bin numbers by remaining capacity; a segment tree knows which capacities have any."""

    def __init__(self, capacity: int) -> None:
        self._leaves = 1 << capacity.bit_length()
        self._tree = [False] * (2 * self._leaves)
        self._bins: dict[int, list[tuple[int, int]]] = {}

    def put(self, remaining: int, first: int, count: int) -> None:
        """Full bins (nothing remaining) and empty intervals are not kept."""
        if remaining and count:
            self._bins.setdefault(remaining, []).append((first, count))
            self._mark(remaining, True)

    def take(self, length: int) -> tuple[int, int, int] | None:
        """Removes and returns (remaining, first bin, number of bins) of the tightest bins that ``length`` fits."""
        remaining = self._tightest(length)
        if remaining is None:
            return None
        first, count = self._bins[remaining].pop()
        if not self._bins[remaining]:
            self._mark(remaining, False)
        return remaining, first, count

    def _mark(self, remaining: int, present: bool) -> None:
        at = self._leaves + remaining
        self._tree[at] = present
        while at > 1:
            at //= 2
            self._tree[at] = self._tree[2 * at] or self._tree[2 * at + 1]

    def _tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` that has bins."""
        at = self._leaves + length
        if not self._tree[at]:
            while at > 1 and (at % 2 or not self._tree[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self._leaves:
                at = 2 * at if self._tree[2 * at] else 2 * at + 1
        return at - self._leaves


Run = tuple[int, int, int, int]


def best_fit_plan(histogram: Iterable[tuple[int, int]], capacity: int) -> dict[int, list[Run]]:
    """Per length the runs (first number, first bin, offset, pieces per bin) of its pieces, in order of their numbers.

    Piece ``first + j`` of a run lies in bin ``first bin + j // per bin`` at ``offset + (j % per bin) * length``. Within a
    bin the pieces follow each other without gaps.
    """
    open_bins, plan, n_bins = OpenBins(capacity), {}, 0
    for length, left in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        runs: list[Run] = []
        done = 0
        while done < left:
            found = open_bins.take(length)
            if found is None:
                per_bin = capacity // length
                found = capacity, n_bins, -((done - left) // per_bin)
                n_bins += found[2]
            remaining, first, count = found
            per_bin = remaining // length
            runs.append((done, first, capacity - remaining, per_bin))
            placed = min(left - done, per_bin * count)
            full, partly = divmod(placed, per_bin)
            open_bins.put(remaining - per_bin * length, first, full)
            if partly:
                open_bins.put(remaining - partly * length, first + full, 1)
            untouched = first + full + bool(partly)
            open_bins.put(remaining, untouched, first + count - untouched)
            done += placed
        plan[length] = runs
    return plan


def numbered(pieces: DataFrame, order: list[str], length: str = "length") -> DataFrame:
    """Adds ``number``, 0, 1, ... within each length. A length that holds most rows is split over hashed buckets."""
    groups = max(1, pieces.count() // GROUP)
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    keys = [length, "__bucket"]
    before = Window.partitionBy(length).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*keys)
        .agg(F.count("*").alias("__n"))
        .select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        dealt.withColumn("__place", place)
        .join(starts, keys)
        .withColumn("number", F.col("__before") + F.col("__place") - 1)
        .drop("__bucket", "__place", "__before")
    )


def pack_best_fit(pieces: DataFrame, order: list[str], capacity: int = 1024, length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset``: bins of ``capacity`` filled best-fit decreasing.

    ``pieces`` is read three times (store it first); ``length`` must be 1 to ``capacity``, or an error is raised. Pieces
    that agree in all columns of ``order`` are interchangeable. An empty table gives an empty one.
    """
    histogram = [tuple(row) for row in pieces.groupBy(length).agg(F.count("*")).collect()]
    plan = {
        size: tuple(np.array(column, "i8") for column in zip(*runs)) for size, runs in best_fit_plan(histogram, capacity).items()
    }
    ranked = numbered(pieces, order, length)
    schema = extended(ranked.drop("number").schema, sequence_id="long", offset="long")
    names = schema.names

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = batch.column(length).to_numpy(zero_copy_only=False).astype("i8")
        numbers = batch.column("number").to_numpy(zero_copy_only=False).astype("i8")
        bins, offsets = np.empty_like(sizes), np.empty_like(sizes)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            first, first_bin, offset, per_bin = plan[int(size)]
            run = np.searchsorted(first, numbers[rows], "right") - 1
            place_in_run = numbers[rows] - first[run]
            bins[rows] = first_bin[run] + place_in_run // per_bin[run]
            offsets[rows] = offset[run] + place_in_run % per_bin[run] * size
        columns = [batch.column(name) for name in names[:-2]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(bins), pa.array(offsets)], names=names)

    def run(batches):
        yield from map(place, batches)

    return ranked.mapInArrow(run, schema)


def token_pieces(
    docs: DataFrame, vocabulary: str, end_id: int | None, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids): the token ids of every text, cut into pieces of ``capacity`` if longer.

    ``ids`` are little-endian unsigned 32-bit. A remainder comes first, so that all later pieces fill a sequence. Null texts
    are empty; with an ``end_id`` each text has at least that id, without one empty texts give no row.
    """
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(vocabulary).encoded
        rows: list[int] = []
        numbers, starts, lengths, parts = [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            ids = encode(text) + end
            n = len(ids) // 4
            bounds = [0, *range(n % capacity, n + 1, capacity)] if n % capacity else list(range(0, n + 1, capacity))
            for number, (start, stop) in enumerate(zip(bounds, bounds[1:])):
                rows.append(row)
                numbers.append(number)
                starts.append(start)
                lengths.append(stop - start)
                parts.append(ids[4 * start : 4 * stop])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(numbers, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(parts, pa.binary()),
            ],
            names=["doc_id", "piece", "start", "length", "ids"],
        )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(narrow, cut, "doc_id long, piece int, start long, length long, ids binary")


def packed_documents(docs: DataFrame, vocabulary: str, end_id: int | None = 2, capacity: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(token store, placement): the pieces with their ids as a stored table, and where each piece lies.

    The placement has doc_id, piece, start, length, ids_crc32, sequence_id and offset. Rows with a null or repeated doc_id
    are packed like any other; rows equal in doc_id and text are interchangeable.
    """
    pieces = stored(token_pieces(docs, vocabulary, end_id, capacity), "pieces")
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pieces, pack_best_fit(narrow, ["doc_id", "piece", "start", "ids_crc32"], capacity)


def sequences(pieces: DataFrame, placement: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, for distinct doc_ids that are not null."""
    keys = ["doc_id", "piece"]
    joined = placement.select(*keys, "sequence_id", "offset").join(pieces.select(*keys, "ids"), keys)
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    ids = F.unhex(F.array_join(F.transform(parts, lambda part: part["ids"]), ""))
    return joined.groupBy("sequence_id").agg(ids.alias("ids")).select(
        "sequence_id", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids"
    )
