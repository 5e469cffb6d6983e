"""Near-duplicates by circulant MinHash, banding, and exact Jaccard similarity of whole shingle sets.

Two permutations give all coordinates of a signature: the first shuffles a document's shingles once, the second is applied to
their places shifted circularly by 0, 1, 2, ... (both are bijections of 32-bit numbers). Texts with equal shingle sets form
one class, and all later steps see a class once.

A bucket (equal band) of classes is never paired out. It compares its pivot with its other classes: the class that meets most
others, which in a group of edited copies is the least edited. Links join components. Of the classes that were compared with
one pivot but lie in different components, only those pairs are compared that can be linked at all: what two classes differ
by is the symmetric difference of what either differs from the pivot by, so linked classes share a known number of their
differences from the pivot, and then one of them lies in a prefix of both if differences are ordered rarest first. Classes
meet by such a difference, never by the pivot alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varlake.llm.components import components
from varlake.llm.shared import SLICE, map_slices, stored

#: At 40 bands of 5 rows a pair of similarity 0.8 shares no bucket once in 8 million times.
BANDS, ROWS = 40, 5
#: Elements of the (shift, shingle) matrix that is worked on at a time.
BLOCK = 1 << 20

_SHIFT, _U4 = np.uint32, np.uint32


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of all runs of ``width`` words; shorter texts are one run, empty ones none.

    Letters A-Z are lowered; words are ``[^\\x20\\x09-\\x0D]+``.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, "u8")
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))
    n = max(1, len(hashes) - width + 1)
    mixed = np.zeros(n, "u8")
    for at in range(min(width, len(hashes))):
        mixed = (mixed ^ hashes[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _permuted(places: np.ndarray, first: int, second: int) -> np.ndarray:
    """A bijection of 32-bit numbers: xor-shifts and odd multipliers. Works in place."""
    places ^= places >> _SHIFT(16)
    places *= _U4(first)
    places ^= places >> _SHIFT(15)
    places *= _U4(second)
    places ^= places >> _SHIFT(16)
    return places


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` coordinates of circulant MinHash."""
    places = _permuted((shingles ^ (shingles >> np.uint64(32))).astype("u4"), 0x7FEB352D, 0x846CA68B)
    out = np.full(n, 0xFFFFFFFF, "u4")
    step = max(1, BLOCK // n)
    shifts = np.arange(n, dtype="u4")[:, None]
    for at in range(0, len(places), step):
        block = _permuted(places[None, at : at + step] + shifts, 0x85EBCA6B, 0xC2B2AE35)
        np.minimum(out, block.min(axis=1), out=out)
    return out


def _keys(shingles: np.ndarray, bands: int, rows: int) -> list[int]:
    """A 64-bit key for each band of the signature; an empty set has none."""
    if not len(shingles):
        return []
    parts = signature(shingles, bands * rows).reshape(bands, rows)
    return [xxhash.xxh64_intdigest(part.tobytes(), seed=band) - (1 << 63) for band, part in enumerate(parts)]


def sketched(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, bands): digest of the whole set, and a 64-bit key for each band."""

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, keys = [], [], []
        for text in batch.column(2).to_pylist():
            shingles = shingle_set(text, width)
            sizes.append(len(shingles))
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            keys.append(_keys(shingles, bands, rows))
        columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *columns], names=["doc_id", "text_hash", "n_shingles", "digest", "bands"]
        )

    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_slices(narrow, sketch, f"doc_id {kind}, text_hash long, n_shingles long, digest binary, bands array<long>")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    lefts = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    rights = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(rights, "b").join(lefts, "a").select("a", "b", "text_a", "text_b")


def _compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int, differences: bool) -> DataFrame:
    """(a, b, n, linked, differences) of pairs (a, b), from their whole sets.

    Linked is 100 * intersection >= percent * union; ``n`` is the size of b's set. ``differences`` are the shingles that one
    of the sets lacks, where asked for, else empty; those that only a has are turned round bit by bit.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_set = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sizes, linked, lists = [], [], []
                for a, left, right in zip(*(part.column(i).to_pylist() for i in (0, 2, 3))):
                    if a != known:
                        known, known_set = a, shingle_set(left, width)
                    other = shingle_set(right, width)
                    common = len(np.intersect1d(known_set, other, assume_unique=True))
                    sizes.append(len(other))
                    linked.append(100 * common >= percent * (len(known_set) + len(other) - common))
                    if differences:
                        lost = np.setdiff1d(known_set, other, assume_unique=True)
                        lists.append(np.concatenate([~lost, np.setdiff1d(other, known_set, assume_unique=True)]).view("i8"))
                    else:
                        lists.append([])
                columns = [pa.array(sizes, pa.int64()), pa.array(linked), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], names=["a", "b", "n", "linked", "differences"])

    return _with_texts(pairs, texts).mapInArrow(compare, "a long, b long, n long, linked boolean, differences array<long>")


def _starred(members: DataFrame) -> DataFrame:
    """(a, b): the pivot of each bucket with its other nodes, of ``members`` (bucket, node, meets)."""
    rank = F.struct(F.col("meets"), (-F.col("node")).alias("__minus"))
    pivots = members.groupBy("bucket").agg(F.max_by("node", rank).alias("pivot"))
    pairs = members.join(pivots, "bucket").where("node <> pivot")
    return pairs.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()


def _entries(compared: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(pivot, one, node, root, far, g, differ, place): what classes of pivots that join several components differ by.

    ``g`` is (100 + percent) * differ - (100 - percent) * n: two classes are linked only if they share at least
    (g_1 + g_2) / (2 * (100 + percent)) differences. ``place`` numbers a class's differences, rarest first; those of one class
    only are left out, as are places behind the longest prefix that any partner asks for. ``far`` says that the class lies in
    another component than its pivot.
    """
    pivot_roots = roots.select(F.col("node").alias("a"), F.col("root").alias("__pivot_root"))
    placed = _rooted(compared.withColumnRenamed("b", "node"), roots).join(pivot_roots, "a", "left")
    g = F.col("differ") * (100 + percent) - F.col("n") * (100 - percent)
    members = (
        placed.withColumn("far", F.col("root") != F.coalesce("__pivot_root", "a"))
        .withColumn("differ", F.size("differences"))
        .withColumn("g", g)
        .select(F.col("a").alias("pivot"), "node", "root", "far", "g", "differ", "differences")
    )
    least = members.groupBy("pivot").agg(F.min("g").alias("least"), F.min(F.when(F.col("far"), F.col("g"))).alias("least_far"))
    members = stored(members.join(least.where("least_far is not null"), "pivot"), "members")
    rows = members.withColumn("one", F.explode("differences")).drop("differences")
    often = rows.groupBy("pivot", "one").agg(F.count("*").alias("often"), F.max("far").alias("__far"))
    rows = rows.join(often.withColumnsRenamed({"pivot": "__pivot", "one": "__one"}), (F.col("pivot") == F.col("__pivot")) & (F.col("one") == F.col("__one")))
    place = F.row_number().over(Window.partitionBy("pivot", "node").orderBy("often", "one"))
    least_shared = _shared_at_least(F.col("g"), F.when(F.col("far"), F.col("least")).otherwise(F.col("least_far")), percent)
    rows = rows.withColumn("place", place).where((F.col("often") > 1) & F.col("__far") & (F.col("place") <= F.col("differ") - least_shared + 1))
    return rows.select("pivot", "one", "node", "root", "far", "g", "differ", "place")


def _shared_at_least(g_1: Column, g_2: Column, percent: int) -> Column:
    return F.greatest(F.lit(1), F.ceil((g_1 + g_2) / (2 * (100 + percent))))


def _possible_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes of different components, compared with one pivot, that share a difference in both their prefixes."""
    names = ["node", "root", "g", "differ", "place"]
    ones = entries.where("far").select("pivot", "one", *[F.col(c).alias(f"{c}_1") for c in names])
    twos = entries.select("pivot", "one", *[F.col(c).alias(f"{c}_2") for c in [*names, "far"]])
    shared = _shared_at_least(F.col("g_1"), F.col("g_2"), percent)
    within = (F.col("place_1") <= F.col("differ_1") - shared + 1) & (F.col("place_2") <= F.col("differ_2") - shared + 1)
    once = ~F.col("far_2") | (F.col("node_1") < F.col("node_2"))
    wanted = (ones["pivot"] == twos["pivot"]) & (ones["one"] == twos["one"]) & (F.col("root_1") != F.col("root_2")) & once & within
    pairs = ones.join(twos, wanted)
    return pairs.select(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text).

    Documents with 100 * intersection >= percent * union of their shingle sets are linked; component_id is the smallest
    doc_id that links reach (nulls are passed over, null if there are only nulls), kept says whether that is the row's own.
    Texts without words, and nulls, have no shingles and no links: each is kept as its own component. Rows that repeat the
    smallest doc_id are all kept. An empty table gives an empty one.
    """
    sketches = stored(sketched(docs, width, bands, rows), "sketches")
    filled = sketches.where("n_shingles > 0")
    classes = stored(
        filled.dropDuplicates(["digest"]).withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    keyed = classes.select("node", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("__low"), F.max("node").alias("__high"), F.count("*").alias("size"))
    # A row for each class and bucket that it shares with another class.
    # The counts are stored, so that the join shuffles both sides for itself and a hot bucket's rows can be split.
    shared = stored(shared.where("__low <> __high").select("bucket", "size"), "shared")
    left = stored(keyed.join(shared, "bucket"), "buckets")
    meets = left.groupBy("node").agg(F.sum("size").alias("meets"))
    left = stored(left.select("bucket", "node").join(meets, "node"), "ranked")
    wanted = meets.select("node").join(classes.select("node", "doc_id", "text_hash", "n_shingles"), "node")
    wanted = wanted.select("node", F.col("n_shingles").alias("n"), F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__hash"))
    source = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_hash") == F.col("__hash"))
    texts = stored(source.join(wanted, same).select("node", "n", "text").dropDuplicates(["node"]), "texts")

    compared = stored(_compared(_starred(left), texts, width, percent, differences=True), "compared")
    links = compared.where("linked").select("a", "b")
    roots = stored(components(links), "roots")
    entries = stored(_entries(compared, roots, percent), "entries")
    more = stored(_compared(_possible_pairs(entries, percent), texts, width, percent, differences=False), "links")
    if not more.where("linked").isEmpty():
        roots = stored(components(links.unionByName(more.where("linked").select("a", "b"))), "roots")

    smallest = filled.groupBy("digest").agg(F.min("doc_id").alias("least"))
    placed = classes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    by_class = stored(placed.join(smallest, "digest"), "class-roots")
    by_root = by_class.groupBy("root").agg(F.min("least").alias("component_id"))
    member = by_class.select("digest", "root").join(by_root, "root").select("digest", "component_id")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        sketches.select("doc_id", "text_hash", "n_shingles", "digest")
        .join(member, "digest", "left")
        .select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def one_of_each(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, each repeated row (doc_id, text) once, with all columns."""
    kept = decided.where("kept").select(
        F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__hash"), (F.col("n_shingles") > 0).alias("__filled")
    ).distinct()
    keyed = docs.withColumn("__text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__text_hash") == F.col("__hash"))
    place = F.row_number().over(Window.partitionBy("doc_id", "__text_hash").orderBy(F.lit(0)))
    return keyed.join(kept, same).withColumn("__place", place).where("not __filled or __place = 1").select(*docs.columns)
