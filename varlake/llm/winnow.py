"""Document fingerprints by winnowing, in DataFrame expressions only.

The k-grams are of UTF-8 bytes. Of every WINDOW consecutive k-gram hashes the smallest is chosen, of equal ones the rightmost,
and kept with its place: two texts that share GRAM + WINDOW - 1 bytes share a fingerprint, and what they share of under
GRAM bytes is never found.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varlake.functions._columns import bind, with_computed

#: Bytes of a k-gram, hashes of a window (a power of two).
GRAM, WINDOW = 20, 16
#: A chosen hash and its place share a long: the high 35 bits are the hash, the low 28 count the place from the end on, so
#: that the smallest of equal hashes is the rightmost.
PLACE_BITS = 28
HASH_MASK, PLACE_MASK = (1 << 35) - 1, (1 << PLACE_BITS) - 1
#: Documents that are put in order in one group, about, and groups at most: larger tables have larger groups.
GROUP, GROUPS = 1_024, 10_000


def winnowed(data: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<long> of the chosen (hash, place) of a text's UTF-8 bytes, each once, by place.

    A text of under ``gram`` bytes is one k-gram, one of few k-grams one window; an empty text has no fingerprint.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")

    def packed(data: Column) -> Column:
        def one(place: Column) -> Column:
            hashed = F.xxhash64(F.substring(data, place, F.lit(gram))).bitwiseAND(F.lit(HASH_MASK))
            return F.shiftleft(hashed, PLACE_BITS) + (F.lit(PLACE_MASK) - place)

        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(data) - F.lit(gram - 1), F.lit(1))), one)

    def doubled(span: int) -> Callable[[Column], Column]:
        """Minima over twice as many: each entry with that ``span`` further on, if there is one."""
        return lambda a: F.zip_with(a, F.slice(a, F.lit(span + 1), F.size(a)), lambda x, y: F.least(x, y))

    def least(hashes: Column) -> Column:
        found = hashes
        span = 1
        while span < window:
            found = bind(found, doubled(span))
            span *= 2
        # Windows that reach over the end are left out, unless there is no other.
        full = F.greatest(F.size(hashes) - F.lit(window - 1), F.lit(1))
        return F.array_distinct(F.slice(found, F.lit(1), full))

    longer = F.raise_error(F.lit(f"a text of over {PLACE_MASK - 1} bytes has places that do not fit")).cast("array<long>")
    return (
        F.when(F.length(data) == 0, F.array().cast("array<long>"))
        .when(F.length(data) >= PLACE_MASK, longer)
        .otherwise(bind(data, lambda d: bind(packed(d), least)))
    )


def ranges_of(docs: DataFrame, group: int = GROUP) -> Column:
    """Number of the range of doc_id that a row lies in, from 0; -1 for null.

    Bounds are quantiles, so ranges hold about as many rows each however the ids are spread; equal ids share a range.
    """
    n = docs.count()
    wanted = max(1, min(GROUPS, n // group))
    shares = [at / wanted for at in range(1, wanted)]
    found = docs.where("doc_id is not null").approxQuantile("doc_id", shares, 1 / (4 * wanted)) if shares else []
    cuts = sorted({int(cut) for cut in found})
    if not cuts:
        return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")
    # Two steps of about the square root of the number of cuts each.
    step = math.isqrt(len(cuts)) + 1

    def listed(numbers: list[int]) -> str:
        return "array(" + ", ".join(f"{number}L" if number > -(1 << 63) else "-9223372036854775807L" for number in numbers) + ")"

    first = F.expr(f"size(filter({listed(cuts[::step])}, cut -> cut <= doc_id))")
    passed = F.greatest(first - 1, F.lit(0)) * step
    second = F.size(F.filter(F.slice(F.expr(listed(cuts)), passed + 1, F.lit(step)), lambda cut: cut <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(passed + second).cast("long")


def rewinnowed(fingerprint: Column, kept: Column, data: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """``winnowed(data)``, from the fingerprint of other bytes that share their first ``kept`` bytes with ``data``.

    Whether a k-gram is chosen is up to the windows that hold it. Where these lie in the shared bytes, the choice stays;
    from the first place where one does not, all windows that hold a k-gram are looked at again.
    """

    def from_place(first: Column) -> Column:
        start = F.greatest(first - F.lit(window - 1), F.lit(0))
        before = F.filter(fingerprint, lambda one: one.bitwiseAND(F.lit(PLACE_MASK)) > F.lit(PLACE_MASK - 1) - first)

        def joined(tail: Column) -> Column:
            later = F.filter(tail, lambda one: one.bitwiseAND(F.lit(PLACE_MASK)) - start <= F.lit(PLACE_MASK - 1) - first)
            return F.concat(before, F.transform(later, lambda one: one - start))

        return bind(winnowed(F.substring(data, start + 1, F.length(data)), gram, window), joined)

    return bind(F.greatest(kept - F.lit(gram + window - 2), F.lit(0)), from_place)


def hashes(fingerprint: Column) -> Column:
    return F.transform(fingerprint, lambda one: F.shiftright(one, PLACE_BITS))


def places(fingerprint: Column) -> Column:
    """Byte offsets, from 0."""
    return F.transform(fingerprint, lambda one: F.lit(PLACE_MASK - 1) - one.bitwiseAND(F.lit(PLACE_MASK)))


def spelled(fingerprint: Column) -> Column:
    """The fingerprint as text: its entries in hexadecimal, by place."""
    return F.array_join(F.transform(fingerprint, F.hex), " ")


def likeness(one: Column, other: Column) -> Column:
    """Share of common hashes among all of two fingerprints; 1 if both are empty."""

    def jaccard(a: Column, b: Column) -> Column:
        every = F.size(F.array_union(a, b))
        return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)

    return bind(hashes(one), lambda a: bind(hashes(other), lambda b: jaccard(a, b)))


def with_next(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint): the next is that of the next larger doc_id, then the first.

    Null texts are empty, null doc_ids come first, equal ones in the order of their texts; a lone row follows itself. Rows
    are dealt into ranges of doc_id and sorted there, with one shuffle of the texts; the first of each range follows the
    last of the one before. In one place only go the numbers of the ranges.
    """
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), ranges_of(docs, group).alias("range"))
    dealt = narrow.repartition("range")
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    follow = (
        dealt.withColumn("fingerprint", winnowed(F.encode("text", "utf-8")))
        .withColumn("after", F.lead(F.struct("text", "fingerprint")).over(order))
    )
    firsts = dealt.withColumn("__at", F.row_number().over(order)).where("__at = 1").select("range", "text")
    # One row per range: a few for each ten thousand documents.
    every = Window.orderBy("range")
    last = F.max("range").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = narrow.groupBy("range").agg(F.count("*")).select("range", F.coalesce(F.lag("range").over(every), last).alias("before"))
    heads = firsts.join(before, "range").select(
        F.col("before").alias("range"), F.struct("text", winnowed(F.encode("text", "utf-8")).alias("fingerprint")).alias("head")
    )
    after = F.coalesce("after", "head")
    return follow.join(heads, "range").select(
        "doc_id", "text", "fingerprint", after["text"].alias("next_text"), after["fingerprint"].alias("next_fingerprint")
    )


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of ``docs``.

    The edited text has its last quarter (rounded down) replaced by as many first characters of the next document's, or all.
    """
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    kept = F.encode(F.substring("text", F.lit(1), n - quarter), "utf-8")
    taken = F.encode(F.substring("next_text", F.lit(1), quarter), "utf-8")
    bytes_ = bind(kept, lambda k: F.struct(F.length(k).alias("kept"), F.concat(k, taken).alias("data")))
    edited = with_computed(with_next(docs).withColumnRenamed("fingerprint", "__own"), "edited", bytes_)
    again = rewinnowed(F.col("__own"), F.col("edited.kept"), F.col("edited.data"))
    both = with_computed(edited, "__edited", again)
    return both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited.data", 256).alias("edited_sha256"),
        spelled(F.col("__own")).alias("fingerprint"),
        spelled(F.col("__edited")).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__edited")).alias("near_edited"),
        likeness(F.col("__own"), F.col("next_fingerprint")).alias("near_next"),
    )
