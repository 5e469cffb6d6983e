"""Splitting multi-allelic sites and normalising alleles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlake._shared import ensure_checkpoint_dir
from varlake.functions._columns import bind, with_computed
from varlake.sources.fasta import CHUNK, IndexedContig, IndexedReference, index_bytes, unique_index

#: Bases left of an event that are looked at first, and at most at a time.
NEAREST, WIDEST = 64, 1 << 20
#: Chunks that are looked at together where the nearest one does not end a repeat.
FIRST_ROUND = 8
#: Bytes of indexes, some 30,000 contigs, up to which every task holds them.
SMALL_INDEX = 1 << 20

# --- splitting -----------------------------------------------------------------------------------------------------


def _split_info(df: DataFrame, position: Column, n_alts: Column) -> dict[str, Column]:
    """What becomes of INFO arrays. The header's Number decides where it is known, else the length does.

    ``A``: the row's allele; ``R``: the reference and the row's allele; ``G``: as likelihoods; other numbers and ``.``: as
    they are. Lists that are not as long as their Number says become null.
    """
    allele, n_alleles = position + 1, n_alts + 1
    out = {}
    for field in df.schema.fields:
        if not (field.name.startswith("INFO_") and isinstance(field.dataType, T.ArrayType)):
            continue
        value, number = F.col(field.name), field.metadata.get("number")
        own = F.when(F.size(value) == n_alts, F.array(F.get(value, position)))
        if number == "A":
            out[field.name] = own
        elif number == "R":
            out[field.name] = F.when(F.size(value) == n_alleles, F.array(F.get(value, F.lit(0)), F.get(value, allele)))
        elif number == "G":
            out[field.name] = _split_likelihoods(value, allele, n_alleles)
        elif number is None:
            out[field.name] = F.when(F.size(value) == n_alts, F.array(F.get(value, position))).otherwise(value)
    return out


def _split_likelihoods(value: Column, allele: Column, n_alleles: Column) -> Column:
    """Likelihoods of diploid or haploid genotypes of the reference and one allele; of any other ploidy null."""
    # Index of a diploid genotype (j, k), j <= k, in the likelihood list is k(k+1)/2 + j.
    own_row = (allele * (allele + 1) / 2).cast("int")
    n_diploid = (n_alleles * (n_alleles + 1) / 2).cast("int")
    diploid = F.array(*[F.get(value, i) for i in (F.lit(0), own_row, own_row + allele)])
    haploid = F.array(F.get(value, F.lit(0)), F.get(value, allele))
    return F.when(F.size(value) == n_diploid, diploid).when(F.size(value) == n_alleles, haploid)


#: The Number of genotype fields that the format itself defines, where no header says it.
_NUMBERS = {"alleleDepths": "R", "phredLikelihoods": "G", "genotypeLikelihoods": "G", "posteriorProbabilities": "G", "expectedAlleleCounts": "A"}


def _split_genotype(genotype: Column, genotypes: T.StructField, position: Column, n_alts: Column) -> Column:
    """Calls recoded for the row's allele, per-allele fields cut to it by their Number; lists of another length become null."""
    allele = position + 1
    n_alleles = n_alts + 1
    numbers = _NUMBERS | genotypes.metadata.get("numbers", {})
    fields = []
    for field in genotypes.dataType.elementType.fields:
        value = genotype.getField(field.name)
        number = numbers.get(field.name) if isinstance(field.dataType, T.ArrayType) else None
        if field.name == "calls":
            # 0 stays, the row's allele becomes 1; what was called as another allele is unknown here.
            value = F.transform(
                value, lambda c: F.when(c == allele, F.lit(1)).when(c == 0, F.lit(0)).otherwise(F.lit(-1))
            )
        elif number == "A":
            value = F.when(F.size(value) == n_alts, F.array(F.get(value, position)))
        elif number == "R":
            value = F.when(F.size(value) == n_alleles, F.array(F.get(value, F.lit(0)), F.get(value, allele)))
        elif number == "G":
            value = _split_likelihoods(value, allele, n_alleles)
        fields.append(value.alias(field.name))
    return F.struct(*fields)


def split_multiallelics(df: DataFrame) -> DataFrame:
    """One row per alternate allele, with ``splitFromMultiAllelic`` telling which rows were split.

    Calls are recoded for the row's allele; INFO and genotype lists with a value per allele or per genotype, by the declared
    Number where it is known, are cut to it. Rows without alternate alleles are kept as they are. Row-local: no shuffle.
    """
    # A column of its own: in one select, `alternateAlleles` inside a lambda would mean the new, one-element array.
    numbered = df.select("*", F.posexplode_outer("alternateAlleles").alias("__pos", "__alt")).withColumn(
        "__n_alts", F.size("alternateAlleles")
    )
    n_alts = F.col("__n_alts")
    changed = _split_info(df, F.col("__pos"), n_alts)
    if "genotypes" in df.columns:
        dtype = df.schema["genotypes"].dataType.elementType
        if "calls" in dtype.fieldNames():
            changed["genotypes"] = F.transform(
                "genotypes", lambda g: _split_genotype(g, df.schema["genotypes"], F.col("__pos"), n_alts)
            )
    multi = F.coalesce(n_alts > 1, F.lit(False))
    columns = []
    for name in df.columns:
        if name == "alternateAlleles":
            columns.append(F.when(F.col("__alt").isNotNull(), F.array("__alt")).otherwise(F.col(name)).alias(name))
        elif name in changed:
            columns.append(F.when(multi, changed[name]).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return numbered.select(*columns, multi.alias("splitFromMultiAllelic"))


# --- normalising ---------------------------------------------------------------------------------------------------
#
# An allele pair is first trimmed at its common end. If both alleles then still have bases, the common beginning is
# trimmed too and nothing can move. Otherwise it is a pure insertion or deletion of a sequence S, which can be moved
# left as long as the base before it equals the last base of S, S being rotated by each step. After i steps the last
# base of the rotated S is S[m-1-(i mod m)], m = length of S, so the number of steps is the first i at which the
# context base i+1 to the left of S differs from it: a closed form, no loop over steps.


def _first_true(flags: Column) -> Column:
    """0-based index of the first true element, null if there is none."""
    return F.nullif(F.array_position(flags, F.lit(True)), F.lit(0)) - 1


def _common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    differs = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(_first_true(differs), n).cast("int")


def _trimmed(ref: Column, alt: Column) -> Column:
    """Struct ``ref, alt, skipped`` (bases cut off the left), ``seq`` (S of a pure indel, else null) and ``next``.

    One expression with bound intermediate values, so that filtering on it does not repeat its parts.
    """

    def cut_right(suffix: Column) -> Column:
        return F.struct(
            F.substring(ref, F.lit(1), F.length(ref) - suffix).alias("r"),
            F.substring(alt, F.lit(1), F.length(alt) - suffix).alias("a"),
            # First base behind the event; the anchor of last resort at a contig's very beginning.
            F.substring(ref, F.length(ref) - suffix + 1, F.lit(1)).alias("next"),
        )

    def cut_left(cut: Column) -> Column:
        r, a = cut["r"], cut["a"]
        pure = (F.length(r) == 0) | (F.length(a) == 0)
        common = F.when(pure, F.lit(0)).otherwise(
            F.least(_common_prefix(r, a), F.least(F.length(r), F.length(a)) - 1)
        )

        def result(prefix: Column) -> Column:
            return F.struct(
                F.substring(r, prefix + 1, F.length(r)).alias("ref"),
                F.substring(a, prefix + 1, F.length(a)).alias("alt"),
                prefix.alias("skipped"),
                F.when(pure, F.concat(r, a)).alias("seq"),
                cut["next"].alias("next"),
            )

        return bind(common, result)

    return bind(bind(_common_prefix(F.reverse(ref), F.reverse(alt)), cut_right), cut_left)


def minimal_alleles(ref: Column, alt: Column) -> Column:
    """Struct ``ref, alt, skipped``: both alleles without the bases they have in common at the end, then at the beginning."""

    def cut_right(suffix: Column) -> Column:
        return F.struct(
            F.substring(ref, F.lit(1), F.length(ref) - suffix).alias("r"),
            F.substring(alt, F.lit(1), F.length(alt) - suffix).alias("a"),
        )

    def cut_left(cut: Column) -> Column:
        def result(prefix: Column) -> Column:
            return F.struct(
                F.substring(cut["r"], prefix + 1, F.length(cut["r"])).alias("ref"),
                F.substring(cut["a"], prefix + 1, F.length(cut["a"])).alias("alt"),
                prefix.alias("skipped"),
            )

        shortest = F.least(F.length(cut["r"]), F.length(cut["a"]))
        return bind(F.when(shortest == 0, F.lit(0)).otherwise(_common_prefix(cut["r"], cut["a"])), result)

    return bind(bind(_common_prefix(F.reverse(ref), F.reverse(alt)), cut_right), cut_left)


def _last_difference(a: str, b: str) -> int:
    """Last place at which two different texts of one length differ."""
    one, two = (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") for text in (a, b))
    return int(np.flatnonzero(one != two)[-1])


def _expected(seq: str, offset: int, n: int) -> str:
    """The ``n`` bases that a rotation of ``seq`` needs to its left after ``offset`` steps."""
    turn = -(offset + n) % len(seq)
    return (seq[turn:] + seq * (n // len(seq) + 1))[:n]


def _first_mismatch(seq: str | None, bases: str | None, n: int | None, offset: int | None) -> int | None:
    if not seq or bases is None or n is None or offset is None or n <= 0:
        return None
    if n > len(bases):
        # Bases that the chunk does not have differ.
        return offset
    context, expected = bases[:n], _expected(seq, offset, n)
    return None if context == expected else offset + n - 1 - _last_difference(context, expected)


def _rotation_mismatch(seq: Column, bases: Column, bases_start: Column, right: Column, offset: Column) -> Column:
    """First step ``i >= offset`` at which the context differs, looking at bases ``[bases_start, right)`` only.

    ``right`` is the position right of the nearest context base, which belongs to step ``offset``. Null: no mismatch.
    """

    @F.arrow_udf("long")
    def found(seqs: pa.Array, texts: pa.Array, ns: pa.Array, offsets: pa.Array) -> pa.Array:
        rows = zip(seqs.to_pylist(), texts.to_pylist(), ns.to_pylist(), offsets.to_pylist())
        return pa.array([_first_mismatch(*row) for row in rows], pa.int64())

    return found(seq, bases, (right - bases_start).cast("long"), offset.cast("long"))


def _moved(df: DataFrame) -> DataFrame:
    """Apply ``__shift`` and ``__anchor`` (null: the contig begins right there) to the pure indels."""
    seq, shift = F.col("__seq"), F.col("__shift").cast("int")
    turn = F.pmod(shift, F.length(seq))
    rotated = F.concat(
        F.substring(seq, F.length(seq) - turn + 1, F.length(seq)), F.substring(seq, F.lit(1), F.length(seq) - turn)
    )
    with_seq = df.withColumn("__rotated", rotated)
    rotated = F.col("__rotated")
    deletion = F.length("__ref") > 0
    left_anchor = F.col("__anchor")
    right_anchor = F.when(shift > 0, F.substring(rotated, 1, 1)).otherwise(F.col("__next"))
    long = F.when(left_anchor.isNotNull(), F.concat(left_anchor, rotated)).otherwise(F.concat(rotated, right_anchor))
    short = F.coalesce(left_anchor, right_anchor)
    return with_seq.withColumns(
        {
            "__start": F.when(left_anchor.isNotNull(), F.col("__start") - shift - 1).otherwise(F.lit(0).cast("long")),
            "__new_ref": F.when(deletion, long).otherwise(short),
            "__new_alt": F.when(deletion, short).otherwise(long),
        }
    ).drop("__rotated")


_KEY = ["contigName", "start", "referenceAllele", "__allele"]


def _look_left(indels: DataFrame, reference_bases: DataFrame, chunk: int) -> DataFrame:
    """Join each indel with the one chunk left of it; ``__shift`` is null where that chunk does not end the search."""
    nearest = F.floor((F.col("__start") - 1) / chunk)
    keyed = indels.withColumn("chunk_id", F.greatest(nearest, F.lit(0)).cast("long"))
    joined = keyed.join(reference_bases, ["contigName", "chunk_id"], "left")
    mismatch = _rotation_mismatch(
        F.col("__seq"), F.col("bases"), F.col("chunk_start"), F.col("__start"), F.lit(0)
    )
    at_contig_start = F.col("chunk_start") == 0
    looked = joined.withColumn("__mismatch", mismatch)
    shift = F.coalesce(F.col("__mismatch"), F.when(at_contig_start, F.col("__start")))
    anchor_index = F.col("__start") - F.col("__mismatch") - F.col("chunk_start")
    return looked.withColumns(
        {
            "__shift": shift.cast("long"),
            "__anchor": F.when(
                F.col("__mismatch").isNotNull(), F.substring("bases", anchor_index.cast("int"), F.lit(1))
            ),
            # Everything from here to the variant agrees with the rotation.
            "__seen_to": F.col("chunk_start"),
        }
    ).drop("__mismatch", "bases", "chunk_start", "chunk_id")


def _look_further(unresolved: DataFrame, reference_bases: DataFrame, chunk: int) -> list[DataFrame]:
    """Follow repeats beyond the first chunk; returns resolved rows ``(key, __shift, __anchor)`` per round.

    The first round compares FIRST_ROUND chunks, each later one eight times as many as the one before, every (variant, chunk)
    pair by itself, and merges the pairs by the rightmost mismatch: nothing is concatenated, and the work is proportional to
    the length of the repeat. Every round moves the reference once, so few rounds are better than few pairs. They end when no
    row is left, which is checked on checkpointed rows.
    """
    done = []
    width = FIRST_ROUND
    while not unresolved.isEmpty():
        last = F.floor((F.col("__seen_to") - 1) / chunk)
        first = F.greatest(last - (width - 1), F.lit(0))
        pieces = unresolved.withColumns({"__first": first, "chunk_id": F.explode(F.sequence(first, last))}).join(
            reference_bases, ["contigName", "chunk_id"], "left"
        )
        # A chunk also stores bases of the chunk before it, and its right part may already have been looked at.
        right = F.least(F.col("__seen_to"), F.col("chunk_start") + F.length("bases"))
        found = _rotation_mismatch(
            F.col("__seq"), F.col("bases"), F.col("chunk_start"), right, F.col("__start") - right
        )
        per_piece = pieces.withColumn("__mismatch", found)
        anchor = F.substring(
            "bases", (F.col("__start") - F.col("__mismatch") - F.col("chunk_start")).cast("int"), F.lit(1)
        )
        best = per_piece.groupBy(*_KEY, "__seq", "__start").agg(
            F.min(F.when(F.col("__mismatch").isNotNull(), F.struct(F.col("__mismatch"), anchor.alias("a")))).alias(
                "__best"
            ),
            F.min("chunk_start").alias("__seen_to"),
            # The first step that needs a chunk which is not there: what lies beyond must not be trusted.
            F.min(F.when(F.col("chunk_start").isNull(), F.col("__start") - (F.col("chunk_id") + 1) * chunk)).alias("__gap"),
        )
        near = F.coalesce(F.col("__best.__mismatch") < F.col("__gap"), F.col("__gap").isNull())
        reached = F.col("__gap").isNull() & (F.col("__seen_to") == 0)
        state = best.withColumns(
            {
                "__shift": F.coalesce(
                    F.when(near, F.col("__best.__mismatch")), F.when(reached, F.col("__start"))
                ).cast("long"),
                "__anchor": F.when(near, F.col("__best.a")),
            }
        ).drop("__best").checkpoint()
        done.append(state.filter(F.col("__shift").isNotNull()).select(*_KEY, "__shift", "__anchor"))
        unresolved = state.filter(F.col("__shift").isNull() & F.col("__gap").isNull()).drop("__shift", "__anchor", "__gap")
        width *= 8
    return done


def _left_of(reference: IndexedReference, known: IndexedContig | None, start: int, seq: str) -> tuple[int | None, str | None]:
    """How far ``seq``, which begins at ``start``, can move left, and the base where that ends (None: the contig's begin).

    Looks at ever larger pieces, so that the work is proportional to the repeat. (None, None): outside of the reference.
    """
    if known is None or not 0 <= start <= known.length:
        return None, None
    shift, width = 0, NEAREST
    while shift < start:
        context = reference.bases_of(known, max(0, start - shift - width), start - shift)
        n, expected = len(context), _expected(seq, shift, len(context))
        if context != expected:
            last = _last_difference(context, expected)
            return shift + n - 1 - last, context[last]
        shift, width = shift + n, min(16 * width, WIDEST)
    return start, None


def _found_array(found: list[tuple[int | None, str | None]]) -> pa.Array:
    columns = [pa.array([one[0] for one in found], pa.int64()), pa.array([one[1] for one in found], pa.string())]
    return pa.StructArray.from_arrays(columns, ["shift", "anchor"])


def _looked_up(indels: DataFrame, path: str | Sequence[str]) -> DataFrame:
    """``__shift`` and ``__anchor`` of each indel by reads of an indexed genome.

    A small index is held by the tasks: no join, and no shuffle of rows. A large one, of a genome of very many contigs, is read
    by tasks and merged with the rows; it passes through neither the driver nor any one task.
    """
    if index_bytes(path) <= SMALL_INDEX:
        reference = IndexedReference.of(path)

        @F.arrow_udf("shift long, anchor string")
        def left_of(contigs: pa.Array, starts: pa.Array, seqs: pa.Array) -> pa.Array:
            rows = zip(contigs.to_pylist(), starts.to_pylist(), seqs.to_pylist())
            return _found_array([_left_of(reference, reference.contigs.get(contig), *row) for contig, *row in rows])

        looked = indels.withColumn("__found", left_of("contigName", "__start", "__seq"))
    else:
        line = ["path", "length", "offset", "line_bases", "line_bytes"]
        index = unique_index(indels.sparkSession, path).select("contigName", *[F.col(c).alias(f"__{c}") for c in line])

        # Each task has its own copy, with the files that it opened.
        reference = IndexedReference({}, {})

        @F.arrow_udf("shift long, anchor string")
        def left_of_line(starts: pa.Array, seqs: pa.Array, *lines: pa.Array) -> pa.Array:
            rows = zip(starts.to_pylist(), seqs.to_pylist(), *[column.to_pylist() for column in lines])
            return _found_array(
                [_left_of(reference, IndexedContig(*row) if row[0] is not None else None, start, seq) for start, seq, *row in rows]
            )

        joined = indels.join(index.hint("merge"), "contigName", "left")
        looked = joined.withColumn("__found", left_of_line("__start", "__seq", *[f"__{c}" for c in line])).drop(
            *[f"__{c}" for c in line]
        )
    return looked.withColumns({"__shift": F.col("__found.shift"), "__anchor": F.col("__found.anchor")}).drop("__found")


def normalize_variants(
    df: DataFrame, reference_bases: DataFrame | str | Sequence[str], chunk: int = CHUNK, follow_long_repeats: bool = True
) -> DataFrame:
    """Parsimonious, left-aligned alleles for biallelic rows; adds ``normalized``: whether the row changed.

    ``reference_bases`` is a table of chunks, or the path of FASTA files with indexes. By index, each pure insertion or deletion
    reads the bases left of it, as far as its repeat goes: no join and no shuffle, the plan stays lazy, and the input is read
    twice. Only where the indexes are large (SMALL_INDEX) are these rows merged with their lines, after a check of the names. A
    table of chunks is joined on the chunk left of each such event, by an extra job over the coordinate and allele columns of
    the indels; repeats that reach beyond one chunk are followed to their end whatever the length. Everything else is trimmed in place. Rows whose outcome hangs on bases that the reference does not
    hold, however near or far, keep their input alleles and get ``normalized = null``; so does a row without exactly one
    plain alternate allele, and with ``follow_long_repeats=False`` one whose repeat reaches beyond a chunk.
    """
    allele = F.when(F.size("alternateAlleles") == 1, F.get("alternateAlleles", F.lit(0)))
    plain = allele.rlike("^[A-Za-z]+$") & F.col("referenceAllele").rlike("^[A-Za-z]+$")
    # Single bases have nothing to trim and equal alleles are no event: neither needs any string work.
    idle = ((F.length("referenceAllele") == 1) & (F.length("__allele") == 1)) | (
        F.col("referenceAllele") == F.col("__allele")
    )
    prepared = df.withColumn("__allele", F.when(plain, allele)).withColumn("__idle", F.coalesce(idle, F.lit(True)))
    trimmed = with_computed(
        prepared, "__trim", F.when(~F.col("__idle"), _trimmed(F.col("referenceAllele"), F.col("__allele")))
    )
    is_indel = F.coalesce(F.length("__trim.seq") > 0, F.lit(False))
    in_place = trimmed.filter(~is_indel).withColumns(
        {
            "__new_ref": F.when(F.col("__allele").isNotNull(), F.coalesce("__trim.ref", "referenceAllele")),
            "__new_alt": F.coalesce("__trim.alt", "__allele"),
            "__start": F.col("start") + F.coalesce("__trim.skipped", F.lit(0)),
        }
    )
    indels = trimmed.filter(is_indel).withColumns(
        {
            "__seq": F.col("__trim.seq"),
            "__next": F.col("__trim.next"),
            "__ref": F.col("__trim.ref"),
            "__start": F.col("start"),
        }
    ).drop("__trim")
    by_index = not isinstance(reference_bases, DataFrame)
    if by_index:
        looked = _looked_up(indels, reference_bases)
    elif not follow_long_repeats:
        looked = _look_left(indels, reference_bases, chunk)
    else:
        # Only coordinates and alleles meet the bases, once; whole rows meet what was found.
        ensure_checkpoint_dir(df.sparkSession)
        narrow = _look_left(indels.select(*_KEY, "__seq", "__start").distinct(), reference_bases, chunk).checkpoint()
        open_rows = narrow.filter(F.col("__shift").isNull() & F.col("__seen_to").isNotNull())
        rounds = _look_further(open_rows.select(*_KEY, "__seq", "__start", "__seen_to").distinct(), reference_bases, chunk)
        found = narrow.select(*_KEY, "__shift", "__anchor")
        if rounds:
            fixes = reduce(DataFrame.unionByName, rounds).withColumnsRenamed(
                {"__shift": "__far_shift", "__anchor": "__far_anchor"}
            )
            found = found.join(fixes, _KEY, "left").select(
                *_KEY,
                F.coalesce("__shift", "__far_shift").alias("__shift"),
                F.when(F.col("__shift").isNull(), F.col("__far_anchor")).otherwise(F.col("__anchor")).alias("__anchor"),
            )
        looked = indels.join(found, _KEY, "left")
    moved = _moved(looked)

    def finish(part: DataFrame) -> DataFrame:
        known = F.col("__new_ref").isNotNull() & F.col("__new_alt").isNotNull()
        changed = (F.col("__new_ref") != F.col("referenceAllele")) | (F.col("__new_alt") != F.col("__allele"))
        changed = changed | (F.col("__start") != F.col("start"))
        new = {
            "start": F.when(known, F.col("__start")).otherwise(F.col("start")),
            "end": F.when(known, F.col("__start") + F.length("__new_ref")).otherwise(F.col("end")),
            "referenceAllele": F.when(known, F.col("__new_ref")).otherwise(F.col("referenceAllele")),
            "alternateAlleles": F.when(known, F.array("__new_alt")).otherwise(F.col("alternateAlleles")),
        }
        return part.select(
            *[new[c].alias(c) if c in new else F.col(c) for c in df.columns],
            F.when(known, changed).alias("normalized"),
        )

    return finish(in_place).unionByName(finish(moved))


def split_and_normalize(df: DataFrame, reference_bases: DataFrame | str | Sequence[str], **options) -> DataFrame:
    """``split_multiallelics``, then ``normalize_variants``."""
    return normalize_variants(split_multiallelics(df), reference_bases, **options)
