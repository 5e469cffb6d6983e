"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken target / size times on average: a whole number of copies plus a fraction. The
fractions are rounded in pairs: mass (fraction times words) moves at random from one document to the other until one of them
has no fraction left, so that each document's expectation and the source's total mass stay as they are. Tasks do that for
hashed groups of a source; what each leaves, one document at most, meets those of 64 groups at the next level of a tree.

The tree's last document is drawn alone, and would put the total off by up to its own size. So documents above the source's
mean size go first, and what their last draw gained or lost is spread over the others before these are rounded: their common ratio
is shifted, within 0 and the cap, and split into a whole number and a fraction again. That last draw is free only where the
others can make up for either outcome; else it takes the one that they can, or that leaves less. An error of about a mean
document is left wherever the target can be met at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varlake.llm.shared import extended, n_words, stored

#: Documents that are rounded in one group, and groups whose rests meet at the next level.
GROUP = 20_000
FAN_IN = 64
#: Fractions this close to 0 or 1 count as such.
NEAR = 1e-12


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all sizes. A target stops at
    ``cap`` times its source's size; the excess is shared by weight among the others until none is above. That is the level
    at which the capped ones, taken in ascending order of cap per weight, leave no other above its cap.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    in_turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn(
        "__weight", F.element_at(F.array(*map(F.lit, weights)), (in_turn % len(weights) + 1).cast("int")).cast("double")
    ).withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    by_cap = Window.orderBy(F.col("__cap") / F.col("__weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    sharing = F.sum("__weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = weighed.withColumn("__level", left / sharing)
    fits = F.when(F.col("__cap") >= F.col("__weight") * F.col("__level"), F.col("__level"))
    first = F.first(fits, ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = leveled.withColumn("__first", first)
    target = F.when(F.col("__first").isNull(), F.col("__cap")).otherwise(
        F.least(F.col("__weight") * F.col("__first"), F.col("__cap"))
    )
    return level.select("source", "source_size", target.alias("target"))


def _paired(fractions: np.ndarray, masses: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int | None]:
    """Rounds in turn; returns the fractions, all 0 or 1 but for that at the returned index (None: all are whole)."""
    out, held = fractions.astype("f8"), None
    for at in range(len(out)):
        if out[at] <= NEAR or out[at] >= 1 - NEAR:
            out[at] = round(out[at])
            continue
        if held is None:
            held = at
            continue
        to_held = min((1 - out[held]) * masses[held], out[at] * masses[at])
        to_this = min(out[held] * masses[held], (1 - out[at]) * masses[at])
        moved = to_held if draws[at] * (to_held + to_this) < to_this else -to_this
        out[held] += moved / masses[held]
        out[at] -= moved / masses[at]
        rest = None
        for one in (held, at):
            if out[one] <= NEAR or out[one] >= 1 - NEAR:
                out[one] = round(out[one])
            else:
                rest = one
        held = rest
    return out, held


def _last_draw(table: pa.Table, held: int, fraction: float, draw: float, cap: float) -> bool:
    """Whether the last open document is taken: a free draw only if the source's target can be met either way.

    Pairing has kept the mass of the source's large documents, so the two possible totals are known here.
    """
    one = {name: table.column(name)[held].as_py() for name in ("mass", "target", "source_size", "large_mass")}
    expected = one["target"] / one["source_size"] * one["large_mass"]
    room = cap * (one["source_size"] - one["large_mass"])

    def missed(taken: int) -> float:
        left = one["target"] - expected - (taken - fraction) * one["mass"]
        return max(0.0, -left, left - room)

    without, with_it = missed(0), missed(1)
    return draw < fraction if without == with_it else with_it < without


def _rounding(seed: str, level: int, last: bool, cap: float | None) -> Callable[[pa.Table], pa.Table]:
    """Rounds a group; its open document, if any, keeps a null ``drawn``, but at the ``last`` level is drawn.

    With ``cap`` that draw minds what the source's other documents can make up for, see ``_last_draw``.
    """

    def rounded(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("size", "ascending")])
        source, group, n = table.column("source")[0].as_py(), table.column("group")[0].as_py(), table.num_rows
        digest = hashlib.blake2b(repr((seed, source, level, group)).encode(), digest_size=8).digest()
        draws = np.random.default_rng(int.from_bytes(digest, "little")).random((2, n))
        fractions, masses = table.column("fraction").to_numpy().copy(), table.column("mass").to_numpy()
        weightless = masses <= 0
        fractions[weightless] = draws[1][weightless] < fractions[weightless]
        fractions, held = _paired(fractions, masses, draws[0])
        is_open = np.zeros(n, bool)
        if held is not None and last:
            alone = draws[1][held] < fractions[held]
            fractions[held] = alone if cap is None else _last_draw(table, held, fractions[held], draws[1][held], cap)
        elif held is not None:
            is_open[held] = True
        drawn = pa.array(fractions.round().astype("i4"), mask=is_open)
        at = table.schema.get_field_index("fraction")
        return table.set_column(at, "fraction", pa.array(fractions)).append_column("drawn", drawn)

    return rounded


def pivotal(units: DataFrame, seed: str, name: str, cap: float | None = None) -> DataFrame:
    """Adds ``drawn`` (0 or 1) to units (source, doc_id, size, mass, fraction, group): the rounded fraction.

    Units of no mass are drawn alone. Rerunning gives the same draws. With ``cap`` the units are the large ones of their
    sources and have target, source_size and large_mass too.
    """
    out_schema = extended(units.schema, drawn="int")
    n_groups = (units.agg(F.max("group")).first()[0] or 0) + 1
    open_units, decided, level = units, [], 0
    while True:
        last = n_groups == 1
        step = _rounding(seed, level, last, cap)
        done = stored(open_units.groupBy("source", "group").applyInArrow(step, out_schema), f"{name}-{level}")
        decided.append(done.where("drawn is not null"))
        if last:
            break
        open_units = done.where("drawn is null").drop("drawn").withColumn("group", F.expr(f"cast(group div {FAN_IN} as int)"))
        n_groups = -(-n_groups // FAN_IN)
        level += 1
    all_decided = decided[0]
    for more in decided[1:]:
        all_decided = all_decided.unionByName(more)
    return all_decided


def _parted(units: DataFrame, ratio: Column) -> DataFrame:
    """Copies per document as a whole number and a fraction."""
    whole = F.floor(ratio).cast("int")
    return units.withColumn("whole", whole).withColumn("fraction", ratio - F.col("whole")).drop("__ratio", "__large")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, copies): how often the mix takes each document.

    ``size`` is the number of words (null text: 0). Rows that agree in doc_id, source and size are decided together; ``n``
    is their number. Copies are 0 to ``cap``. An empty table gives an empty result; sources without words have target 0 and
    their documents are not taken.
    """
    units = stored(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("n")),
        "mix-units",
    )
    mass = F.col("size") * F.col("n")
    totals = units.groupBy("source").agg(F.sum(mass).alias("source_size"), F.count("*").alias("units"))
    targets = stored(
        source_targets(totals.select("source", "source_size"), weights, share, cap).join(
            totals.select(F.col("source").alias("__source"), "units"), F.col("source").eqNullSafe(F.col("__source"))
        ).drop("__source"),
        "mix-targets",
    )
    known = targets.select(F.col("source").alias("__source"), "source_size", "target", "units")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    placed = (
        units.join(known, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("mass", mass.cast("double"))
        .withColumn("__ratio", ratio)
        .withColumn("group", F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("units") / GROUP)).cast("int"))
        .withColumn("__large", F.col("mass") * F.col("units") > F.col("source_size"))
        .drop("__source", "units")
    )
    large_mass = placed.where("__large").groupBy("source").agg(F.sum("mass").alias("large_mass"))
    large_mass = stored(large_mass.withColumnRenamed("source", "__source"), "mix-large-mass")
    same = F.col("source").eqNullSafe(F.col("__source"))
    large = _parted(placed.where("__large"), F.col("__ratio")).join(large_mass, same).drop("__source")
    large = pivotal(large, f"{seed}/large", "mix-large", cap)
    total = F.sum(F.col("mass") * (F.col("whole") + F.col("drawn")))
    gained = total - F.first(F.col("target") / F.col("source_size") * F.col("large_mass"))
    others = F.first(F.col("source_size") - F.col("large_mass"))
    shift = large.groupBy(F.col("source").alias("__source")).agg(F.when(others > 0, gained / others).alias("__shift"))
    small = placed.where("not __large").join(shift, same, "left")
    moved = F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), F.col("__ratio") - F.coalesce("__shift", F.lit(0.0))))
    small = pivotal(_parted(small, moved).drop("__source", "__shift"), f"{seed}/small", "mix-small")
    decided = large.drop("large_mass").unionByName(small)
    copies = (F.col("whole") + F.col("drawn")).cast("int").alias("copies")
    return decided.select("doc_id", "source", "size", "n", "source_size", "target", copies)


def mixed_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies say, with all its columns."""
    chosen = decisions.where("copies > 0").select(
        F.col("doc_id").alias("__doc_id"), F.col("source").alias("__source"), F.col("size").alias("__words"), "copies"
    ).withColumnRenamed("copies", "__copies")
    same = (
        F.col("doc_id").eqNullSafe(F.col("__doc_id"))
        & F.col("source").eqNullSafe(F.col("__source"))
        & (n_words(F.col("text")) == F.col("__words"))
    )
    joined = docs.join(chosen, same)
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("__copies"))).alias("__copy")).drop("__copy")
