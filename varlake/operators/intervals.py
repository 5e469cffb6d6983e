"""Interval overlap as an exact equi-join.

Spark has no range join, and cutting the axis into equal bins pairs everything inside a crowded bin. Here every
interval is written as the unique smallest set of aligned blocks of sizes 1, 16, 256, 4096 and 65536 that covers
it exactly. A position lies in one block of each size, so a position is inside an interval if and only if exactly
one of its five blocks is in the interval's set. Joining on blocks therefore yields each overlapping pair once and
no other candidates: the work is proportional to the input plus the result, however crowded a region is.

Two intervals overlap if the left one's first position is inside the right one, or the right one's first position is
inside the rest of the left one. Both cases are tagged into the same key, so one join finds all pairs.

The join asks to be merged: Spark takes a table whose rows become many blocks for as small as its file, and would send all
blocks through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BITS = 4
_TOP_LEVEL = 4
_LEVELS = range(_TOP_LEVEL + 1)
# Keys are position blocks (below 2^48) plus a level tag and a case tag above them.
_LEVEL_SHIFT = 48
_CASE_SHIFT = 52


# The expressions are SQL text: built column by column, their hundreds of nodes would take the driver half a second.


def _keys(low: str, high: str, level: int, case: int) -> str:
    """Keys of the blocks ``low … high - 1``; empty if there are none."""
    tag = (level << _LEVEL_SHIFT) + (case << _CASE_SHIFT)
    return (
        f"if({high} > {low}, transform(sequence({low}, {high} - 1), b -> b + {tag}L), cast(array() as array<bigint>))"
    )


def cover(start: str, end: str, case: int = 0) -> str:
    """SQL for the keys of the aligned blocks that exactly tile ``[start, end)``; an empty array if it is empty.

    ``start`` and ``end`` are SQL expressions of type bigint.
    """

    def up(level: int) -> str:
        return f"shiftright({start} + {(1 << (_BITS * level)) - 1}L, {_BITS * level})"

    def down(level: int) -> str:
        return f"shiftright({end}, {_BITS * level})"

    pieces = []
    for level in _LEVELS[:-1]:
        # Blocks whose parent block also lies inside belong to the next level; keep what sticks out on both sides.
        inner_from = f"shiftleft({up(level + 1)}, {_BITS})"
        inner_to = f"shiftleft({down(level + 1)}, {_BITS})"
        pieces.append(_keys(up(level), f"least({down(level)}, {inner_from})", level, case))
        pieces.append(_keys(f"greatest({inner_from}, {inner_to})", down(level), level, case))
    pieces.append(_keys(up(_TOP_LEVEL), down(_TOP_LEVEL), _TOP_LEVEL, case))
    return f"concat({', '.join(pieces)})"


def ancestors(position: str, case: int = 0) -> str:
    """SQL for the keys of the blocks of every size that contain a position."""
    keys = [
        f"shiftright({position}, {_BITS * level}) + {(level << _LEVEL_SHIFT) + (case << _CASE_SHIFT)}L"
        for level in _LEVELS
    ]
    return f"array({', '.join(keys)})"


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    contig: str = "contigName",
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """All pairs of rows whose half-open intervals share at least one position, each exactly once.

    Both frames need the three coordinate columns; the right ones are called ``feature_start`` and ``feature_end``
    in the result. An empty interval, such as an insertion point, counts as its one position.
    """
    a = f"cast(`{start}` as bigint)"
    b = f"greatest(cast(`{end}` as bigint), {a} + 1)"
    left_keys = F.expr(f"concat({ancestors(a, 0)}, {cover(f'({a} + 1)', b, 1)})")
    right_keys = F.expr(f"concat({cover(a, b, 0)}, {ancestors(a, 1)})")
    lefts = left.withColumn("__block", F.explode(left_keys))
    rights = right.withColumn("__block", F.explode(right_keys)).withColumnsRenamed(
        {start: "feature_start", end: "feature_end"}
    )
    return lefts.join(rights.hint("merge"), [contig, "__block"], "inner").drop("__block")
