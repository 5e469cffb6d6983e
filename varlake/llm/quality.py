"""Quality by rule statistics and an isolation forest over them.

Each tree of the forest splits a small sample by random features at random values; a document that few splits set apart is
anomalous. One forest sees all statistics, and one each of them. They learn from the statistics alone; where a score becomes
a rejection is calibrated on labelled rows, for each forest.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlake.llm.shared import extended, map_slices, stored

#: Trees and rows of each tree's sample: the forest is fitted on their product at most.
TREES, TREE_ROWS = 100, 256
#: Bins of scores between 0 and 1 that labels are counted in, the share of good labelled rows that may be lost, and how much
#: the share of lost good rows weighs against that of rejected bad ones.
BINS, MOST_LOST, LOSS_WEIGHT = 1000, 0.01, 50.0

# The rules' characters and limits.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
LEAST_WORDS, MOST_REPEATED = 50, 50


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text; null has none."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    duplicates = 0
    if "\n" in text:
        lines = [line for line in text.split("\n") if line.strip(SPACES)]
        duplicates = len(lines) - len(set(lines))
    return len(words), chars, symbols, duplicates, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a run of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    repeated, covered = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            repeated += at + 3 - max(at, covered)
            covered = at + 3
    return repeated


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) per row of ``docs`` (doc_id, text)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([statistics(text) for text in batch.column(1).to_pylist()], "i8").reshape(-1, len(names))
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T.copy())], names=["doc_id", *names])

    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_slices(narrow, count, f"doc_id {kind}, " + ", ".join(f"{name} long" for name in names))


def features() -> list[Column]:
    """What the forest sees: all per word, so that a text's length is no anomaly."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [(F.col(name) / words).alias(name) for name in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass
class Forest:
    """Trees as arrays: feature (-1 for a leaf), split value, left child (the right one follows), path length at leaves."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    usual: float

    @classmethod
    def fitted(cls, sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 0) -> Forest:
        rng = np.random.default_rng(seed)
        rows = min(rows, len(sample))
        depth = max(1, int(np.ceil(np.log2(max(2, rows)))))
        grown = [cls._tree(sample[rng.choice(len(sample), rows, replace=False)], depth, rng) for _ in range(trees)] if rows else []
        return cls(grown, _usual_path(rows) or 1.0)

    @staticmethod
    def _tree(points: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes = [(-1, 0.0, 0, 0.0)]
        waiting = [(0, points, 0)]
        while waiting:
            node, here, level = waiting.pop()
            low, high = here.min(axis=0), here.max(axis=0)
            splittable = np.flatnonzero(high > low)
            if level == depth or len(here) < 2 or not len(splittable):
                nodes[node] = (-1, 0.0, 0, level + _usual_path(len(here)))
                continue
            feature = int(rng.choice(splittable))
            value = float(rng.uniform(low[feature], high[feature]))
            left = here[:, feature] <= value
            nodes[node] = (feature, value, len(nodes), 0.0)
            waiting += [(len(nodes), here[left], level + 1), (len(nodes) + 1, here[~left], level + 1)]
            nodes += [(-1, 0.0, 0, 0.0)] * 2
        kinds = ("i8", "f8", "i8", "f8")
        return tuple(np.array(column, kind) for column, kind in zip(zip(*nodes), kinds))

    def scores(self, points: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the mean path, the nearer 1. Without trees 0."""
        if not self.trees:
            return np.zeros(len(points))
        paths = np.zeros(len(points))
        rows = np.arange(len(points))
        for feature, value, left, path in self.trees:
            at = np.zeros(len(points), "i8")
            while (inner := feature[at] >= 0).any():
                down = left[at] + (points[rows, feature[at]] > value[at])
                at = np.where(inner, down, at)
            paths += path[at]
        return 2.0 ** (-paths / len(self.trees) / self.usual)


def _usual_path(n: int) -> float:
    """Mean path of an unsuccessful search among n: the depth that n rows would have taken on."""
    if n < 2:
        return 0.0
    return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else 1.0


def _sample(rows: DataFrame, n: int) -> DataFrame:
    """About ``n`` of ``rows`` by a hash of theirs, compared in 64 bits: not empty for any table that is not."""
    bound = min((1 << 63) - 1, -(1 << 63) + int(min(1.0, n / max(1, rows.count())) * (1 << 64)))
    return rows.where(F.xxhash64("doc_id", "word_chars") <= bound)


def fitted_forests(
    statistics: DataFrame, labels: DataFrame | None = None, trees: int = TREES, rows: int = TREE_ROWS
) -> list[tuple[list[int], Forest]]:
    """One forest over all features and one over each: (columns, forest).

    Each tree draws from a pool: a hash sample of about ``trees * rows / 4`` documents that pass the base rules, as many again
    of those with a label, whose kinds of junk may be rare elsewhere, and, of each feature that is constant among these, the
    smallest and the largest value over all documents, without which nothing could stand out by it.
    """
    usable = statistics.where(~base_failed())
    n, columns = trees * rows // 4, features()
    names = [f"__{at}" for at in range(len(columns))]
    valued = [column.alias(name) for name, column in zip(names, columns)]
    pool = _sample(usable, n).select(*valued)
    if labels is not None:
        # Both are one row per document in small files: Spark would take either for small and send it through the driver.
        known = labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().hint("merge")
        pool = pool.unionByName(_sample(usable.join(known, "doc_id", "left_semi"), n).select(*valued))
    points = np.array(sorted(map(tuple, pool.collect())), "f8").reshape(-1, len(columns))
    if len(points):
        limits = usable.select(*valued).agg(*[f(name).alias(f"{kind}{name}") for name in names for kind, f in (("low", F.min), ("high", F.max))]).first()
        for at, name in enumerate(names):
            if points[:, at].min() == points[:, at].max():
                ends = np.repeat(np.median(points, axis=0)[None], 2, axis=0)
                ends[:, at] = limits[f"low{name}"], limits[f"high{name}"]
                # As many rows as make one of them likely in each tree, but few enough to stay unusual.
                points = np.concatenate([points, np.repeat(ends, max(1, len(points) // rows), axis=0)])
    views = [list(range(len(columns))), *([at] for at in range(len(columns)))]
    return [(view, Forest.fitted(points[:, view], trees, rows, seed)) for seed, view in enumerate(views)]


def anomalies(statistics: DataFrame, forests: list[tuple[list[int], Forest]]) -> DataFrame:
    """Adds ``anomalies``: the score of each forest."""
    schema = extended(statistics.schema, anomalies="array<double>")
    wide = statistics.select(*statistics.columns, F.array(*features()).alias("__features"))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = np.array(batch.column("__features").to_pylist(), "f8").reshape(batch.num_rows, -1)
        scores = np.stack([forest.scores(points[:, view]) for view, forest in forests], axis=1)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores.tolist(), pa.list_(pa.float64()))], names=schema.names)

    return map_slices(wide, score, schema)


def thresholds(scored: DataFrame, labels: DataFrame, label: str = "quality", most_lost: float = MOST_LOST) -> list[float]:
    """Per forest the score from which on documents are rejected, calibrated over all labelled rows.

    It is where the rejected share of bad rows most exceeds LOSS_WEIGHT times that of good ones, of which ``most_lost`` may
    be lost over all forests. Only rows that pass the base rules count. A forest that gains nothing, or has no labels of both
    kinds, rejects nothing (threshold 2). Of conflicting labels of a doc_id the smaller counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("__label"))
    bins = F.transform("anomalies", lambda score: F.floor(score * BINS).cast("int"))
    joined = scored.where(~base_failed()).select("doc_id", bins.alias("__bins")).join(known.hint("merge"), "doc_id")
    spread = joined.select((F.col("__label") > 0).alias("good"), F.posexplode("__bins").alias("forest", "bin"))
    rows = spread.groupBy("forest", "bin", "good").agg(F.count("*").alias("n")).collect()
    n_forests = len(features()) + 1
    counts = np.zeros((n_forests, 2, BINS + 2))
    for row in rows:
        counts[row["forest"], int(row["good"]), row["bin"]] += row["n"]
    out = []
    for one in counts:
        if not one.sum(axis=1).all():
            out.append(2.0)
            continue
        bad, good = one[:, ::-1].cumsum(axis=1)[:, ::-1] / one.sum(axis=1, keepdims=True)
        gain = np.where(good <= most_lost / n_forests, bad - LOSS_WEIGHT * good, -1.0)
        best = int(np.flatnonzero(gain == gain.max())[-1])
        out.append(best / BINS if gain[best] > 0 else 2.0)
    return out


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base_failed, anomalies, anomaly (that of all features) and kept per row of ``docs`` (doc_id, text).

    Null texts have no words and fail the base rules. Rows that repeat a doc_id are judged each by its own text.
    """
    counted = stored(with_statistics(docs), "statistics")
    scored = anomalies(counted, fitted_forests(counted, labels))
    limits = F.array(*map(F.lit, thresholds(scored, labels)))
    over = F.exists(F.arrays_zip(F.col("anomalies").alias("score"), limits.alias("limit")), lambda one: one["score"] >= one["limit"])
    return (
        scored.withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~over)
        .withColumn("anomaly", F.get("anomalies", F.lit(0)))
    )
