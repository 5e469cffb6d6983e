import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlake.llm import mixing


def shares(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by handing out again what is above a cap, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_sources = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_sources:
        total = sum(weight[s] for s in open_sources)
        for s in open_sources:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - cap * sizes[s]) for s in sizes)
        target = {s: min(target[s], cap * sizes[s]) for s in sizes}
        open_sources = {s for s in sizes if target[s] < cap * sizes[s] - 1e-12}
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 10, 500, 90_000]) + rng.randrange(50) for s in ["a", "b", "Z", "é", "𝒜", "", None]}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(shares(sizes), rel=1e-9)


def documents(spark, seed, n=3_000):
    rng = random.Random(seed)
    rows = [(i, "w " * (rng.choice([0, 3, 40, 300]) + (5_000 if i % 500 == 1 else 0)), rng.choice("aaaabcde")) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_totals_come_near_and_reruns_agree(spark):
    docs = documents(spark, 1)
    rows = mixing.mix(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    taken, target, mean, count = defaultdict(int), {}, {}, defaultdict(int)
    for row in rows:
        assert 0 <= row["copies"] <= 2
        taken[row["source"]] += row["copies"] * row["size"]
        target[row["source"]] = row["target"]
        mean[row["source"]] = row["source_size"]
        count[row["source"]] += 1
    for source in target:
        assert abs(taken[source] - target[source]) <= mean[source] / count[source] + 1


def test_tree_of_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    test_totals_come_near_and_reruns_agree(spark)


def test_expectations_are_kept():
    fractions, masses = np.array([0.3, 0.7, 0.5, 0.25]), np.array([10.0, 3.0, 25.0, 1.0])
    total = np.zeros(4)
    rng = np.random.default_rng(5)
    runs = 6_000
    for _ in range(runs):
        out, held = mixing._paired(fractions, masses, rng.random(4))
        assert abs(out @ masses - fractions @ masses) < 1e-9
        if held is not None:
            out[held] = rng.random() < out[held]
        total += out
    assert np.abs(total / runs - fractions).max() < 0.03


def test_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert sum(r["n"] for r in rows) == odd.count()
    by_source = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    expected = shares({s: size for s, (size, _) in by_source.items()})
    assert {s: t for s, (_, t) in by_source.items()} == pytest.approx(expected, rel=1e-9)
    mixed = mixing.mixed_rows(odd, mixing.mix(odd))
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["n"] * r["copies"] for r in rows)
    assert mixed.where("doc_id = 7").count() == next(r["copies"] for r in rows if r["doc_id"] == 7)


def test_words(spark, odd):
    from varlake.llm.shared import n_words

    for row in odd.select("text", n_words(F.col("text")).alias("n")).collect():
        assert row["n"] == len((row["text"] or "").encode().split())


def test_empty_table(none):
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_a_dominated_source_meets_its_target(seed):
    """The draw of the large documents minds what the small ones can make up for; all without Spark, as a task does it."""
    import pyarrow as pa

    # 4170 words of which one text has 3000: the target can be met with one copy of it, or nearly, never with two.
    sizes, target, cap = [3_000, *[30] * 39], 5_512.0, 2.0
    total = sum(sizes)
    ratio = min(target / total, cap)
    unit = {"source": "a", "doc_id": 0, "size": 3_000, "mass": 3_000.0, "group": 0, "fraction": ratio - 1, "target": target, "source_size": total, "large_mass": 3_000.0}
    table = pa.Table.from_pylist([unit])
    drawn = mixing._rounding(f"{seed}/large", 0, True, cap)(table).column("drawn")[0].as_py()
    left = target - 3_000 * (1 + drawn)
    best = min(max(0.0, -(target - 3_000 * n), target - 3_000 * n - cap * 1_170) for n in (1, 2))
    assert max(0.0, -left, left - cap * 1_170) == best


def test_dominated_sources_through_spark(spark):
    rows = [(0, "w " * 3_000, "a"), *((i, "w " * 30, "a") for i in range(1, 40)), *((100 + i, "w " * 50, "b") for i in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in ("mix", "x", "y", "z"):
        out = mixing.mix(docs, weights=(53, 30), share=1.3, seed=seed).toPandas()
        for source, part in out.groupby("source"):
            taken, target = (part["copies"] * part["size"]).sum(), part["target"].iloc[0]
            size, mean = part["source_size"].iloc[0], part["size"].mean()
            large = part[part["size"] > mean]["size"].sum()
            # What no choice of copies of the large document can meet is left.
            missed = min(max(0.0, large * n - target, target - large * n - 2 * (size - large)) for n in (0, 1, 2)) if large else 0.0
            assert abs(taken - target) <= missed + mean + 1, (source, seed, taken, target)
