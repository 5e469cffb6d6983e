import random
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import prose

from varlake.llm import minhash
from varlake.llm.components import components


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent):
    """{(doc_id, text): component}; union of all linked pairs."""
    sets = [shingles(text, width) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [one for one in least[root(i)] if one is not None]
        component = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return out


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else word for word in text.split())


def key(row):
    return tuple((value is None, value if value is not None else 0) for value in row)


def corpus(seed):
    rng = random.Random(seed)
    rows, at = [], 0
    for group in range(12):
        base = prose(1000 * seed + group, rng.choice([6, 40, 150]), 10**5)
        for _ in range(rng.choice([1, 2, 12, 40])):
            rows.append((at, edited(rng, base, rng.choice([0, 0.01, 0.04, 0.08, 0.15]))))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("width", [2, 5])
def test_components_of_all_links(spark, seed, width):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(docs, width=width).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, width, 80), key=key)


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    expected = brute(rows, 2, 80)
    got = minhash.near_duplicates(odd, width=2).drop("text_hash").collect()
    # Texts without words are linked with nothing, so each is its own component.
    expected = [(d, n, c, k) if n else (d, 0, d, True) for d, n, c, k in expected]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    kept = minhash.one_of_each(odd, minhash.near_duplicates(odd, width=2))
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 10 not in ids and 6 not in ids
    assert ids.count(None) == 2 and {2, 3, 4, 5, 7, 8, 9, -5, 2**60, 11} <= set(ids)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3_000, "u8")
    a, b = np.unique(pool[:2_000]), np.unique(pool[1_000:])
    same = np.mean(minhash.signature(a, 1_000) == minhash.signature(b, 1_000))
    assert abs(same - 1 / 3) < 0.06
    assert (minhash.signature(a, 200) == minhash.signature(a, 1_000)[:200]).all()


def test_paths_and_hubs_become_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(500, 500), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 300)}


def test_empty_table(none):
    assert minhash.near_duplicates(none).count() == 0


def swapped(n, others):
    """``n`` copies of a text of 60 words, each word swapped with probability 0.1 for one of ``others`` words of its place."""
    rng = random.Random(1)
    return [(at, " ".join(f"o{i}x{rng.randrange(others)}" if rng.random() < 0.1 else f"b{i}" for i in range(60))) for at in range(n)]


# With one fixed other word the linked pairs themselves grow with more than the square: 21 and 103.
@pytest.mark.parametrize(("others", "growth"), [(1_000, 2.5), (1, 3.9)])
def test_compared_pairs_of_an_edited_group(spark, monkeypatch, others, growth):
    real, compared = minhash._compared, []

    def counting(pairs, *rest, **named):
        compared.append(pairs.count())
        return real(pairs, *rest, **named)

    monkeypatch.setattr(minhash, "_compared", counting)
    totals = []
    for n in (200, 400):
        compared.clear()
        rows = swapped(n, others)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = minhash.near_duplicates(docs, width=2).drop("text_hash").collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 2, 80), key=key)
        totals.append(sum(compared))
        print(n, compared)
    assert totals[1] <= growth * totals[0] and totals[1] < 0.3 * 400 * 399 / 2
