import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from varlake.llm import fptree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {upper: upper + 32 for upper in range(65, 91)}
ITEMS = "item_id string, text string, doc_id int, key int"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    filled = [(doc_id, counts, sum(counts.values())) for doc_id, counts in counted if counts]
    n_docs, n_all = len(filled), sum(n for *_, n in filled)
    df = Counter(term for _, counts, _ in filled for term in counts)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, counts, n in filled:
            m = 100 - 90 + 90 * n * n_docs // n_all
            score = 0
            for term in set(terms(text)):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                score += weight * (10**9 * counts[term] // (1000 * counts[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, at, None if null else i, -s) for at, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def some_docs(seed, n):
    rng = random.Random(seed)
    word = lambda: f"t{min(rng.randrange(60), rng.randrange(60))}"
    return [(i, " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(n)]


def some_items(seed, n):
    rng = random.Random(seed)
    return [(f"i{i}", " ".join(f"t{rng.randrange(70)}" for _ in range(rng.randrange(1, 9)))) for i in range(n)]


def test_terms():
    texts = ["Ab-c_D9 é́É x\x00y~", "", "  ", "ÄÖ ß日本 a1\x80b", "A" * 5_000, "[\\]^_`{|}@:;Z"]
    for text in texts:
        assert [one.decode() for one in fptree.terms(text.encode())] == terms(text)
    assert fptree.terms(None) == []


@pytest.mark.parametrize("group_terms", [50_000, 40])
def test_ranks(spark, group_terms):
    docs, items = some_docs(1, 600), some_items(2, 25)
    docs += [(i + 1_000, docs[0][1]) for i in range(300)]
    frame = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, item_id string, score int").repartition(6)
    asked = spark.createDataFrame([(*i, 1, 2) for i in items], ITEMS)
    assert found(fptree.best_documents(frame, asked, group_terms=group_terms)) == brute(docs, items)


def test_odd_rows(spark, odd, none):
    items = [("a", "Word w1x1 W2X2"), ("a", "Word w1x1 W2X2"), ("b", None), ("c", " - "), (None, "one LAST äöü 日本語"), ("d", "absent"), ("e", "a" * 3_000)]
    asked = spark.createDataFrame([(*i, 1, 2) for i in items], ITEMS)
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert found(fptree.best_documents(odd, asked)) == brute(docs, items)
    assert found(fptree.best_documents(none, asked)) == []
    assert found(fptree.best_documents(odd, spark.createDataFrame([], ITEMS))) == []


def test_trees_share_paths_and_leave_subtrees_out(monkeypatch):
    rng = np.random.default_rng(3)
    ids = [np.flatnonzero(rng.random(40) < np.linspace(0.9, 0.02, 40)).astype("i4") for _ in range(800)]
    tfs = [rng.integers(1, 6, len(one)).astype("i4") for one in ids]
    m = rng.integers(10, 400, 800)
    for leaf in (1, 4, 32):
        monkeypatch.setattr(fptree, "LEAF", leaf)
        tree = fptree.Tree(list(range(800)), m, ids, tfs, 40)
        leaves = [r for r, below in zip(tree.ranges, tree.children) if not below]
        assert sorted(x for low, high in leaves for x in range(low, high)) == list(range(800))
        wanted, weights = np.array([2, 30, 38]), np.array([40, 3_000, 6_000])
        bounds = tree.bounds(wanted, weights)
        exact = np.zeros(800, "i8")
        for doc, (one, tf) in enumerate(zip(ids, tfs)):
            for term, weight in zip(wanted, weights):
                for count in tf[one == term].tolist():
                    exact[doc] += weight * (10**9 * count // (1000 * count + 8 * m[doc]))
        placed = exact[np.array(tree.doc_ids)]
        assert all(bounds[node] >= placed[low:high].max() for node, (low, high) in enumerate(tree.ranges))
        best = []
        tree.search(wanted, weights, best, 10)
        order = sorted(range(800), key=lambda d: (-exact[d], d))[:10]
        assert [(-s, d) for s, _, d in best] == [(exact[d], d) for d in order]
        assert (bounds >= -best[-1][0]).sum() < len(bounds)
