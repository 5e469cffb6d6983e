import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from varlake.llm import suffix


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256, kept bytes) of each text."""
    data = [(text or "").encode() for text in texts]
    counts = Counter(one[i : i + length] for one in data for i in range(len(one) - length + 1))
    out = []
    for one in data:
        gone = np.zeros(len(one), bool)
        for i in range(len(one) - length + 1):
            if counts[one[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(one, "u1")[~gone].tobytes()
        out.append((len(one), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcd ", k=rng.randrange(30, 400))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choices("abcdefgh é", k=rng.randrange(1, 200))))
        text = "".join(parts)
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        texts.append(text)
    return texts


def key(row):
    return tuple((value is None, value if value is not None else 0) for value in row)


def same(docs, length):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    expected = [(doc_id, *found[:4]) for (doc_id, _), found in zip(rows, brute([text for _, text in rows], length))]
    got = suffix.repeat_removal(docs, length).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("seed, length", [(0, 200), (1, 60), (2, 13), (3, 100)])
def test_every_repeat_goes(spark, seed, length):
    same(spark.createDataFrame(list(enumerate(corpus(seed))), "doc_id long, text string").repartition(4), length)


def test_odd_rows(odd):
    same(odd, 200)


def test_large_buckets_are_counted(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET", 3)
    same(spark.createDataFrame(list(enumerate(corpus(5))), "doc_id long, text string").repartition(4), 60)


def test_buckets_are_sorted_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH", 2)
    same(spark.createDataFrame(list(enumerate(corpus(6))), "doc_id long, text string").repartition(2), 60)


def test_cover_meets_every_pair_of_residues():
    differences = {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER}
    assert differences == set(range(suffix.PERIOD))


def test_cover_ranks_order_suffixes():
    text = np.frombuffer(("abracadabra" * 30).encode(), "u1")
    ranks = suffix.cover_ranks(suffix._words(text), 100)
    places = [i for i in range(len(text)) if i % suffix.PERIOD in suffix.COVER]
    data = text.tobytes() + bytes(400)
    for a, b in zip(places, places[1:]):
        one, two = data[a : a + 100], data[b : b + 100]
        if one != two:
            assert (ranks[a] < ranks[b]) == (one < two)


def test_cut_texts_keep_columns(odd):
    rows = odd.collect()
    expected = Counter()
    for row, found in zip(rows, brute([r["text"] for r in rows], 200)):
        text = None if row["text"] is None else found[4].decode(errors="ignore")
        expected[tuple(row[c] if c != "text" else text for c in odd.columns)] += 1
    assert Counter(map(tuple, suffix.without_repeats(odd, 200).collect())) == expected


def test_empty_table(none):
    assert suffix.repeat_removal(none).count() == 0
    assert suffix.without_repeats(none).count() == 0
