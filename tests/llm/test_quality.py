import random
from collections import Counter

import numpy as np
import pytest
from conftest_llm import prose
from pyspark.sql import functions as F
from test_plans import plan

from varlake.llm import quality


def brute(text):
    text = text or ""
    words = text.encode().split()
    repeated = set()
    counts = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    for i in range(len(words) - 2):
        if counts[tuple(words[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            duplicates += line in seen
            seen.add(line)
    chars = sum(c not in " \t\n\x0b\x0c\r" for c in text)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), duplicates, len(repeated)


@pytest.mark.parametrize("seed", range(40))
def test_statistics(seed):
    rng = random.Random(seed)
    text = "".join(rng.choices(["a ", "b ", "c", "\n", "##", " | ", "é\t", "a b c ", "\x0b", "\r\n", "\x1c", "\xa0"], k=rng.randrange(200)))
    assert quality.statistics(text) == brute(text)


def labelled(spark, n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = i % 8 == 0
        words = prose(i, rng.randrange(60, 200), 10**6).split()
        if bad:
            words = [word + rng.choice(["***", "%%%", "$$$"]) for word in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_bad_documents_go_and_good_ones_stay(spark):
    docs, labels = labelled(spark)
    # Calibrated on a half, looked at on the other.
    rows = {r["doc_id"]: r["kept"] for r in quality.judged(docs, labels.where("doc_id % 16 < 8")).collect()}
    other = [i for i in rows if i % 16 >= 8]
    assert [rows[i] for i in other] == [i % 8 != 0 for i in other]


def test_without_labels_the_base_rules_remain(spark):
    docs, labels = labelled(spark, 40)
    assert quality.judged(docs, labels.where("false")).where("not kept").count() == 0
    strange = spark.createDataFrame([(None, 0), (1, None), (10**9, 1)], "doc_id long, quality int")
    assert quality.judged(docs, strange).where("not kept").count() == 0


def test_isolated_points_score_higher():
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(0, 1, (500, 2)), [[9.0, 9.0]]])
    scores = quality.Forest.fitted(points, seed=1).scores(points)
    assert scores.argmax() == 500 and np.median(scores) < 0.55 < scores[500]
    assert quality.Forest.fitted(points[:0]).scores(points).tolist() == [0.0] * 501


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, 1), (None, 0)], "doc_id long, quality int")
    got = quality.judged(odd, labels).collect()
    expected = Counter()
    for row in odd.collect():
        words, chars, symbols, duplicates, repeated = brute(row["text"])
        failed = words < 50 or 100 * repeated > 50 * words
        expected[row["doc_id"], words, chars, symbols, duplicates, repeated, failed] += 1
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[n] for n in names) for r in got) == expected
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality.judged(none, labels).count() == 0
    assert quality.judged(none, labels.where("false")).count() == 0


def test_a_kind_of_junk_that_only_labelled_rows_show(spark):
    good = [(i, prose(i, 120)) for i in range(600)]
    junk = [(1_000 + i, prose(i, 120) + " #" * 60) for i in range(12)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1_000)) for i, _ in [*good[:60], *junk]], "doc_id long, quality int")
    counted = quality.with_statistics(docs)
    usual = counted.where("doc_id < 1000")
    forests = quality.fitted_forests(usual.unionByName(counted.where("doc_id >= 1000")), labels)
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(docs, labels).select("doc_id", "kept").collect()}
    assert len(forests) == 5 and not any(kept[i] for i, _ in junk) and sum(kept[i] for i, _ in good) > 580


def test_samples_are_whole_at_any_share(spark):
    counted = spark.range(100_000).select(F.col("id").alias("doc_id"), (F.col("id") % 97).alias("word_chars"))
    assert 20 < quality._sample(counted, 50).count() < 100
    assert quality._sample(counted, 10**9).count() == 100_000


def test_neither_documents_nor_labels_go_through_the_driver(spark, tmp_path, monkeypatch):
    docs, labels = labelled(spark, 64)
    labels.write.parquet(f"{tmp_path}/labels")
    small = spark.read.parquet(f"{tmp_path}/labels")
    kind, plans = type(docs), []
    for name in ("collect", "count"):
        monkeypatch.setattr(kind, name, lambda self, run=getattr(kind, name): plans.append(plan(self)) or run(self))
    judged = quality.judged(docs, small)
    # The labelled rows' count and the pool that holds them, and the calibration.
    joins = [text for text in plans if "Join" in text]
    assert len(joins) == 3 and all("SortMergeJoin" in text and "Broadcast" not in text for text in joins)
    assert judged.count() == 64
