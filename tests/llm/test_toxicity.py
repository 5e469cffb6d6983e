import os
import random
import zlib

import pytest
from conftest_llm import prose
from pyspark.sql import functions as F

from varlake.llm import toxicity

MACHINE = toxicity.grammar()
LEXICON = toxicity.Lexicon({"grobian"}, {"vequ"})


@pytest.mark.parametrize(
    "text, pattern",
    [
        ("what a fine day", None),
        ("that idiot came", "J"),
        ("only an idiot came", "I"),
        ("idiot is what you are", "J"),
        ("you. idiot", "I"),
        ("not an idiot", "n"),
        ("not. an idiot", "I"),
        ("not one two three an idiot", "I"),
        ("John wrote idiot on it", "r"),
        ("John wrote it. idiot", "I"),
        ("they will kill you", "K"),
        ("kill time", "V"),
        ("never kill them", "n"),
        ('the sign read "idiot"', "r"),
        ("Vequxyz came", "I"),
        ("vequ came", None),
        ("GROBIAN!", "I"),
    ],
)
def test_patterns_of_a_clause(text, pattern):
    counts = toxicity.clauses(LEXICON.symbols(text), MACHINE)
    assert [p for p, n in zip(toxicity.PATTERNS, counts) if n] == ([pattern] if pattern else [])


def test_clauses_are_counted():
    counts = toxicity.clauses(LEXICON.symbols("idiot, moron moron. you loser! well; scum"), MACHINE)
    assert dict(zip(toxicity.PATTERNS, counts)) == {"K": 0, "J": 1, "I": 3, "V": 0, "r": 0, "n": 0}


def test_composition_equals_one_after_the_other():
    rng = random.Random(1)
    for _ in range(200):
        symbols = "".join(rng.choices(toxicity.ALPHABET, k=12))
        state, out = MACHINE.start, ""
        for symbol in symbols:
            state, made = MACHINE.arcs[state, symbol]
            out += made
        assert len(out) == len(symbols)
        assert all(a == b for a, b in zip(out, symbols) if b == ".")


def corpus(spark, n=1_200):
    rng = random.Random(9)
    stems = ["quarg", "zoltr", "mibbe"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = prose(i, rng.randrange(30, 90), 3_000).replace("w", "p").split()
        words = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in word) for word in words]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + "".join(rng.choices("abcdefg", k=3)))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_with_unknown_words(spark):
    docs, labels = corpus(spark)
    model = toxicity.fitted(docs, labels)
    rows = toxicity.scored(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows} == {0}
    assert len(rows) > 150 and all((r["score"] >= 0.5) == bool(r["toxic"]) for r in rows)


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(spark, 300)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fitted(docs, which) for which in (labels, turned))
    assert (one.weights == two.weights).all()
    assert one.lexicon._stems == two.lexicon._stems and one.lexicon._words == two.lexicon._words


def test_copies_are_no_evidence(spark):
    docs, labels = corpus(spark, 300)
    copied = docs.unionByName(docs.where("doc_id = 7").crossJoin(spark.range(40)).selectExpr("1000 + id as doc_id", "text"))
    marked = labels.where("doc_id <> 7").unionByName(spark.range(1000, 1040).selectExpr("id as doc_id", "1 as toxic"))
    plain = docs.where("doc_id = 7").first()["text"].split()
    found = toxicity.fitted(copied, marked).lexicon
    assert not found._words & set(plain)


def test_without_labels_fixed_words_remain(spark, none):
    docs = spark.createDataFrame([(1, "you idiot. you moron"), (2, "hello"), (3, None), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (99, 1), (2, None)], "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()}
    assert scores[1] >= 0.5 > scores[2] == scores[3] == scores[4]


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (7, 1), (7, 0), (None, 0)], "doc_id long, toxic int")
    model = toxicity.fitted(odd, labels)
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.scored(none, toxicity.fitted(none, labels)).count() == 0


def test_weak_stems_count_words_of_a_family(spark):
    rng = random.Random(4)
    tails = ["pa", "ou", "en", "re", "oi", "ch", "vi", "au", "eux", "tre"]
    rows, labels = [], []
    for i in range(400):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnprst')}{rng.choice('aeiou')}{rng.choice('xyz')}" for _ in range(60)]
        toxic = i % 10 == 0
        # Each word of the family is rare; one of them is in every tenth clean text too.
        for tail in rng.sample(tails, 4 if toxic else int(i % 10 == 5)):
            words[rng.randrange(60)] = "grolm" + tail
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fitted(docs, known)
    assert "grolm" in model.lexicon._weak
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert all((scores[i] >= 0.5) == bool(toxic) for i, toxic in labels)
    again = toxicity.fitted(docs.repartition(7), known.repartition(2))
    assert (again.weights == model.weights).all() and again.lexicon._weak == model.lexicon._weak


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_held_out_rows(spark, sf):
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    known = toxicity.scored(docs, toxicity.fitted(docs, labels)).join(labels.where("toxic is not null"), "doc_id")
    rows = known.where(toxicity.held_out(F.col("doc_id"))).select("score", "toxic").collect()
    toxic = [r["score"] >= 0.5 for r in rows if r["toxic"]]
    clean = [r["score"] >= 0.5 for r in rows if not r["toxic"]]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)
