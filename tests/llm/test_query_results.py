"""Every column of the registered queries without SQL, and each stage of the pipeline, against plain Python."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import test_minhash
import test_mixing
import test_suffix
import test_winnow
from pyspark.sql import functions as F
from test_packing import one_by_one
from tokenizers import Tokenizer

import corpus_pipeline
from varlake.llm import quality, toxicity
from varlake.llm.queries import VOCABULARY, queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, docs, ids_of, capacity=1024):
    """``rows``: doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``docs``: (doc_id, text), repeats allowed."""
    pieces, expected = [], Counter()
    for doc_id, text in docs:
        ids = [*ids_of(text), 2]
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for number, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            expected[doc_id, number, a, b - a, crc(ids[a:b])] += 1
            pieces.append(b - a)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(bins) == len(one_by_one(pieces, capacity))


def test_op2(spark, docs, ids_of):
    check_packing(queries()["op2_best_fit_packing"](spark, SF).collect(), [d[:2] for d in docs], ids_of)


def plain_statistics(text):
    words = (text or "").encode().split()
    lines = [line.encode().split() for line in (text or "").split("\n")]
    texts, seen, repeated = (text or "").split("\n"), set(), 0
    for line, words_of in zip(texts, lines):
        if words_of:
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    symbols = sum((text or "").count(one) for one in "#*$%&|<>")
    return len(words), sum(len(word.decode()) for word in words), symbols, repeated, len(inside)


def test_op3(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    counted = quality.with_statistics(spark.read.parquet(f"{SF}/documents.parquet"))
    forests = quality.fitted_forests(counted, labels)
    expected, scores = {}, {}
    for doc_id, text, _ in docs:
        n_words, *rest = plain_statistics(text)
        failed = n_words < 50 or 100 * rest[3] > 50 * n_words
        points = np.array([[one / max(n_words, 1) for one in rest]])
        scores[doc_id] = [float(forest.scores(points[:, view])[0]) for view, forest in forests]
        expected[doc_id] = [n_words, *rest, failed]
    known = {}
    for row in labels.where("quality is not null").collect():
        known[row["doc_id"]] = min(known.get(row["doc_id"], 1), row["quality"])
    limits = []
    for at in range(len(forests)):
        kinds = {good: [int(scores[i][at] * quality.BINS) for i, q in known.items() if (q > 0) == good and i in scores and not expected[i][-1]] for good in (True, False)}
        best, limit = 0.0, 2.0
        if kinds[True] and kinds[False]:
            for bin_ in range(quality.BINS + 1):
                good, bad = (sum(one >= bin_ for one in kinds[kind]) / len(kinds[kind]) for kind in (True, False))
                gain = bad - quality.LOSS_WEIGHT * good
                if good <= quality.MOST_LOST / len(forests) and gain > 0 and gain >= best:
                    best, limit = gain, bin_ / quality.BINS
        limits.append(limit)
    rows = queries()["op3_isolation_forest"](spark, SF).collect()
    assert len(rows) == len(docs)
    for row in rows:
        i = row["doc_id"]
        own = [row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
        assert own == expected[i]
        over = any(score >= limit for score, limit in zip(scores[i], limits))
        assert row["kept"] == (not row["base_failed"] and not over) and row["anomaly"] == pytest.approx(scores[i][0])


def check_mix(rows, sizes):
    """``rows``: doc_id, size, source_size, target, taken; ``sizes``: {doc_id: (source, words)}."""
    totals, counts, taken, targets = defaultdict(int), Counter(), defaultdict(int), {}
    for source, n in sizes.values():
        totals[source] += n
        counts[source] += 1
    wanted = test_mixing.shares(dict(totals))
    for row in rows:
        source, n = sizes[row["doc_id"]]
        assert (row["size"], row["source_size"]) == (n, totals[source]) and row["target"] == pytest.approx(wanted[source])
        assert row["taken"] in (0, n, 2 * n)
        taken[source] += row["taken"]
        targets[source] = row["target"]
    for source, target in targets.items():
        largest = max(n for s, n in sizes.values() if s == source)
        assert abs(taken[source] - target) <= max(largest, totals[source] / counts[source]) + 1


def test_op6(spark, docs):
    query = queries()["op6_pivotal_mixing"]
    rows = query(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, query(spark, SF).collect())) and len(rows) == len(docs)
    check_mix(rows, {i: (source, len((text or "").encode().split())) for i, text, source in docs})


def model_of(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return toxicity.fitted(docs.select("doc_id", "text"), labels)


def test_op7(spark, docs):
    model = model_of(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    rows = {r["doc_id"]: r for r in queries()["op7_toxicity_grammar"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for i, text, _ in docs:
        score = model.score(text)
        assert rows[i]["score"] == pytest.approx(score) and rows[i]["predicted"] == int(score >= 0.5)
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_op9(spark, docs):
    got = {r["doc_id"]: r for r in queries()["op9_winnowing"](spark, SF).collect()}
    own = {i: test_winnow.brute(text) for i, text, _ in docs}
    spell = lambda found: " ".join(f"{(h << test_winnow.winnow.PLACE_BITS) + test_winnow.winnow.PLACE_MASK - 1 - at:X}" for h, at in found)

    def likeness(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    for at, (i, text, _) in enumerate(docs):
        text, (after, following, _) = text or "", docs[(at + 1) % len(docs)]
        edited = text[: len(text) - len(text) // 4] + (following or "")[: len(text) // 4]
        other, row = test_winnow.brute(edited), got[i]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row["fingerprint"], row["edited_fingerprint"]) == (spell(own[i]), spell(other))
        assert (row["near_edited"], row["near_next"]) == (likeness(own[i], other), likeness(own[i], own[after]))


def test_op10(spark, docs, ids_of):
    rows, start = {r["doc_id"]: r for r in queries()["op10_elias_fano_tokens"](spark, SF).collect()}, 0
    assert len(rows) == len(docs)
    for i, text, _ in docs:
        ids = [*ids_of(text), 0]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_rows_of_each_stage(spark, docs, ids_of, tmp_path):
    """Planted beside the given documents: exact and near copies, a passage of over 200 bytes, toxic texts, odd rows."""
    rng = random.Random(9)
    prose = lambda n: " ".join(f"p{rng.randrange(10**6)}" for _ in range(n))
    base, passage = prose(120), prose(60)
    near = base.split()
    near[50] = "changed"
    planted = [
        (10_000, base, "s1"), (10_001, base, "s1"), (10_002, " ".join(near), "s2"),
        (10_003, f"{prose(30)} {passage} {prose(30)}", "s1"), (10_004, f"{prose(40)} {passage} {prose(20)}", "s2"),
        (10_005, "you are an idiot, a moron and scum. stupid trash", "s1"), (10_006, None, "s1"), (10_007, "", None),
    ]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in planted], "doc_id long, text string, lang string, source string, n_chars int")
    extra = extra.select(*[F.col(c).cast(table.schema[c].dataType) for c in table.columns])
    table.unionByName(extra).write.parquet(f"{tmp_path}/0")

    def stage(at):
        """Runs stage ``at`` on what the one before wrote; (rows before, rows after)."""
        before = spark.read.parquet(f"{tmp_path}/{at}")
        corpus_pipeline.STAGES[at][1](spark, before, SF).write.parquet(f"{tmp_path}/{at + 1}")
        return before.collect(), spark.read.parquet(f"{tmp_path}/{at + 1}").collect()

    model = model_of(spark, spark.read.parquet(f"{tmp_path}/0"))
    before, after = stage(0)
    assert Counter(after) == Counter(r for r in before if model.score(r["text"]) < 0.5)
    assert 10_005 not in {r["doc_id"] for r in after} and {10_000, 10_006, 10_007} <= {r["doc_id"] for r in after}

    before, after = stage(1)
    kept = test_minhash.brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
    # Texts without words are linked with nothing.
    keep = {i for i, n, _, own in kept if own or not n}
    assert Counter(after) == Counter(r for r in before if r["doc_id"] in keep)
    assert not {10_001, 10_002} & keep

    before, after = stage(2)
    cut = test_suffix.brute([r["text"] for r in before], 200)
    texts = {r["doc_id"]: None if r["text"] is None else one[4].decode(errors="ignore") for r, one in zip(before, cut)}
    assert {r["doc_id"]: r["text"] for r in after} == texts and len(after) == len(before)
    assert {r["doc_id"]: (r["lang"], r["source"]) for r in after} == {r["doc_id"]: (r["lang"], r["source"]) for r in before}
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)

    before, after = stage(3)
    copies = Counter(r["doc_id"] for r in after)
    originals = {r["doc_id"]: r for r in before}
    assert all(r == originals[r["doc_id"]] for r in after)
    sizes = {i: (r["source"], len((r["text"] or "").encode().split())) for i, r in originals.items()}
    totals = Counter()
    for source, n in sizes.values():
        totals[source] += n
    wanted = test_mixing.shares(dict(totals))
    rows = [{"doc_id": i, "size": n, "source_size": totals[s], "target": wanted[s], "taken": copies[i] * n} for i, (s, n) in sizes.items()]
    check_mix(rows, sizes)

    before, after = stage(4)
    check_packing(after, [(r["doc_id"], r["text"]) for r in before], ids_of)
