import hashlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from varlake.llm import winnow


def brute(text, gram=winnow.GRAM, window=winnow.WINDOW):
    """[(hash, place)] by winnowing one window after the other; the rightmost of equal hashes."""
    data = (text or "").encode()
    if not data:
        return []
    n = max(1, len(data) - gram + 1)
    hashes = [xxhash.xxh64_intdigest(data[i : i + gram], 42) & winnow.HASH_MASK for i in range(n)]
    out = []
    for start in range(max(1, n - window + 1)):
        part = range(start, min(start + window, n))
        at = min(part, key=lambda i: (hashes[i], -i))
        if not out or out[-1] != (hashes[at], at):
            out.append((hashes[at], at))
    return out


def key(row):
    return tuple((value is None, value if value is not None else 0) for value in row)


def test_fingerprints_and_likeness(odd):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    rows.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1]))
    spell = lambda found: " ".join(f"{(h << winnow.PLACE_BITS) + winnow.PLACE_MASK - 1 - at:X}" for h, at in found)

    def likeness(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    expected = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        own, other = brute(text), brute(edited)
        expected.append(
            (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), spell(own), spell(other), likeness(own, other), likeness(own, brute(following)))
        )
    got = winnow.compared(odd).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_rightmost_of_equal_hashes(spark):
    text = "x" * 200
    row = spark.createDataFrame([(text,)], "text string").select(
        winnow.places(winnow.winnowed(F.encode("text", "utf-8"))).alias("places")
    ).first()
    # All hashes are equal, so each window chooses its last.
    assert row["places"] == list(range(winnow.WINDOW - 1, len(text) - winnow.GRAM + 1))


def test_long_shared_runs_share_a_fingerprint(spark):
    shared = "a passage of just as many bytes as the window and the gram need"[: winnow.GRAM + winnow.WINDOW - 1]
    rows = [(f"{'one two three ' * 5}{shared} and so on", f"{'4 5 6 ' * 9}{shared}?")]
    found = spark.createDataFrame(rows, "a string, b string").select(
        winnow.hashes(winnow.winnowed(F.encode("a", "utf-8"))).alias("a"), winnow.hashes(winnow.winnowed(F.encode("b", "utf-8"))).alias("b")
    ).first()
    assert set(found["a"]) & set(found["b"])


def test_ranges_follow_each_other(spark):
    ids = [1, 2, 3, 50, 51, 4_000, 4_001, 100_000, -7]
    docs = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in winnow.with_next(docs, group=2).collect()}
    order = sorted(ids)
    assert got == {a: f"text of {b}" for a, b in zip(order, order[1:] + order[:1])}


def test_one_row_and_none(spark, none):
    alone = spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")
    assert winnow.compared(alone).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert winnow.compared(none).count() == 0


def test_main_path_is_native(odd):
    plan = winnow.compared(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ranges_hold_as_many_rows_however_ids_are_spread(spark):
    ids = [*range(2_000), 10**12, -(10**15), 2**62, *range(10**9, 10**9 + 2_000)]
    docs = spark.createDataFrame([(i, "x") for i in ids] + [(None, "x")], "doc_id long, text string")
    placed = docs.select("doc_id", winnow.ranges_of(docs, 50).alias("range")).collect()
    sizes = Counter(r["range"] for r in placed)
    assert len(sizes) > 60 and max(sizes.values()) < 200 and sizes[-1] == 1
    ordered = [r["range"] for r in sorted(placed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))]
    assert ordered == sorted(ordered)


def test_far_ids_follow_each_other(spark):
    texts = {i: f"text of {i} " * 5 for i in [3, 10**12, -(10**15), *range(100, 180)]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    order = sorted(texts)
    follows = dict(zip(order, [*order[1:], order[0]]))
    got = {r["doc_id"]: r["next_text"] for r in winnow.with_next(docs, 8).collect()}
    assert got == {i: texts[follows[i]] for i in order}
