import math
import random

import numpy as np
import pytest

from varlake.llm import topk
from varlake.llm.vectors import LIMIT

SCHEMA = "vec_id long, embedding array<float>, score string, rank int, shard int, label int"


def rows_of(vectors):
    return [(vec_id, vector, "s", 1, 2, 3) for vec_id, vector in vectors]


def whole(vector):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(64 * float(np.float32(x))) for x in vector]


def brute(vectors, every=20, k=20):
    kept = [(vec_id, whole(v)) for vec_id, v in vectors if whole(v) is not None]
    out = []
    for at, (query, v) in enumerate(kept):
        if query is None or query % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), other is None, other or 0) for i, (other, w) in enumerate(kept) if i != at]
        for rank, (score, null, other) in enumerate(sorted(scored)[:k], 1):
            out.append((query, rank, None if null else other, -score))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_many_shards_ties_and_copies(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(700)]
    vectors += [(i, [0.5] * 12) for i in range(700, 1000)]
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(5)
    want = brute(vectors)
    assert found(topk.top_products(df, shard_rows=90)) == want
    assert found(topk.top_products(df)) == want


def test_odd_rows(spark):
    rng = random.Random(6)
    vectors = [
        (0, [0.1, -0.2, 0.3]),
        (0, [0.1, -0.2, 0.3]),
        (20, None),
        (40, [0.1, None, 0.2]),
        (60, [float("nan"), 0.0, 0.0]),
        (80, [float("inf"), 0.0, 0.0]),
        (100, []),
        (120, [0.5]),
        (None, [0.2, 0.2, 0.2]),
        (None, [0.2, 0.2, 0.2]),
        (-20, [-0.3, 0.2, 0.9, 0.4, -0.4]),
        (2**40 // 20 * 20, [1.5, -2.5, 3.5]),
        *((i, [rng.uniform(-1, 1) for _ in range(rng.randrange(6))]) for i in range(121, 160)),
    ]
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(3)
    for size in (None, 4):
        assert found(topk.top_products(df, shard_rows=size)) == brute(vectors)


def test_few_and_no_rows(spark):
    assert found(topk.top_products(spark.createDataFrame([], SCHEMA))) == []
    one = [(20, [0.5, 0.5])]
    assert found(topk.top_products(spark.createDataFrame(rows_of(one), SCHEMA))) == []
    two = [*one, (21, [1.0, 1.0])]
    assert found(topk.top_products(spark.createDataFrame(rows_of(two), SCHEMA))) == [(20, 1, 21, 32 * 64 * 2)]


def test_large_components_are_exact_or_an_error(spark):
    vectors = [(i, [float(i * 3_001 - 7), float(LIMIT // 64 - 1 - i)]) for i in range(60)]
    assert found(topk.top_products(spark.createDataFrame(rows_of(vectors), SCHEMA))) == brute(vectors)
    beyond = spark.createDataFrame(rows_of([(0, [float(LIMIT)])]), SCHEMA)
    with pytest.raises(Exception, match="too large"):
        topk.top_products(beyond).collect()


def test_blocks_are_left_out_by_their_bounds():
    rng = np.random.default_rng(1)
    matrix = np.concatenate([rng.integers(0, 4, (160, 8)), rng.integers(50, 60, (32, 8))])
    matrix = matrix[topk.bisected(matrix.astype("f8"))]
    index = topk.Blocks(list(range(192)), matrix)
    real, seen = np.matmul, []

    class Counted(np.ndarray):
        pass

    def counting(a, b):
        seen.append(a.shape[0] * a.shape[1])
        return real(a, b)

    query = np.full((1, 8), 3)
    try:
        topk.np.matmul = counting
        _, place, score = index.search(query, 20, np.array([np.iinfo("i8").min]), np.array([-1]))
    finally:
        topk.np.matmul = real
    assert sum(seen) == topk.STEP < len(index.forward)
    assert sorted(score)[::-1] == sorted((matrix @ query[0]).tolist())[::-1][:20]
