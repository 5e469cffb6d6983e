import hashlib
import math
import random

import numpy as np

from varlake.llm import kmeans

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, vector int, best int"


def rows_of(vectors):
    return [(vec_id, vector, "c", 1, 2, 3) for vec_id, vector in vectors]


def brute(vectors, dims, k, rounds):
    kept = []
    for vec_id, v in vectors:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(64 * float(np.float32(x))) for x in v]))

    def digest(row):
        if row[0] is None:
            return (True, "", row[1])
        return (False, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest(), row[1])

    centroids = [v for _, v in sorted(kept, key=digest)[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(assign(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[i]) for x in zip(*members[i])] if i in members else c for i, c in enumerate(centroids)]
    placed = [(vec_id, *assign(v)[::-1]) for vec_id, v in kept]
    inertia = {}
    for _, cluster, distance in placed:
        inertia[cluster] = inertia.get(cluster, 0) + distance
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), named[c]) for i, c, d in placed), key=repr)


def found(df):
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_rounds(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(i % 5, 0.4) for _ in range(9)]) for i in range(400)]
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(4)
    assert found(kmeans.clustered(df, dims=9, k=7, rounds=3)) == brute(vectors, 9, 7, 3)


def test_odd_rows(spark):
    vectors = [
        (1, [0.1, 0.2]),
        (1, [0.1, 0.2]),
        (1, [0.3, -0.2]),
        (2, None),
        (3, []),
        (4, [0.1]),
        (5, [0.1, None]),
        (6, [float("nan"), 0.1]),
        (7, [float("-inf"), 0.1]),
        (None, [5.0, 5.0]),
        (8, [0.1, 0.2, 0.3]),
        (9, [-0.1, -0.2]),
    ]
    df = spark.createDataFrame(rows_of(vectors), SCHEMA).repartition(3)
    for k in (1, 2, 3, 16):
        assert found(kmeans.clustered(df, dims=2, k=k)) == brute(vectors, 2, k, 3)


def test_equal_vectors_and_empty_clusters(spark):
    vectors = [(i, [0.25] * 4) for i in range(50)] + [(100, [1.0] * 4)]
    df = spark.createDataFrame(rows_of(vectors), SCHEMA)
    assert found(kmeans.clustered(df, dims=4, k=16)) == brute(vectors, 4, 16, 3)


def test_no_rows(spark):
    assert found(kmeans.clustered(spark.createDataFrame([], SCHEMA))) == []
    assert found(kmeans.clustered(spark.createDataFrame(rows_of([(1, [0.5])]), SCHEMA))) == []
