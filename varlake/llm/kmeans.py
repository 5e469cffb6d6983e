"""Centroid clustering in native expressions.

The centroids are few and literal: ``zip_with`` and ``aggregate`` compute a vector's squared distance to each, ``array_min`` of
structs (distance, number) chooses its cluster, and one aggregate of a sum for each component and cluster updates them. The
driver sees a row per cluster and round; rows are shuffled as partial sums only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlake.llm.shared import stored
from varlake.llm.vectors import integers

RESULT = "vec_id {id}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _long_array(numbers: list[int]) -> str:
    return "array(" + ", ".join(f"{n}L" for n in numbers) + ")"


def nearest(vector: str, norm: str, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid by squared distance; ties go to the smaller number.

    ``norm`` is the column of the vectors' own squares: a distance is norm - 2 * product + the centroid's square.
    """
    choices = []
    for number, centroid in enumerate(centroids):
        products = f"zip_with({vector}, {_long_array(centroid)}, (a, b) -> a * b)"
        distance = f"{norm} - 2 * aggregate({products}, 0L, (s, x) -> s + x) + {sum(c * c for c in centroid)}L"
        choices.append(f"struct({distance} as distance, {number} as cluster)")
    return F.expr(f"array_min(array({', '.join(choices)}))")


def first_centroids(vectors: DataFrame, k: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``1:<vec_id>``, ascending; equal ids by their components, null ids last."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.orderBy(digest.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return [list(row["vector"]) for row in chosen]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every centroid becomes the componentwise floor of its vectors' mean; one without vectors stays."""
    dims = len(centroids[0])
    sums = [F.sum(F.col("vector")[at]).alias(f"s{at}") for at in range(dims)]
    assigned = vectors.select("vector", nearest("vector", "norm", centroids)["cluster"].alias("cluster"))
    out = list(centroids)
    for row in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row["cluster"]] = [row[f"s{at}"] // row["n"] for at in range(dims)]
    return out


def clustered(rows: DataFrame, vector: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of ``rows`` (vec_id, vector).

    Only vectors of exactly ``dims`` components, none null or not finite, take part, as integers floor(64 * x). With fewer
    than ``k`` of them there are as many clusters. Repeated rows are rows of their own; equal vectors share a cluster. Inertia
    is the distance summed over the cluster, and over all. An empty table, or one without such vectors, gives no rows.
    """
    narrow = rows.select("vec_id", F.col(vector).alias("vector")).where(F.size("vector") == dims)
    norm = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x)
    vectors = stored(integers(narrow, "vector").withColumn("norm", norm), "vectors")
    centroids = first_centroids(vectors, k)
    if not centroids:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], RESULT.format(id=kind))
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    best = nearest("vector", "norm", centroids)
    assigned = vectors.select("vec_id", best.alias("best")).select("vec_id", "best.cluster", "best.distance")
    inertia = [0] * len(centroids)
    for row in assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect():
        inertia[row["cluster"]] = row["n"]
    digests = [hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest() for centroid in centroids]
    names = F.expr("array(" + ", ".join(f"'{digest}'" for digest in digests) + ")")
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        F.expr(_long_array(inertia))[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"),
        names[F.col("cluster")].alias("centroid_sha256"),
    )
