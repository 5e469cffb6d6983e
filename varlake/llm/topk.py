"""Exact top-k inner products by block-at-a-time pruning.

Vectors are documents whose dimensions are terms. They are dealt into shards, ranges of vec_id that fit a task; within a shard
they are ordered by recursive bisection along the direction of most variance, and consecutive ones form small blocks. A block
has a forward index (its vectors) and for each term its largest and smallest weight. For each query, blocks go in descending
order of their bound, the query's positive components times the largest weights plus its negative ones times the smallest,
and are scored through the forward index until the bound falls below the k-th score.

A query first meets the shard that it lies in; the k-th score there is its threshold in all others. Queries and shards meet in
groups of bounded size, within which thresholds go on rising; nothing is broadcast, and only what reaches the threshold goes on to the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varlake.llm.shared import stored
from varlake.llm.vectors import integers

#: Vectors of a block; blocks that one query scores at a time.
BLOCK, STEP = 16, 8
#: Vectors of a shard, at least and at most: it grows with the table, so that queries travel to fewer of them.
LEAST_SHARD, MOST_SHARD = 4_096, 65_536
#: Shards that queries visit in one task, and shards whose queries do so together, at most and in proportion to all.
HOSTS, GUESTS = 16, 64
#: Scores that a search holds at a time.
HELD = 1 << 20

SHARD = (
    "partition int, number int, dims int, vec_ids array<long>, matrix binary, query_ids array<long>, query_matrix binary,"
    " thresholds array<long>, found array<struct<query: int, vec_id: long, score: long>>"
)
HIT = "shard long, query int, query_id long, vec_id long, score long"


def bisected(matrix: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """An order of rows in which runs of ``block`` are alike: halves along the direction of most variance, again and again."""
    out, todo = [], [np.arange(len(matrix))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            out.append(rows)
            continue
        part = matrix[rows] - matrix[rows].mean(axis=0)
        axis = part[np.abs(part).sum(axis=1).argmax()]
        for _ in range(4):
            axis = part.T @ (part @ axis)
            axis = axis / (np.linalg.norm(axis) or 1.0)
        order = rows[np.argsort(part @ axis, kind="stable")]
        half = -(-len(order) // (2 * block)) * block
        todo += [order[half:], order[:half]]
    return np.concatenate(out) if out else np.empty(0, "i8")


class Blocks:
    """A shard's forward index in blocks, with the weights' bounds. ``vec_ids`` may hold nulls; they rank last."""

    def __init__(self, vec_ids: list[int | None], matrix: np.ndarray, block: int = BLOCK) -> None:
        self.vec_ids, self.n, self.block = vec_ids, len(vec_ids), block
        order = sorted(range(self.n), key=lambda at: (vec_ids[at] is None, vec_ids[at] or 0))
        self.rank = np.empty(self.n, "i8")
        self.rank[order] = np.arange(self.n)
        n_blocks = -(-self.n // block)
        whole = np.concatenate([matrix, np.repeat(matrix[-1:], n_blocks * block - self.n, axis=0)])
        self.forward = whole.reshape(n_blocks, block, matrix.shape[1])
        self.most, self.least = self.forward.max(axis=1), self.forward.min(axis=1)
        self.largest = int(np.abs(matrix).max(initial=0))

    def search(self, queries: np.ndarray, k: int, thresholds: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, place, score) of each query's k best places with a score of at least its threshold.

        Ties go to the smaller vec_id. ``own`` is the place that a query must not return (-1: none).
        """
        step = max(1, HELD // (STEP * self.block * max(1, self.forward.shape[2] // 8)))
        found = [(np.empty(0, "i8"),) * 3]
        for at in range(0, len(queries), step):
            part = slice(at, at + step)
            found.append(self._search(queries[part], k, thresholds[part], own[part], at))
        return tuple(np.concatenate(columns) for columns in zip(*found))

    def _search(self, queries, k, thresholds, own, first):
        dims = min(queries.shape[1], self.forward.shape[2])
        queries = queries[:, :dims]
        reach = int(np.abs(queries).max(initial=0)) * self.largest * max(1, dims)
        if reach >= (1 << 62) // max(1, self.n):
            raise OverflowError("inner products of these vectors are too large to be ranked in 64 bits")
        # Whole numbers below 2**24 and 2**53 are exact in single and double precision.
        kind = "f4" if reach < 1 << 24 else "f8" if reach < 1 << 53 else "i8"
        forward, weights = self.forward[:, :, :dims].astype(kind), queries.astype(kind)
        bounds = np.maximum(weights, 0) @ self.most[:, :dims].T.astype(kind) + np.minimum(weights, 0) @ self.least[:, :dims].T.astype(kind)
        order = np.argsort(-bounds, axis=1, kind="stable")
        bounds = np.take_along_axis(bounds, order, axis=1).astype("i8")
        # One number ranks scores and, among equals, vec_ids: score * n + (n - 1 - rank). Below the threshold is no result.
        floor = np.where(thresholds == np.iinfo("i8").min, -(1 << 62), thresholds * self.n)
        best = np.full((len(queries), k), -(1 << 62), "i8")
        places = np.zeros((len(queries), k), "i8")
        for at in range(0, order.shape[1], STEP):
            kth = np.maximum(floor, best[:, -1] // self.n * self.n)
            live = np.flatnonzero(bounds[:, at] * self.n >= kth)
            if not len(live):
                break
            blocks = order[live, at : at + STEP]
            scores = np.matmul(forward[blocks], weights[live][:, None, :, None])[..., 0].astype("i8")
            where = (blocks[:, :, None] * self.block + np.arange(self.block)).reshape(len(live), -1)
            real = (where < self.n) & (where != own[live][:, None])
            where = np.minimum(where, self.n - 1)
            keys = scores.reshape(len(live), -1) * self.n + (self.n - 1 - self.rank[where])
            keys[~real | (keys < floor[live][:, None])] = -(1 << 62)
            keys, where = np.concatenate([best[live], keys], axis=1), np.concatenate([places[live], where], axis=1)
            top = np.argpartition(-keys, k - 1, axis=1)[:, :k]
            keys, where = np.take_along_axis(keys, top, axis=1), np.take_along_axis(where, top, axis=1)
            top = np.argsort(-keys, axis=1, kind="stable")
            best[live], places[live] = np.take_along_axis(keys, top, axis=1), np.take_along_axis(where, top, axis=1)
        query, rank = np.nonzero(best > -(1 << 62))
        return query + first, places[query, rank], best[query, rank] // self.n


def sharded(vectors: DataFrame, rows: int, every: int, k: int) -> DataFrame:
    """A row per shard of ``vectors`` (vec_id, vector): its index, its queries and what these find in it (schema SHARD).

    A shard's vectors have as many components each; partitions are ranges of (components, vec_id), cut after 2 * ``rows``.
    """
    n = max(1, -(-vectors.count() // rows))
    by = [F.size("vector"), F.col("vec_id").asc_nulls_last()]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        parts: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            matrix = np.concatenate(parts)
            order = bisected(matrix.astype("f8"))
            matrix, vec_ids = matrix[order], [ids[at] for at in order]
            asked = np.array([at for at, one in enumerate(vec_ids) if one is not None and one % every == 0], "i8")
            index = Blocks(vec_ids, matrix)
            none = np.full(len(asked), np.iinfo("i8").min)
            query, place, score = index.search(matrix[asked], k, none, asked)
            full = np.bincount(query, minlength=len(asked)) == k
            lowest = np.full(len(asked), np.iinfo("i8").max)
            np.minimum.at(lowest, query, score)
            found = [{"query": int(q), "vec_id": vec_ids[p], "score": int(s)} for q, p, s in zip(query, place, score)]
            row = {
                "partition": partition,
                "number": number,
                "dims": matrix.shape[1],
                "vec_ids": vec_ids,
                "matrix": matrix.astype("<i4").tobytes(),
                "query_ids": [vec_ids[at] for at in asked],
                "query_matrix": matrix[asked].astype("<i4").tobytes(),
                "thresholds": [int(low) if enough else None for low, enough in zip(lowest, full)],
                "found": found,
            }
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat, at = column.flatten().to_numpy().astype("i8"), 0
            names = batch.column(0).to_pylist()
            while at < len(names):
                room = 2 * rows - len(ids)
                alike = at + int(np.argmin(np.append(sizes[at : at + room] == sizes[at], False)))
                if parts and (parts[0].shape[1] != sizes[at] or room <= 0):
                    yield closed()
                    ids, parts, number = [], [], number + 1
                    continue
                start = int(sizes[:at].sum())
                parts.append(flat[start : start + (alike - at) * sizes[at]].reshape(alike - at, sizes[at]))
                ids += names[at:alike]
                at = alike
        if parts:
            yield closed()

    return vectors.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(build, SHARD)


_ARROW = pa.schema(
    [
        ("partition", pa.int32()),
        ("number", pa.int32()),
        ("dims", pa.int32()),
        ("vec_ids", pa.list_(pa.int64())),
        ("matrix", pa.binary()),
        ("query_ids", pa.list_(pa.int64())),
        ("query_matrix", pa.binary()),
        ("thresholds", pa.list_(pa.int64())),
        ("found", pa.list_(pa.struct([("query", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())]))),
    ]
)


def visits(shards: DataFrame, n_shards: int, k: int) -> DataFrame:
    """What the queries of each shard find in the others, at or above their thresholds (schema HIT).

    A task takes some shards and the queries of some others; a query's threshold rises from one of its shards to the next.
    """
    hosts_each, guests_each = max(1, min(HOSTS, n_shards // 16)), max(1, min(GUESTS, n_shards // 4))
    rooms, parties = -(-n_shards // hosts_each), -(-n_shards // guests_each)

    def counted(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    hosts = shards.select(
        "shard", "dims", "vec_ids", "matrix", F.floor(F.col("shard") / hosts_each).alias("room"), counted(parties).alias("party")
    )
    guests = shards.where(F.size("query_ids") > 0).select(
        "shard",
        "dims",
        "query_ids",
        "query_matrix",
        "thresholds",
        F.floor(F.col("shard") / guests_each).alias("party"),
        counted(rooms).alias("room"),
    )

    def meet(hosts: pa.Table, guests: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], [], []]
        rooms = [(one["shard"], Blocks(one["vec_ids"], _matrix(one["matrix"], len(one["vec_ids"]), one["dims"]))) for one in hosts.to_pylist()]
        for guest in guests.to_pylist() if rooms else ():
            asked = len(guest["query_ids"])
            queries = _matrix(guest["query_matrix"], asked, guest["dims"])
            lowest = np.array([np.iinfo("i8").min if low is None else low for low in guest["thresholds"]], "i8")
            best: list[list[tuple]] = [[] for _ in range(asked)]
            for shard, index in rooms:
                if shard == guest["shard"]:
                    continue
                query, place, score = index.search(queries, k, lowest, np.full(asked, -1))
                for at, where, value in zip(query.tolist(), place.tolist(), score.tolist()):
                    best[at].append((-value, index.vec_ids[where] is None, index.vec_ids[where] or 0))
                for at in set(query.tolist()):
                    best[at] = sorted(best[at])[:k]
                    if len(best[at]) == k:
                        lowest[at] = max(lowest[at], -best[at][-1][0])
            for at, found in enumerate(best):
                for minus, null, vec_id in found:
                    row = guest["shard"], at, guest["query_ids"][at], None if null else vec_id, -minus
                    for column, value in zip(columns, row):
                        column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["shard", "query", "query_id", "vec_id", "score"])

    return hosts.groupBy("room", "party").cogroup(guests.groupBy("room", "party")).applyInArrow(meet, HIT)


def _matrix(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").astype("i8").reshape(n, dims)


def top_products(
    rows: DataFrame, vector: str = "embedding", every: int = 20, k: int = 20, shard_rows: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every`` its k largest inner products.

    Vectors, of ``rows`` (vec_id, vector), are taken as integers floor(64 * x); null ones and those with null or infinite
    components take no part. Candidates are all rows but the query's own; equal scores rank by ascending vec_id, nulls last.
    Repeated vec_ids are queries of their own. Vectors of different length meet as if the shorter went on with zeros, so
    empty ones score 0. ``shard_rows`` is the size of shards, by default one that suits the table. With fewer candidates than ``k`` all are ranked; an empty table gives an empty result.
    """
    narrow = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    vectors = integers(narrow, "vector").withColumn("vector", F.col("vector").cast("array<int>"))
    size = shard_rows or max(LEAST_SHARD, min(MOST_SHARD, rows.count() // 256))
    shards = stored(sharded(vectors, size, every, k), "shards")
    last, numbers = shards.agg(F.max("partition"), F.max("number")).first()
    n_partitions = 0 if last is None else last + 1
    shards = shards.withColumn("shard", F.col("number").cast("long") * n_partitions + F.col("partition"))
    home = shards.select("shard", "query_ids", F.explode("found").alias("hit")).select(
        "shard", "hit.query", F.col("query_ids")[F.col("hit.query")].alias("query_id"), "hit.vec_id", "hit.score"
    )
    hits = home if last is None else home.unionByName(visits(shards, n_partitions * (numbers + 1), k))
    best = Window.partitionBy("shard", "query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
