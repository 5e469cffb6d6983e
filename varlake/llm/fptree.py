"""Ranked lexical search over document FP-trees.

The items' terms are the vocabulary. A document is cut to its restricted term vector, the vocabulary terms that it holds with
their counts, most frequent first; documents that agree in their first terms share a path of a trie. A task builds the trie
of some thousand documents at a time: sorted by their vectors, each node is a range of them, and runs of small subtrees are one
leaf. A node keeps the largest tf of each term below it and the smallest m. A score grows with tf and falls with m, so these
bound all documents of the subtree: each item goes depth first, the best child first, and leaves out subtrees that cannot reach
its k-th score so far. Leaves are scored exactly, in whole numbers.

Items are searched in groups whose terms fit a task; documents are read once for each group, and are never shuffled: only the
best rows of every task are.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from varlake.llm.shared import SLICE, stored

#: Distinct terms of all items of a group together, but for one item that has more.
GROUP_TERMS = 50_000
#: Documents of a trie, and of a leaf.
TREE, LEAF = 4_096, 32
#: Vocabulary terms of the documents of a trie, together.
TREE_TERMS = 4_000_000

_SEPARATORS = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_LETTERS = bytes(32 if byte in _SEPARATORS else byte + 32 if 0x41 <= byte <= 0x5A else byte for byte in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters from U+0080 on, A-Z lowered."""
    return text.translate(_LETTERS).split() if text else []


def with_terms(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """(item_id, terms): the distinct terms of each item that has any."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(one))) for one in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    narrow = items.select(F.col(id_col).alias("item_id"), F.col(text).cast("binary"))
    kind = narrow.schema["item_id"].dataType.simpleString()
    return narrow.mapInArrow(cut, f"item_id {kind}, terms array<binary>").where(F.size("terms") > 0)


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs) of documents with a term: ``n`` terms in all, and how often those of the vocabulary occur."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sizes, ids, tfs = [], [], []
                for value in part.column(1):
                    words = terms(value.as_py())
                    counts = Counter(map(vocabulary.get, words))
                    counts.pop(None, None)
                    sizes.append(len(words))
                    ids.append(list(counts))
                    tfs.append(list(counts.values()))
                lists = [pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
                columns = [part.column(0), pa.array(sizes, pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "ids", "tfs"])

    narrow = docs.select("doc_id", F.col("text").cast("binary"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(cut, f"doc_id {kind}, n long, ids array<int>, tfs array<int>").where("n > 0")


class Tree:
    """The trie of some documents' restricted vectors, with what bounds each subtree.

    ``ids`` and ``tfs`` are the vectors, one array a document, ``m`` the documents' lengths in the score.
    """

    def __init__(self, doc_ids: list, m: np.ndarray, ids: list[np.ndarray], tfs: list[np.ndarray], n_terms: int) -> None:
        sizes = np.array([len(one) for one in ids], "i8")
        flat, counts = np.concatenate(ids), np.concatenate(tfs)
        frequency = np.bincount(flat, minlength=n_terms)
        rank = np.empty(n_terms, "i8")
        rank[np.lexsort((np.arange(n_terms), -frequency))] = np.arange(n_terms)
        inner = np.lexsort((rank[flat], np.repeat(np.arange(len(ids)), sizes)))
        flat, counts = flat[inner], counts[inner]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        paths = rank[flat].astype(">u4")
        spelled = [paths[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        order = sorted(range(len(ids)), key=spelled.__getitem__)
        self.doc_ids, self.m = [doc_ids[at] for at in order], m[order]
        self.starts = np.concatenate([[0], np.cumsum(sizes[order])])
        entry = np.concatenate([np.arange(cuts[at], cuts[at + 1]) for at in order])
        self.terms, self.tfs = flat[entry], counts[entry].astype("i8")
        shared = np.array([0, *(self._shared(at) for at in range(1, len(order)))], "i8")
        self._grow(shared, n_terms)

    def _shared(self, at: int) -> int:
        """How many first terms document ``at`` shares with the one before."""
        a, b, c = self.starts[at - 1 : at + 2]
        n = min(b - a, c - b)
        apart = np.flatnonzero(self.terms[a : a + n] != self.terms[b : b + n])
        return int(apart[0]) if len(apart) else int(n)

    def _grow(self, shared: np.ndarray, n_terms: int) -> None:
        """Nodes are ranges of documents; those of a node's subtrees that are small are bundled into leaves."""
        self.ranges: list[tuple[int, int]] = [(0, len(self.doc_ids))]
        self.children: list[list[int]] = [[]]
        node = 0
        while node < len(self.ranges):
            low, high = self.ranges[node]
            if high - low > LEAF:
                depths = shared[low + 1 : high]
                cuts = [low, *(low + 1 + np.flatnonzero(depths == depths.min())).tolist(), high]
                start = low
                for a, b in zip(cuts, cuts[1:]):
                    if b - start > LEAF and start < a:
                        self._add(node, start, a)
                        start = a
                    if b - start > LEAF:
                        self._add(node, start, b)
                        start = b
                if start < high:
                    self._add(node, start, high)
            node += 1
        below: list = [None] * len(self.ranges)
        self.least_m = np.empty(len(self.ranges), "i8")
        for node in range(len(self.ranges) - 1, -1, -1):
            low, high = self.ranges[node]
            self.least_m[node] = self.m[low:high].min()
            if parts := self.children[node]:
                found, most = (np.concatenate(columns) for columns in zip(*(below[child] for child in parts)))
            else:
                entries = slice(self.starts[low], self.starts[high])
                found, most = self.terms[entries], self.tfs[entries]
            by_term = np.argsort(found, kind="stable")
            found, most = found[by_term], most[by_term]
            first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            below[node] = found[first], np.maximum.reduceat(most, first)
        found, most = (np.concatenate(columns) for columns in zip(*below))
        nodes = np.repeat(np.arange(len(below)), [len(one[0]) for one in below])
        by_term = np.argsort(found, kind="stable")
        self.node_of, self.most_of = nodes[by_term], most[by_term]
        self.places = np.searchsorted(found[by_term], np.arange(n_terms + 1))
        self.slot = np.full(n_terms, -1, "i8")

    def _add(self, parent: int, low: int, high: int) -> None:
        self.children[parent].append(len(self.ranges))
        self.ranges.append((low, high))
        self.children.append([])

    def bounds(self, wanted: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node a score that no document below it passes."""
        most = np.zeros((len(wanted), len(self.ranges)), "i8")
        for row, term in zip(most, wanted):
            part = slice(self.places[term], self.places[term + 1])
            row[self.node_of[part]] = self.most_of[part]
        return weights @ (1_000_000_000 * most // (1000 * most + 8 * self.least_m))

    def search(self, wanted: np.ndarray, weights: np.ndarray, best: list[tuple], k: int) -> None:
        """Enters documents into ``best``, the k best so far as (-score, doc_id is null, doc_id), ascending."""
        bounds = self.bounds(wanted, weights)
        self.slot[wanted] = np.arange(len(wanted))
        todo = [0]
        while todo:
            node = todo.pop()
            least = -best[-1][0] if len(best) == k else 1
            if bounds[node] < least:
                continue
            if self.children[node]:
                todo += sorted(self.children[node], key=bounds.__getitem__)
                continue
            low, high = self.ranges[node]
            first, end = self.starts[low], self.starts[high]
            slots = self.slot[self.terms[first:end]]
            hits = np.flatnonzero(slots >= 0)
            doc = np.searchsorted(self.starts[low : high + 1], first + hits, side="right") - 1
            tfs = self.tfs[first + hits]
            parts = weights[slots[hits]] * (1_000_000_000 * tfs // (1000 * tfs + 8 * self.m[low + doc]))
            scores = np.zeros(high - low, "i8")
            np.add.at(scores, doc, parts)
            for at in np.flatnonzero(scores >= least).tolist():
                doc_id = self.doc_ids[low + at]
                insort(best, (-int(scores[at]), doc_id is None, 0 if doc_id is None else doc_id))
            del best[k:]
        self.slot[wanted] = -1


def searched(vectors: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_all: int, n_terms: int, k: int) -> DataFrame:
    """(key, doc_id, score): each task's k best documents for each query (key, terms, weights)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        doc_ids, m, ids, tfs, held = [], [], [], [], 0

        def done() -> None:
            tree = Tree(doc_ids, np.array(m, "i8"), ids, tfs, n_terms)
            for (_, wanted, weights), found in zip(queries, best):
                tree.search(wanted, weights, found, k)

        for batch in batches:
            for doc_id, n, some_ids, some_tfs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                doc_ids.append(doc_id)
                m.append(10 + 90 * n * n_docs // n_all)
                ids.append(some_ids.values.to_numpy())
                tfs.append(some_tfs.values.to_numpy())
                held += len(ids[-1])
                if len(doc_ids) == TREE or held >= TREE_TERMS:
                    done()
                    doc_ids, m, ids, tfs, held = [], [], [], [], 0
        if doc_ids:
            done()
        rows = [(key, None if null else doc_id, -score) for (key, *_), found in zip(queries, best) for score, null, doc_id in found]
        names = ["key", "doc_id", "score"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[at] for row in rows], kind) for at, kind in enumerate((pa.int64(), arrow_id, pa.int64()))], names=names
        )

    kind = vectors.schema["doc_id"].dataType
    arrow_id = to_arrow_type(kind)
    return vectors.where(F.size("ids") > 0).mapInArrow(search, f"key long, doc_id {kind.simpleString()}, score long")


def best_documents(
    docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", k: int = 10, group_terms: int = GROUP_TERMS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of ``docs`` (doc_id, text) with the highest score for each item.

    Every term of an item counts once: its weight floor(1000 * ln((2N + 2) / (2df + 1))) times (10^9 tf) div (1000 tf + 8m), m
    being 10 + (90 n N) div L, with N documents that have a term, L terms in all, n in the document. Only scores above 0 are
    ranked, ties by ascending doc_id, nulls last. Null and empty texts have no terms. Repeated rows, of documents or items,
    count and are ranked as rows of their own. Without documents, items or common terms the result is empty.
    """
    keyed = stored(with_terms(items, item_id, item_text).withColumn("key", F.monotonically_increasing_id()), "items")
    n_groups = max(1, math.ceil((keyed.agg(F.sum(F.size("terms"))).first()[0] or 0) / group_terms))
    found = None
    for number in range(n_groups):
        group = keyed.where(F.pmod(F.xxhash64("key"), F.lit(n_groups)) == number).select("key", "terms").collect()
        vocabulary = {term: at for at, term in enumerate(sorted({bytes(term) for row in group for term in row["terms"]}))}
        vectors = stored(restricted(docs, vocabulary), "vectors")
        n_docs, n_all = vectors.agg(F.count("*"), F.sum("n")).first()
        counts = vectors.select(F.explode("ids").alias("id")).groupBy("id").count().collect()
        weights = np.zeros(len(vocabulary), "i8")
        for row in counts:
            weights[row["id"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["count"] + 1)))
        queries = []
        for row in group:
            wanted = np.array([vocabulary[bytes(term)] for term in row["terms"]], "i8")
            wanted = wanted[weights[wanted] > 0]
            if len(wanted):
                queries.append((row["key"], wanted, weights[wanted]))
        hits = searched(vectors, queries, n_docs, n_all or 1, len(vocabulary), k)
        found = hits if found is None else found.unionByName(hits)
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(keyed.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
