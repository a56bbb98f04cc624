"""Nearest neighbours by a forest of random-projection trees.

The trees are grown on a bounded sample (SAMPLE vectors, SAMPLE_BYTES at most):
each node parts its vectors by the plane halfway between two of them, until a leaf
has LEAF or fewer. All rows are then routed to their leaves, so the index holds
every row. A query walks all trees through one queue, always on into the branch
whose worst margin on the way is best, until the leaves it took hold the share of
rows it may look at. The vectors of those leaves are compared with the query
exactly, and the best are kept.

The share is calibrated, not fixed: on the sample, where the exact neighbours of
some vectors are known, it is the smallest that finds GOAL of them.

Rows are routed once and stay where they were written: no vector is shuffled. The queries go to them by
broadcast, about QUERIES at a time with the leaves each takes, in one pass over the rows for each such chunk.
A task compares BLOCK rows at once with the queries that took one of their leaves, whatever the size of a leaf,
and hands on only the k best of each query. Queries that repeat an id and its vector are asked once.

Vectors that are NULL, empty, zero or hold NULL, NaN or infinite components take no
part, nor do vectors of another dimension than the most frequent one (the smallest
of several), nor rows with a NULL id. Rows that repeat an id and its vector count
once. Ties go to the smaller id. An empty table has no result; with fewer than k other vectors all
of them are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import written

SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
LEAF = 64
TREES = 4
GOAL = 0.97
PROBES = 100
BLOCK = 2048
ASKED_AT_ONCE = 512
QUERIES = 8192


@dataclass
class Tree:
    """Inner nodes: plane, offset and children; a child below 0 is leaf -1 - child."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64) if len(self.children) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = (np.einsum("ij,ij->i", x[inner], self.planes[node]) > self.offsets[node]).astype(np.int64)
            at[inner] = self.children[node, side]
        return -1 - at


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    planes, offsets, children, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        right = None
        if len(rows) > leaf:
            for _ in range(5):
                a, b = x[rng.choice(rows, 2, replace=False)]
                plane = b - a
                offset = float(plane @ (a + b)) / 2
                right = x[rows] @ plane > offset
                if 0 < right.sum() < len(rows):
                    break
                right = None  # equal vectors: no plane parts them
        if right is None:
            child, leaves = -1 - leaves, leaves + 1
        else:
            child = len(planes)
            planes.append(plane / np.linalg.norm(plane))
            offsets.append(offset / np.linalg.norm(plane))
            children.append([0, 0])
            todo += [(rows[right], child, 1), (rows[~right], child, 0)]
        if parent >= 0:
            children[parent][side] = child
    dim = x.shape[1]
    return Tree(
        np.array(planes).reshape(-1, dim), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), leaves
    )


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = [grow(x, leaf, rng) for _ in range(trees)]
        self.first = np.cumsum([0] + [t.leaves for t in self.trees])

    @property
    def leaves(self) -> int:
        return int(self.first[-1])

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers, one column a tree."""
        return np.stack([t.route(x) + f for t, f in zip(self.trees, self.first)], axis=1)

    def search(self, q: np.ndarray, counts: np.ndarray, budget: float) -> list[int]:
        """Leaves in the order of the shared queue, until they hold ``budget`` rows."""
        margins = [t.planes @ q - t.offsets for t in self.trees]
        queue = [(-np.inf, k, 0 if len(t.children) else -1) for k, t in enumerate(self.trees)]
        heapq.heapify(queue)
        taken, held = [], 0
        while queue and held < budget:
            worst, k, node = heapq.heappop(queue)
            if node < 0:
                leaf = int(self.first[k]) - 1 - node
                taken.append(leaf)
                held += counts[leaf]
                continue
            m = margins[k][node]
            left, right = self.trees[k].children[node]
            # the queue is smallest first: a branch on the far side of a plane costs its distance
            heapq.heappush(queue, (max(worst, -m), k, int(right)))
            heapq.heappush(queue, (max(worst, m), k, int(left)))
        return taken


def calibrated_share(x: np.ndarray, forest: Forest, k: int) -> float:
    """The least share of rows to look at (repeats over the trees counted) that finds GOAL of the k nearest."""
    leaf_of = forest.route(x)
    counts = np.bincount(leaf_of.ravel(), minlength=forest.leaves)
    probes = np.random.default_rng(11).choice(len(x), min(PROBES, len(x)), replace=False)
    needed = []
    for p in probes:
        d = ((x - x[p]) ** 2).sum(axis=1)
        d[p] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        order = forest.search(x[p], counts, np.inf)
        upto = np.empty(forest.leaves)
        upto[order] = np.cumsum(counts[order])
        # a neighbour is found with the first of its leaves
        needed.append(upto[leaf_of[near]].min(axis=1) if len(near) else np.zeros(0))
    needed = np.sort(np.concatenate(needed)) if needed else np.zeros(0)
    if not len(needed):
        return float(TREES)
    return float(needed[min(len(needed) - 1, int(GOAL * len(needed)))]) / len(x)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part, of whatever dimension."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.zeros((0, 1))


def _list_column(x: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).ravel()))


def _once(x: np.ndarray, ids: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without rows that repeat an id and its vector."""
    if len(np.unique(ids)) == len(ids):
        return x, ids, leaves
    keep = list({(i, v.tobytes()): k for k, (i, v) in enumerate(zip(ids.tolist(), x))}.values())
    return x[keep], ids[keep], leaves[keep]


@dataclass
class Asked:
    """Queries of one pass: ids, vectors, and which leaves (rows) each query (column) takes."""

    ids: np.ndarray
    x: np.ndarray
    taken: np.ndarray


class Best:
    """The k nearest rows met so far of every query of a pass, each pair of id and distance once."""

    def __init__(self, asked: Asked, k: int):
        self.asked, self.k = asked, k
        self.norm = (asked.x * asked.x).sum(axis=1)
        self.kth = np.full(len(asked.ids), np.inf)
        self.query, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score = np.zeros(0)

    def add(self, x: np.ndarray, ids: np.ndarray, leaves: np.ndarray) -> None:
        x, ids, leaves = _once(x, ids, leaves)
        norm = (x * x).sum(axis=1)
        # an id with several vectors may hold several places at one distance, of which one counts
        places = self.k + len(ids) - len(np.unique(ids))
        found = [(self.query, self.row, self.score)]
        for at in range(0, len(self.asked.ids), ASKED_AT_ONCE):
            some = slice(at, at + ASKED_AT_ONCE)
            seen = self.asked.taken[leaves[:, 0], some]
            for t in range(1, leaves.shape[1]):
                seen |= self.asked.taken[leaves[:, t], some]
            seen = seen.T & (self.asked.ids[some, None] != ids[None, :])
            if not seen.any():
                continue
            rough = norm[None, :] - 2.0 * (self.asked.x[some] @ x.T)
            rough[~seen] = np.inf
            bound = self.kth[some] ** 2 - self.norm[some]
            if len(ids) > places and not np.isfinite(bound).all():
                bound = np.minimum(bound, np.partition(rough, places - 1, axis=1)[:, places - 1])
            # rounding may order near ties wrongly: everything within its reach is measured exactly
            reach = 1e-9 * (1.0 + norm.max() + self.norm[some])
            i, j = np.nonzero((rough <= (bound + reach)[:, None]) & np.isfinite(rough))
            score = np.sqrt(((x[j] - self.asked.x[some][i]) ** 2).sum(axis=1))
            found.append((i + at, ids[j], score))
        if len(found) > 1:
            self._keep(*(np.concatenate(c) for c in zip(*found)))

    def _keep(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((row, score, query))
        query, row, score = query[order], row[order], score[order]
        new = np.ones(len(query), bool)
        new[1:] = (np.diff(query) != 0) | (np.diff(row) != 0) | (score[1:] != score[:-1])
        query, row, score = query[new], row[new], score[new]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        few = rank < self.k
        self.query, self.row, self.score = query[few], row[few], score[few]
        last = rank == self.k - 1
        self.kth[query[last]] = score[last]


def _search(sent, k: int, block: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = Best(asked, k)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                best.add(_matrix(part.column(1)), part.column(0).to_numpy(), _matrix(part.column(2)))
        for at in range(0, len(best.query), 10_000):
            some = slice(at, at + 10_000)
            columns = [asked.ids[best.query[some]], best.row[some], best.score[some]]
            yield pa.record_batch([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return search


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of what was found for each query, by any of its vectors; the same row counts once."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score").distinct()


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every row where ``is_query`` (over vec_id) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = dims.orderBy(F.desc("n"), "d").limit(1).collect()
    if not top:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n_rows = top[0].d, top[0].n
    rows = rows.filter(F.size("v") == dim)

    bound = min(SAMPLE, max(100, SAMPLE_BYTES // (8 * dim)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(bound).select("v").toArrow()
    x = _matrix(sample["v"])
    forest = Forest(x)
    share = calibrated_share(x, forest, k)
    sent = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                leaves = sent.value.route(_matrix(part.column(1))).astype(np.int32)
                yield pa.record_batch([*part.columns, _list_column(leaves)], names=["vec_id", "v", "leaves"])

    routed = written(rows.mapInArrow(route, "vec_id long, v array<double>, leaves array<int>"), "routed")
    held = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    # one row a leaf of trees grown on a bounded sample
    counts = np.zeros(forest.leaves, np.int64)
    for r in held.collect():
        counts[r.leaf] = r.n
    budget = share * n_rows
    sent_counts = spark.sparkContext.broadcast(counts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                taken = [sent.value.search(q, sent_counts.value, budget) for q in _matrix(part.column(1))]
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in taken])]).astype(np.int32)
                flat = pa.array(np.concatenate([np.zeros(0, np.int64), *taken]).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.record_batch([*part.columns, lists], names=["vec_id", "v", "leaves"])

    # the search of the trees is work, however few bytes the queries have: they are dealt to all tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asking = routed.filter(is_query).select("vec_id", "v").distinct().repartition(tasks)
    asked = written(asking.mapInArrow(ask, "vec_id long, v array<double>, leaves array<int>"), "asked")
    passes = max(1, -(-asked.count() // QUERIES))
    of_pass = F.pmod(F.xxhash64("vec_id", "v"), F.lit(passes))

    def found_in(number: int) -> tuple[DataFrame, Broadcast]:
        # QUERIES rows or about as many, whatever the size of the table
        some = asked.filter(of_pass == number).toArrow()
        taken = np.zeros((forest.leaves, len(some)), bool)
        lens = pc.list_value_length(some["leaves"]).to_numpy()
        taken[pc.list_flatten(some["leaves"]).to_numpy(), np.repeat(np.arange(len(some)), lens)] = True
        chunk = spark.sparkContext.broadcast(Asked(some["vec_id"].to_numpy(), _matrix(some["v"]), taken))
        found = routed.mapInArrow(_search(chunk, k, BLOCK), "query_id long, vec_id long, score double")
        return _ranked(found, k), chunk

    if passes == 1:
        return found_in(0)[0]
    kept = []
    for number in range(passes):
        found, chunk = found_in(number)
        kept.append(written(found.drop("rank"), "found"))
        chunk.destroy()
    return _ranked(reduce(DataFrame.unionByName, kept), k)
