"""Centroid clustering that rescans only the vectors whose bounds have expired.

Vectors are turned into whole numbers and kept in blocks of BLOCK, one row of a table
each. Beside its vectors a block keeps one heap for each cluster: the gap of every
member, its lower bound to any other centroid less its upper bound to its own, plus
the drift the cluster had accumulated when the member was pushed. When centroids move,
a gap closes by at most the drift of the own centroid and the largest drift of another,
so it is enough to add these to the cluster's accumulated drift: members whose key that
sum has passed are on top of the heap. They are popped, compared with all centroids
exactly and pushed again; nobody else is looked at. A heap is stored as a run in
ascending order, so that popping all expired members is one binary search and their
pushes are one merge.

A pass writes the blocks with their heaps to the shared folder and, for each block,
what its popped members change in the clusters' sums. Only these numbers (clusters times
dimensions) and the centroids reach the driver. A lost executor costs the blocks
of its tasks in the pass that is running.

Distances and sums are whole numbers and exact; bounds are doubles, rounded towards
expiry. Ties go to the smaller cluster. Vectors of another length, or with NULL, NaN or
infinite components, take no part and are not returned. Whole components are held to
-LARGEST to LARGEST, so that distances fit; a sum of distances that does not fit a long
is NULL. Rows with a NULL id are clustered but never start a centroid; repeated rows are
vectors of their own. With fewer vectors than clusters there are as many
clusters as vectors with an id; an empty table, or one without ids, gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import written
from evenkeel.session import forget

#: Vectors of a block: 1 MB at 64 dimensions.
BLOCK = 4096
#: Largest whole component; the squared distance of two vectors of 64 of them still fits a long.
LARGEST = 2**27
#: Up to this size sums of products are exact in doubles.
_SMALL = 2**22
#: Doubles are off by far less; bounds are moved by this share to the safe side.
_SAFE = 1e-9

_STATE = "ids array<long>, points binary, members binary, keys binary, ends array<int>, change array<long>, popped long"


@dataclass
class Centroids:
    """Where the centroids are, and how far each has drifted since the first pass."""

    at: np.ndarray
    counts: list[int] = field(default_factory=list)
    sums: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        k, dims = self.at.shape
        self.drifted = np.zeros(k)
        self.counts = self.counts or [0] * k
        self.sums = self.sums or [[0] * dims for _ in range(k)]

    def add(self, change: dict[int, int]) -> None:
        """Add what a pass changed: for each cluster its count, then its sums."""
        width = self.at.shape[1] + 1
        for place, value in change.items():
            k, d = divmod(place, width)
            if d:
                self.sums[k][d - 1] += value
            else:
                self.counts[k] += value

    def move(self) -> None:
        """Every centroid to the floor of its members' mean; those without members stay."""
        old = self.at.copy()
        for k, n in enumerate(self.counts):
            if n:
                self.at[k] = [s // n for s in self.sums[k]]
        drift = np.sqrt(((self.at - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + _SAFE)
        for k in range(len(drift)):
            others = np.delete(drift, k)
            self.drifted[k] = (self.drifted[k] + drift[k] + (others.max() if len(others) else 0.0)) * (1 + _SAFE)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.at.tolist()]


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres, exact."""
    if not len(points):
        return np.zeros((0, len(centres)), np.int64)
    if max(abs(points).max(), abs(centres).max()) <= _SMALL:
        p, c = points.astype(np.float64), centres.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1)


def scanned(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, and the gap to the second nearest, rounded down."""
    d = distances(points, centres)
    nearest = d.argmin(axis=1)  # the first of equal ones
    if len(centres) == 1:
        return nearest, np.full(len(points), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return nearest, two[:, 1] * (1 - _SAFE) - two[:, 0] * (1 + _SAFE)


class Heaps:
    """For each cluster the members of a block, by the accumulated drift at which they expire."""

    def __init__(self, members: list[np.ndarray], keys: list[np.ndarray]):
        self.members, self.keys = members, keys

    @classmethod
    def empty(cls, k: int) -> Heaps:
        return cls([np.zeros(0, np.int32)] * k, [np.zeros(0)] * k)

    @classmethod
    def stored(cls, members: bytes, keys: bytes, ends: list[int]) -> Heaps:
        cuts = ends[:-1]
        return cls(np.split(np.frombuffer(members, np.int32), cuts), np.split(np.frombuffer(keys, np.float64), cuts))

    def pop(self, drifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members whose gap has expired, and the cluster each was in."""
        gone = []
        for k, most in enumerate(drifted):
            n = int(np.searchsorted(self.keys[k], most, "right"))
            gone.append(self.members[k][:n])
            self.members[k], self.keys[k] = self.members[k][n:], self.keys[k][n:]
        return np.concatenate(gone), np.repeat(np.arange(len(gone)), [len(g) for g in gone])

    def push(self, members: np.ndarray, clusters: np.ndarray, gaps: np.ndarray, drifted: np.ndarray) -> None:
        for k in np.unique(clusters).tolist():
            mine = clusters == k
            keys = np.concatenate([self.keys[k], gaps[mine] + drifted[k]])
            order = np.argsort(keys, kind="stable")
            self.keys[k] = keys[order]
            self.members[k] = np.concatenate([self.members[k], members[mine].astype(np.int32)])[order]

    def columns(self) -> tuple[bytes, bytes, list[int]]:
        ends = np.cumsum([len(m) for m in self.members]).tolist()
        return np.concatenate(self.members).tobytes(), np.concatenate(self.keys).tobytes(), ends


def rescan(points: np.ndarray, heaps: Heaps, centroids: Centroids, found: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Compare the popped members with all centroids and push them; what that changes in counts and sums."""
    k, dims = centroids.at.shape
    nearest, gaps = scanned(points[found], centroids.at)
    heaps.push(found, nearest, gaps, centroids.drifted)
    change = np.zeros((k, dims + 1), np.int64)
    moved = nearest != before
    with_one = np.concatenate([np.ones((len(found), 1), np.int64), points[found]], axis=1)
    np.add.at(change, nearest[moved], with_one[moved])
    left = moved & (before >= 0)
    np.subtract.at(change, before[left], with_one[left])
    return change.ravel()


def _row(ids: pa.Array, points: np.ndarray, heaps: Heaps, change: np.ndarray, popped: int) -> pa.RecordBatch:
    members, keys, ends = heaps.columns()
    columns = [
        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        pa.array([points.astype(np.int32).tobytes()], pa.binary()),
        pa.array([members], pa.binary()),
        pa.array([keys], pa.binary()),
        pa.array([ends], pa.list_(pa.int32())),
        pa.array([change.tolist()], pa.list_(pa.int64())),
        pa.array([popped], pa.int64()),
    ]
    return pa.record_batch(columns, names="ids points members keys ends change popped".split())


def _first_pass(centroids: Centroids, scale: int):
    """Vectors into blocks, each compared with all centroids."""
    k, dims = centroids.at.shape

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            ids, vectors = (c.combine_chunks() for c in block.columns)
            points = whole(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
            heaps = Heaps.empty(k)
            every = np.arange(len(points))
            change = rescan(points, heaps, centroids, every, np.full(len(points), -1))
            yield _row(ids, points, heaps, change, len(points))

    return scan


def _opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, Heaps]]:
    for row in range(batch.num_rows):
        ids = batch.column("ids").slice(row, 1).flatten()
        points = np.frombuffer(batch.column("points")[row].as_py(), np.int32).reshape(-1, dims).astype(np.int64)
        heap = [batch.column(c)[row].as_py() for c in ("members", "keys", "ends")]
        yield ids, points, Heaps.stored(*heap)


def _next_pass(centroids: Centroids):
    """Blocks with the members whose gap has expired compared again."""
    dims = centroids.at.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, heaps in _opened(batch, dims):
                found, before = heaps.pop(centroids.drifted)
                change = rescan(points, heaps, centroids, found, before)
                yield _row(ids, points, heaps, change, len(found))

    return scan


def _results(centroids: Centroids, id_name: str):
    """id, cluster and exact squared distance of every vector, after the blocks' last pass."""
    dims = centroids.at.shape[1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, heaps in _opened(batch, dims):
                cluster = np.zeros(len(points), np.int32)
                for k, members in enumerate(heaps.members):
                    cluster[members] = k
                distance = ((points - centroids.at[cluster]) ** 2).sum(axis=1)
                yield pa.record_batch([ids, pa.array(cluster), pa.array(distance)], names=[id_name, "cluster", "distance"])

    return read


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held to the largest components there may be."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -LARGEST, LARGEST).astype(np.int64)


def _usable(vector: Column, dims: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & ~bad


def cluster_vectors(
    vectors: DataFrame,
    *,
    clusters: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = 64,
    seed: int = 1,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    work: list[int] | None = None,
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector.

    ``work``, if given, gets the number of vectors every pass compared with all centroids.
    """
    spark = vectors.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector"))
    kept = kept.filter(_usable(F.col("vector"), dims))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.filter("id IS NOT NULL").select("vector", digest.alias("digest"))
    chosen = first.orderBy("digest", "vector").limit(clusters).collect()
    names = f"`{id_col}` long, cluster int, distance long"
    if not chosen:
        extra = "cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], f"{names}, {extra}")
    centroids = Centroids(whole(np.array([r.vector for r in chosen]), scale))

    state = written(kept.mapInArrow(_first_pass(centroids, scale), _STATE), "clusters")
    for _ in range(rounds):
        _sum_up(state, centroids, work)
        centroids.move()
        old, state = state, written(state.mapInArrow(_next_pass(centroids), _STATE), "clusters")
        forget(old)
    _sum_up(state, centroids, work)
    placed = written(state.mapInArrow(_results(centroids, id_col), names), "clustered")
    forget(state)

    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    sums = {r.cluster: int(r.total) for r in placed.groupBy("cluster").agg(total).collect()}
    fits = {k: v if v < 2**63 else None for k, v in [*sums.items(), (None, sum(sums.values()))]}
    facts = [(k, fits[k], fits[None], name) for k, name in enumerate(centroids.digests()) if k in sums]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _sum_up(state: DataFrame, centroids: Centroids, work: list[int] | None) -> None:
    """Add up what a pass changed: clusters times (dimensions + 1) numbers, summed by Spark."""
    numbers = state.select(F.posexplode(F.concat("change", F.array("popped"))).alias("place", "value"))
    found = {r.place: r.value for r in numbers.groupBy("place").agg(F.sum("value").alias("value")).collect()}
    popped = found.pop(centroids.at.shape[0] * (centroids.at.shape[1] + 1), 0)
    if work is not None:
        work.append(popped)
    centroids.add(found)
