import hashlib
import math
import random

import numpy as np
import pytest
from oracle import connect, spark_rows, sql_rows

from evenkeel.llm import centroids, queries
from evenkeel.llm.centroids import cluster_vectors

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, points string, id string"


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-(2**27), min(2**27, math.floor(scale * x))) for x in v], v) for i, v in kept]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v, w) for i, w, v in kept if i is not None)
    at = [w for _, _, w in named[:k]]
    if not at:
        return []

    def nearest(w):
        return min((sum((a - b) ** 2 for a, b in zip(w, c)), n) for n, c in enumerate(at))[::-1]

    for turn in range(rounds + 1):
        found = [nearest(w) for _, w, _ in kept]
        if turn < rounds:
            for n in range(len(at)):
                mine = [w for (_, w, _), (c, _) in zip(kept, found) if c == n]
                if mine:
                    at[n] = [sum(x) // len(mine) for x in zip(*mine)]
    total = [sum(d for c, d in found if c == n) for n in range(len(at))]

    def long(x):
        return x if x < 2**63 else None

    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, long(total[c]), long(sum(total)), name[c]) for (i, _, _), (c, d) in zip(kept, found)), key=str)


def clustered(df, **options):
    rows = cluster_vectors(df, **options).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows), key=str)


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def clouds(seed, n, dims, parts):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 3, (parts, dims))
    return [(int(i), (middles[i % parts] + rng.normal(0, 0.7, dims)).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize("seed, block, rounds", [(1, 4096, 3), (2, 37, 6), (3, 5, 1)])
def test_as_plain_rounds(spark, monkeypatch, seed, block, rounds):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = clouds(seed, 400, 8, 6)
    got = clustered(frame_of(spark, rows), clusters=7, rounds=rounds, dims=8)
    assert got == brute(rows, 7, rounds, 8)


def test_only_expired_vectors_are_compared_again(spark):
    work = []
    rows = clouds(4, 2000, 8, 5)
    clustered(frame_of(spark, rows), clusters=5, rounds=6, dims=8, work=work)
    assert work[0] == 2000 and len(work) == 7 and work[-1] < 200 and sum(work[1:]) < 4 * 2000


def test_ties_equal_vectors_and_one_cluster(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]
    for k in (1, 2, 5, 16):
        assert clustered(frame_of(spark, rows), clusters=k, dims=2) == brute(rows, k, dims=2)
    same = [(i, [1.0, 2.0]) for i in range(300)]
    assert clustered(frame_of(spark, same), clusters=4, dims=2) == brute(same, 4, dims=2)


def test_odd_vectors_ids_and_sizes(spark):
    rng = random.Random(5)
    good = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(10)]
    odd = [(11, None), (12, []), (13, [1.0, 2.0]), (14, [1.0, None, 2.0]), (15, [math.nan, 1.0, 1.0]), (16, [math.inf, 1.0, 1.0]), (17, [1.0] * 4)]
    more = [(None, [0.5, 0.5, 0.5]), (3, good[3][1]), (3, [0.1, 0.1, 0.1]), (18, [0.0, 0.0, 0.0])]
    large = [(20, [1e300, -1e300, 0.0]), (21, [-1e300, 1e300, 3e6]), (22, [2.0**21, 0.0, 0.0])]
    for rows in (good + odd + more, good[:2], good + large, [(None, [1.0, 1.0, 1.0])], odd):
        assert clustered(frame_of(spark, rows), clusters=4, dims=3) == brute(rows, 4, dims=3)
    assert clustered(frame_of(spark, good).limit(0), clusters=4, dims=3) == []


def test_sums_that_do_not_fit_are_null(spark):
    far = [(i, [1e300 * (-1) ** i] * 64) for i in range(40)]
    got = clustered(frame_of(spark, far), clusters=1)
    assert got == brute(far, 1) and {r[4] for r in got} == {None}


def test_query_against_sql_and_by_hand(spark):
    df = queries.QUERIES["op12_centroids"].run(spark, SF)
    columns, expected = sql_rows(connect(SF), queries.QUERIES["op12_centroids"].sql)
    assert sorted(df.columns) == columns and spark_rows(df) == expected
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()]
    assert sorted(got, key=str) == brute(rows)
