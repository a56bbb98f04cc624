import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import ann, queries
from evenkeel.llm.ann import nearest

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, score string, leaf string, rank string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], SCHEMA)


def exact(rows, asked, k):
    usable = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for q in asked:
        d = sorted((float(np.sqrt(((v - usable[q]) ** 2).sum())), i) for i, v in usable.items() if i != q)
        out[q] = d[:k]
    return out


def found(df, k=10):
    out = {}
    for r in sorted(nearest(df, F.col("vec_id") % 10 == 0, k).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_few_vectors_are_all_found(spark):
    rows = [(i, [float(i), 1.0]) for i in range(7)]
    assert found(vectors(spark, rows)) == {0: [(float(i), i) for i in range(1, 7)]}


def test_a_hot_vector_with_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERIES", 10)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)]
    rows += [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(200, 400)]
    got, expected = found(vectors(spark, rows)), exact(rows, range(0, 400, 10), 10)
    assert {q: got[q] for q in range(0, 200, 10)} == {q: expected[q] for q in range(0, 200, 10)}


def test_what_takes_no_part(spark):
    good = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    bad = [(3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0])]
    bad += [(9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    got = found(vectors(spark, good + bad))
    assert got == {0: [(1.0, 2), (float(np.sqrt(2.0)), 1)]}


def test_an_id_with_several_vectors_asks_and_is_found_with_each(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 2)
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0])]
    rows += [(10, [5.0, 5.0]), (20, [5.0, 4.0]), (30, [4.0, 5.0])]
    expected = {}
    for q in (0, 10, 20, 30):
        d = {(float(np.hypot(*np.subtract(v, w))), i) for j, w in rows if j == q for i, v in rows if i != q}
        expected[q] = sorted(d)[:4]
    got = found(vectors(spark, rows), 4)
    assert {q: [i for _, i in near] for q, near in got.items()} == {q: [i for _, i in n] for q, n in expected.items()}


@pytest.mark.parametrize("seed", range(6))
def test_the_best_of_a_pass_are_those_of_brute_force(seed, monkeypatch):
    monkeypatch.setattr(ann, "ASKED_AT_ONCE", 3)
    rng = np.random.default_rng(seed)
    # few different components and ids: ties, repeated rows, and ids with several vectors at one distance
    x = rng.integers(-2, 3, (120, 3)).astype(float)
    ids, leaves = rng.integers(0, 60, 120), rng.integers(0, 5, (120, 2))
    asked = ann.Asked(rng.integers(0, 60, 8), rng.integers(-2, 3, (8, 3)).astype(float), rng.random((5, 8)) < 0.5)
    best = ann.Best(asked, 4)
    for at in range(0, 120, 25):
        best.add(x[at : at + 25], ids[at : at + 25], leaves[at : at + 25])
    got = {q: [] for q in range(8)}
    for q, i, d in zip(best.query.tolist(), best.row.tolist(), best.score.tolist()):
        got[q].append((d, i))
    for q in range(8):
        near = set()
        for v, i, own in zip(x, ids.tolist(), leaves):
            if asked.taken[own, q].any() and i != asked.ids[q]:
                near.add((float(np.sqrt(((v - asked.x[q]) ** 2).sum())), i))
        assert got[q] == sorted(near)[:4]


def test_no_vector_is_shuffled(spark):
    plan = nearest(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "Join" not in text and "Generate" not in text
    shuffled = [line for line in text.splitlines() if "Exchange" in line]
    assert shuffled and all("hashpartitioning(query_id" in line for line in shuffled)


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0])]])
def test_nothing_to_find(spark, rows):
    assert found(vectors(spark, rows)) == {}


def test_query_has_the_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    expected = exact(rows, [i for i, _ in rows if i % 100 == 0], 10)
    got = {}
    for r in queries.QUERIES["op7_ann"].run(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = sum(i in got[q] for q, near in expected.items() for _, i in near)
    assert hits >= 0.9 * 10 * len(expected)
    for q, near in expected.items():
        assert len(got[q]) == 10
        for d, i in near:
            assert got[q].get(i, d) == d
