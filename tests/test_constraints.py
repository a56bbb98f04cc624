import random
from collections import Counter

import pytest

from evenkeel.functions.skew import hot_keys
from evenkeel.operators import constraints as cs
from evenkeel.operators.rejects import reject_summary, summary_line

SMALL, LARGE = 100_000, 0


@pytest.fixture(scope="module")
def family(spark):
    """A third of all children under one parent, a third without one."""
    rng = random.Random(3)
    children = []
    for i in range(600):
        parent = 1 if i % 3 == 0 else None if i % 3 == 1 else rng.randrange(100)
        children.append((i, parent, "x" if parent is None else rng.choice("xy")))
    parents = [(p, s) for p in range(0, 100, 2) for s in "xy"] + [(1, "x"), (None, "x")]
    return (
        spark.createDataFrame(children, "id int, parent int, side string"),
        spark.createDataFrame(parents, "code int, side string"),
        children,
        set(parents),
    )


PAIRS = [("parent", "code"), ("side", "side")]


@pytest.mark.parametrize("limit", [SMALL, LARGE])
def test_orphans(family, limit):
    child, parent, children, parents = family
    got = sorted(r.id for r in cs.fk_orphans(child, parent, PAIRS, limit).collect())
    assert got == [i for i, p, s in children if p is not None and (p, s) not in parents]


@pytest.mark.parametrize("limit", [SMALL, LARGE])
@pytest.mark.parametrize("action", ["CASCADE", "SET NULL", "SET DEFAULT", "RESTRICT", "NO ACTION"])
def test_actions(family, action, limit):
    child, parent, children, parents = family
    got = cs.fk_action(child, parent, PAIRS, action, {"parent": "-1", "side": "'d'"}, limit)
    assert got.schema.simpleString() == child.schema.simpleString()

    def hit(r):
        return r[1] is not None and (r[1], r[2]) in parents

    if action == "CASCADE":
        want = [r for r in children if not hit(r)]
    elif action in ("RESTRICT", "NO ACTION"):
        want = [r for r in children if hit(r)]
    else:
        freed = (None, None) if action == "SET NULL" else (-1, "d")
        want = [(r[0], *freed) if hit(r) else r for r in children]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_unknown_action(family):
    with pytest.raises(ValueError, match="unknown referential action"):
        cs.fk_action(family[0], family[1], PAIRS, "EXPLODE")


def test_prune_reach(spark, family):
    child, _, children, _ = family
    deleted = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'a'), (3, 'b') AS t(code, kind)")
    got = {
        r.kind: r.rows_reached
        for r in cs.prune_reach(deleted, child, [("parent", "code")], "fk", "CASCADE", ["kind"]).collect()
    }
    n = Counter(p for _, p, _ in children)
    assert got == {"a": n[1] + n[2], "b": n[3]}


def test_hot_parents_go_around_the_shuffle(spark, family):
    child, parent, children, parents = family
    for how in ("left_semi", "left_anti"):
        ids = sorted(r.id for r in cs.matching(child, parent, PAIRS, how, LARGE, hot_rows=50).collect())
        hit = {i for i, p, s in children if p is not None and (p, s) in parents}
        assert ids == [r[0] for r in children if (r[0] in hit) == (how == "left_semi")]
    met = cs.matching(child, parent, PAIRS, "left", LARGE, hot_rows=50)
    got = {r.id: r.matched for r in met.collect()}
    assert got == {i: p is not None and (p, s) in parents for i, p, s in children}
    assert [tuple(r) for r in hot_keys(child.dropna(), ["parent", "side"], 50).collect()] in (
        [(1, "x"), (1, "y")],
        [(1, "y"), (1, "x")],
    )
    assert hot_keys(child.dropna(), ["parent", "side"], 500) is None
    plan = met._jdf.queryExecution().toString()
    assert plan.count("BroadcastHashJoin") >= 4


def test_not_null_unique_check(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'a', 1), (1, 'a', NULL), (2, NULL, -1), (2, NULL, 5) AS t(id, s, n)")
    assert {tuple(r) for r in cs.not_null_violations(rows, ["id", "s", "n"]).collect()} == {("s", 2), ("n", 1)}
    assert [tuple(r) for r in cs.unique_violations(rows, ["id", "s"]).collect()] == [(1, "a", 2)]
    assert cs.unique_violations(rows, ["id"], where="n > 0").isEmpty()
    assert [r.n for r in cs.check_violations(rows, "n >= 0").collect()] == [-1]


def test_generated(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'a', 'A'), (2, 'b', 'b'), (3, NULL, NULL), (4, 'd', NULL) AS t(id, s, u)")
    got = {tuple(r) for r in cs.generated_mismatches(rows, "u", "upper(s)", ["id"]).collect()}
    assert got == {(2, "b", "B"), (4, None, "D")}


@pytest.mark.parametrize("limit", [SMALL, LARGE])
def test_identity_fill(spark, limit):
    rng = random.Random(9)
    keys = rng.sample(range(10**6), 3000)
    rows = spark.createDataFrame([(k, str(k)) for k in keys], "k bigint, s string").repartition(7)
    got = cs.identity_fill(rows, "id", ["k"], 500, broadcast_rows=limit)
    assert {r.k: r.id for r in got.collect()} == {k: 501 + i for i, k in enumerate(sorted(keys))}
    by_text = cs.identity_fill(rows, "id", ["s"], 0, broadcast_rows=limit)
    assert {r.s: r.id for r in by_text.collect()} == {s: 1 + i for i, s in enumerate(sorted(map(str, keys)))}


def test_reject_summary(spark):
    rejects = spark.createDataFrame(
        [
            ("CREATE VIEW", "view a", 1),
            ("CREATE TABLE", "table b", 2),
            ("CREATE VIEW", "view c", 3),
            ("CREATE VIEW", "view a", 4),
            ("CREATE TABLE", "table b", 5),
        ],
        "kind string, detail string, seq int",
    )
    summary = reject_summary(rejects)
    assert [tuple(r) for r in summary.collect()] == [("CREATE VIEW", 2, "view a", 1), ("CREATE TABLE", 1, "table b", 2)]
    assert summary_line(summary) == "2 CREATE VIEW, 1 CREATE TABLE (first: view a)"
    assert summary_line(reject_summary(rejects.filter("false"))) == ""
