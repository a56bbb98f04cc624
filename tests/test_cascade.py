"""Deletes that reach through several foreign keys, against rounds in plain Python."""

import random

import pytest

from evenkeel.operators.cascade import Cascade
from evenkeel.operators.spec import ForeignKey, TableContract


def link(name, child_column, parent, action):
    return ForeignKey(name, (child_column,), parent, ("id",), action)


def brute(rows, links, deleted):
    """rows: table to {id: {column: value}}; links: (child, fk)."""
    gone = {t: set(ids) for t, ids in deleted.items()}
    while True:
        new = [
            (child, i)
            for child, fk in links
            if fk.on_delete == "CASCADE"
            for i, r in rows[child].items()
            if r[fk.columns[0]] in gone.get(fk.parent, ()) and i not in gone.get(child, ())
        ]
        if not new:
            break
        for child, i in new:
            gone.setdefault(child, set()).add(i)
    reach = {}
    for child, fk in links:
        hit = [i for i, r in rows[child].items() if r[fk.columns[0]] in gone.get(fk.parent, ())]
        if fk.on_delete not in ("CASCADE", "RESTRICT"):
            hit = [i for i in hit if i not in gone.get(child, ())]
        if hit:
            reach[child, fk.name, fk.on_delete] = len(hit)
    return gone, reach


CONTRACTS = [
    TableContract("a", (), ("id",), foreign_keys=(link("a_self", "up", "a", "CASCADE"),)),
    TableContract("b", (), ("id",), foreign_keys=(link("b_a", "up", "a", "CASCADE"), link("b_c", "other", "c", "SET NULL"))),
    TableContract("c", (), ("id",), foreign_keys=(link("c_b", "up", "b", "CASCADE"), link("c_a", "other", "a", "NO ACTION"))),
    TableContract("d", (), ("id",), foreign_keys=(link("d_c", "up", "c", "RESTRICT"), link("d_a", "other", "a", "SET DEFAULT"))),
]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cascades_as_by_hand(spark, seed):
    rng = random.Random(seed)
    rows = {t: {i: {"up": rng.choice([None, *range(40)]), "other": rng.choice([None, *range(40)])} for i in range(40)} for t in "abcd"}
    tables = {
        t: spark.createDataFrame([(i, r["up"], r["other"]) for i, r in some.items()], "id long, up long, other long")
        for t, some in rows.items()
    }
    cascade = Cascade(tables, CONTRACTS)
    start = spark.createDataFrame([(3,), (4,), (None,), (3,)], "id long")
    gone, reach = brute(rows, cascade.links, {"a": {3, 4}})
    found = Cascade(tables, CONTRACTS).run({"a": start})
    assert {t: sorted(r.id for r in f.collect()) for t, f in found.items()} == {t: sorted(ids) for t, ids in gone.items()}
    got = cascade.reach({"a": start})
    assert {(r.table_name, r.constraint_name, r.action): r.rows_reached for r in got.collect()} == reach
    assert cascade.allowed(got) == (not any(k[2] in ("RESTRICT", "NO ACTION") for k in reach))


def test_a_chain_is_followed_to_its_end(spark):
    table = spark.range(12).selectExpr("id", "id - 1 AS up", "CAST(NULL AS BIGINT) AS other")
    cascade = Cascade({"a": table}, CONTRACTS[:1])
    assert cascade.run({"a": spark.sql("SELECT 4L AS id")})["a"].count() == 8


def test_nothing_deleted_and_no_key(spark):
    empty = spark.createDataFrame([], "id long, up long, other long")
    cascade = Cascade({"a": empty, "b": empty}, CONTRACTS[:2])
    assert cascade.reach({"a": empty}).collect() == []
    loose = [TableContract("a", (), ("id",)), TableContract("x", (), (), foreign_keys=(link("x_a", "up", "a", "CASCADE"),))]
    with pytest.raises(ValueError, match="primary key"):
        Cascade({"a": empty, "x": empty}, loose).reach({"a": spark.sql("SELECT 1L AS id")})
