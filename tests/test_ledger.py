from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import ledger as lg
from evenkeel.sources.ledger_store import Item, LedgerStore
from evenkeel.sources.manifest import scan_manifest

AT = datetime(2024, 1, 1)


def items(spark, *rows):
    return spark.createDataFrame(
        rows, "type string, version string, name string, namespace string, checksum string"
    )


def outcomes(spark, *rows):
    return lg.results(items(spark, *[r[:5] for r in rows]), F.lit(5), F.lit(True)) if all(
        len(r) == 5 for r in rows
    ) else lg.results(
        spark.createDataFrame(
            rows, "type string, version string, name string, namespace string, checksum string, ok boolean"
        ),
        F.lit(5),
        F.col("ok"),
    )


@pytest.fixture
def store(spark, tmp_path):
    return LedgerStore(spark, str(tmp_path / "ledger"))


def names(df):
    return sorted(r.name for r in df.collect())


def test_reading_does_not_create(store, tmp_path):
    assert store.read().count() == 0
    assert not (tmp_path / "ledger").exists()


def test_append_gives_ids_time_and_user(spark, store):
    store.append(outcomes(spark, ("ops", "1", "a", None, "c1"), ("logic", None, "v", None, "c2")), AT, "me")
    store.append(outcomes(spark, ("data", "1", "b", None, "c3", False)), AT, "me")
    rows = lg.history(store.read()).collect()
    assert [r.id for r in rows] == [1, 2, 3]
    assert {r.applied_by for r in rows} == {"me"} and {r.applied_at for r in rows} == {AT}
    assert [r.success for r in rows] == [True, True, False]


def test_skip_change_drift_failure(spark, store):
    store.append(
        outcomes(
            spark,
            ("ops", "20260828_001", "a", None, "c1", True),
            ("data", "20260828_001", "b", None, "c2", False),
            ("logic", None, "v", None, "c3", True),
            ("schema", None, "t", "public", "c4", True),
        ),
        AT,
    )
    now = items(
        spark,
        ("ops", "20260828_001", "a", None, "edited"),
        ("ops", "20260828_002", "new", None, "c"),
        ("data", "20260828_001", "b", None, "c2"),
        ("logic", None, "v", None, "edited"),
        ("schema", None, "t", "public", "c4"),
        ("schema", None, "t", "other", "c4"),
        ("permissions", None, "g", None, "c"),
        ("reference", None, "r", None, "c"),
    )
    ledger = store.read()
    state = {(r.type, r.version, r.name, r.namespace): r.status for r in lg.status(now, ledger).collect()}
    assert state == {
        ("ops", "20260828_001", "a", None): "drift",
        ("ops", "20260828_002", "new", None): "pending",
        ("data", "20260828_001", "b", None): "pending",  # a failure does not count, nor does the other type
        ("logic", None, "v", None): "changed",
        ("schema", None, "t", "public"): "applied",
        ("schema", None, "t", "other"): "pending",
        ("permissions", None, "g", None): "pending",
        ("reference", None, "r", None): "diffed",
    }
    assert names(lg.pending(now, ledger)) == ["b", "new"]
    assert names(lg.changed(now, ledger)) == ["g", "t", "v"]
    assert names(lg.drifted(now, ledger)) == ["a"]


def test_latest_takes_time_then_id(spark):
    rows = [
        (1, None, "v", "logic", None, "old", AT, 1, "u", True),
        (2, None, "v", "logic", None, "new", AT, 1, "u", True),
        (3, None, "v", "logic", None, "failed", datetime(2025, 1, 1), 1, "u", False),
        (4, None, "w", "logic", None, "late", datetime(2024, 2, 1), 1, "u", True),
        (5, None, "w", "logic", None, "early", AT, 1, "u", True),
    ]
    got = {r.name: r.checksum for r in lg.latest(spark.createDataFrame(rows, lg.LEDGER)).collect()}
    assert got == {"v": "new", "w": "late"}


def test_baseline_limit_holds_for_versions_only_and_compares_text(spark):
    now = items(
        spark,
        ("ops", "10", "a", None, "c"),
        ("ops", "9", "b", None, "c"),
        ("data", "2", "c", None, "c"),
        ("logic", None, "v", None, "c"),
        ("reference", None, "r", None, "c"),
    )
    assert names(lg.baseline(now, "2")) == ["a", "c", "v"]
    assert names(lg.baseline(now)) == ["a", "b", "c", "v"]
    assert {(r.execution_ms, r.success) for r in lg.baseline(now).collect()} == {(0, True)}


def test_adopt_and_work_order(spark):
    now = items(
        spark,
        ("data", "1", "d", None, "c"),
        ("reference", None, "r", None, "c"),
        ("permissions", None, "g", None, "c"),
        ("logic", None, "v", None, "c"),
        ("schema", None, "b", "alpha", "c"),
        ("schema", None, "a", "beta", "c"),
        ("ops", "2", "x", None, "c"),
        ("ops", "10", "y", None, "c"),
    )
    assert [r.name for r in lg.work_list(now).collect()] == ["y", "x", "b", "a", "v", "g", "r", "d"]
    actions = {r.name: r.action for r in lg.adopt_actions(now).collect()}
    assert actions == {
        "x": "baseline",
        "y": "baseline",
        "d": "baseline",
        "a": "diff",
        "b": "diff",
        "v": "run",
        "g": "run",
        "r": "reconcile",
    }


def test_integrity(spark):
    def row(i, version, type_, ok=True):
        return (i, version, "n", type_, None, "c", AT, 1, "u", ok)

    rows = [row(1, "1", "ops"), row(2, "1", "ops"), row(3, "1", "data"), row(4, "2", "ops", False), row(5, "2", "ops")]
    rows += [row(6, None, "logic"), row(7, None, "logic"), row(8, None, "mystery")]
    got = {tuple(r) for r in lg.integrity(spark.createDataFrame(rows, lg.LEDGER)).collect()}
    assert got == {("one success per version", "ops", "1", 2), ("known type", "mystery", None, 1)}


def test_run_stops_at_failure_and_tries_again(spark, store):
    log, broken = [], [True]

    def fails():
        log.append("b")
        if broken[0]:
            raise RuntimeError("no such column")

    work = [
        Item("data", "last", "c4", lambda: log.append("c"), version="1"),
        Item("data", "second", "c3", fails, version="0"),
        Item("ops", "first", "c1", lambda: log.append("a"), version="1"),
        Item("logic", "view", "c2", lambda: log.append("v")),
    ]
    report = store.run(work)
    assert log == ["a", "v", "b"] and report.failed.name == "second"
    broken[0] = False
    report = store.run(work)
    assert log == ["a", "v", "b", "b", "c"] and report.failed is None
    assert sorted(i.name for i in report.skipped) == ["first", "view"]
    assert store.run(work).applied == []
    work[3] = Item("logic", "view", "edited", lambda: log.append("v2"))
    assert [i.name for i in store.run(work).applied] == ["view"]
    assert store.read().filter("NOT success").count() == 1
    assert lg.integrity(store.read()).isEmpty()


def test_adopt_baselines_run_once_items_and_runs_the_others(spark, store):
    log = []
    work = [
        Item("ops", "first", "c1", lambda: log.append("ops"), version="1"),
        Item("data", "fill", "c2", lambda: log.append("data"), version="1"),
        Item("logic", "view", "c3", lambda: log.append("logic")),
        Item("permissions", "roles", "c4", lambda: log.append("permissions")),
        Item("reference", "rows", "c5", lambda: log.append("rows")),
    ]
    report = store.adopt(work)
    assert log == ["logic", "permissions", "rows"]
    assert sorted(i.name for i in report.skipped) == ["fill", "first"]
    assert [i.name for i in store.run(work).applied] == ["rows"]
    assert store.read().filter("type = 'reference'").isEmpty() and lg.integrity(store.read()).isEmpty()


def test_backfill_once(spark, store):
    rows = spark.sql("SELECT * FROM VALUES (1, CAST(NULL AS STRING)), (2, 'CA') AS t(id, country)")
    filled = lg.backfill_once(rows, {"country": "'US'"}, store.read(), "1")
    assert {r.id: r.country for r in filled.collect()} == {1: "US", 2: "CA"}
    store.append(outcomes(spark, ("data", "1", "fill", None, "c")))
    assert lg.backfill_once(rows, {"country": "'US'"}, store.read(), "1").filter("country IS NULL").count() == 1


def test_totals(spark):
    rows = spark.sql("SELECT * FROM VALUES (TRUE), (TRUE), (FALSE), (CAST(NULL AS BOOLEAN)) AS t(success)")
    assert tuple(lg.totals(rows).first()) == (2, 1, 1)


def write(root, **files):
    for path, text in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)


def test_folder_layout(spark, tmp_path):
    write(
        tmp_path,
        **{
            "ops/20260411_001__create_ext.sql": "a",
            "ops/bad_name.sql": "x",
            "schema/public/users.sql": "b",
            "schema/materialized/rpt.sql": "c",
            "schema/stray.sql": "x",
            "logic/view_summary.sql": "d",
            "logic/old/view.sql": "x",
            "permissions/roles.sql": "e",
            "permissions/readme.txt": "x",
            "reference/carrier.sql": "f",
            "data/20260412__fill_it.sql": "abc",
            "other/thing.sql": "x",
        },
    )
    got = {r.filename: (r.type, r.version, r.name, r.namespace) for r in scan_manifest(spark, str(tmp_path)).collect()}
    assert got == {
        "ops/20260411_001__create_ext.sql": ("ops", "20260411_001", "create ext", None),
        "schema/public/users.sql": ("schema", None, "users", "public"),
        "schema/materialized/rpt.sql": ("schema", None, "rpt", "materialized"),
        "logic/view_summary.sql": ("logic", None, "view_summary", None),
        "permissions/roles.sql": ("permissions", None, "roles", None),
        "reference/carrier.sql": ("reference", None, "carrier", None),
        "data/20260412__fill_it.sql": ("data", "20260412", "fill it", None),
    }
    sums = {r.filename: r.checksum for r in scan_manifest(spark, f"file://{tmp_path}").collect()}
    assert sums["data/20260412__fill_it.sql"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_flat_layout(spark, tmp_path):
    write(
        tmp_path,
        **{
            "V001__init_db.sql": "a",
            "V2_1__more.sql": "b",
            "S__users.sql": "c",
            "R__view_a.sql": "d",
            "notes.sql": "x",
            "sub/V3__no.sql": "x",
        },
    )
    got = {(r.type, r.version, r.name, r.namespace) for r in scan_manifest(spark, str(tmp_path)).collect()}
    assert got == {
        ("ops", "001", "init db", None),
        ("ops", "2_1", "more", None),
        ("schema", None, "users", "public"),
        ("logic", None, "view_a", None),
    }


def test_a_version_succeeds_once_whatever_is_called(spark, tmp_path):
    from evenkeel.operators import ledger as ops
    from evenkeel.sources.ledger_store import AlreadyDone, Item, LedgerStore

    store = LedgerStore(spark, str(tmp_path / "ledger"))
    items = [Item("ops", "first", "a", lambda: None, "1"), Item("logic", "view", "b", lambda: None)]
    store.run(items)
    for _ in range(2):
        store.adopt(items)
    assert store.read().filter("type = 'ops' AND success").count() == 1
    manifest = store._manifest(items)
    with pytest.raises(AlreadyDone, match="ops 1"):
        store.append(ops.baseline(manifest))
    twice = store._manifest([Item("data", "x", "c", lambda: None, "7"), Item("data", "y", "c", lambda: None, "7")])
    with pytest.raises(AlreadyDone, match="data 7"):
        store.append(ops.baseline(twice))
    assert ops.integrity(store.read()).collect() == []


def test_what_an_append_refuses_is_returned(spark, store):
    first = outcomes(spark, ("ops", "1", "a", None, "c", True), ("data", "1", "b", None, "c", False), ("logic", None, "v", None, "c", True))
    assert store.append_new(first, AT, "me").collect() == []
    second = outcomes(
        spark,
        ("ops", "1", "again", None, "c", True),
        ("ops", "1", "failed", None, "c", False),
        ("data", "1", "b", None, "c", True),
        ("data", "1", "z", None, "c", True),
        ("logic", None, "v", None, "c", True),
    )
    refused = store.append_new(second, AT, "me")
    assert names(refused) == ["again", "z"]
    assert sorted(r.id for r in store.read().collect()) == [1, 2, 3, 4, 5, 6]
    assert names(refused) == ["again", "z"]  # what was added since does not change it
    assert lg.integrity(store.read()).isEmpty()
