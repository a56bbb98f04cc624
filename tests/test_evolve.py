import uuid

import pytest

from evenkeel.operators.evolve import CATALOG, catalog_of, drift, drifting_tables, evolve, evolve_stored, missing_namespaces
from evenkeel.operators.spec import Column, TableContract
from evenkeel.sources.catalog import CatalogStore


def store_at(spark, root):
    return CatalogStore(spark, f"test_{uuid.uuid4().hex[:12]}", str(root / "store"))


LIVE = [
    ("declared", "t", "id", "bigint", False, None),
    ("declared", "t", "gone", "text", True, None),
    ("declared", "t", "n", "int", True, None),
    ("declared", "side", "id", "int", False, None),
    ("untouched", "t", "id", "int", False, None),
]
DESIRED = [
    ("declared", "t", "id", "bigint", False, None),
    ("declared", "t", "n", "bigint", False, "0"),
    ("declared", "t", "added", "text", True, None),
]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_drift_scope(spark, limit):
    live, desired = spark.createDataFrame(LIVE, CATALOG), spark.createDataFrame(DESIRED, CATALOG)
    ours = {
        ("declared", "t", "added", "column_added", None, "text"),
        ("declared", "t", "gone", "column_dropped", "text", None),
        ("declared", "t", "n", "type_changed", "int", "bigint"),
        ("declared", "t", "n", "nullability_changed", "true", "false"),
        ("declared", "t", "n", "default_changed", None, "0"),
    }
    assert {tuple(r) for r in drift(live, desired, broadcast_rows=limit).collect()} == ours
    strict = {tuple(r) for r in drift(live, desired, strict=True, broadcast_rows=limit).collect()}
    assert strict == ours | {("declared", "side", "id", "column_dropped", "int", None)}
    assert drift(live, desired, strict=True, namespaces=["untouched"], broadcast_rows=limit).isEmpty()
    assert drift(desired, desired, broadcast_rows=limit).isEmpty()


def test_catalog_of_contracts(spark):
    items = TableContract("items", (Column("id", "int", False), Column("name", "text", False, "''")))
    before = TableContract("items", (Column("id", "int", False),))
    got = drift(catalog_of(spark, [before]), catalog_of(spark, [items])).collect()
    assert [(r.column_name, r.kind) for r in got] == [("name", "column_added")]


def test_evolve_adds_casts_orders_and_is_idempotent(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'x', '7'), (2, NULL, '8') AS t(id, extra, n)")
    shape = [Column("n", "bigint"), Column("id", "bigint"), Column("name", "text", False, "''")]
    once = evolve(rows, shape)
    assert once.schema.simpleString() == "struct<n:bigint,id:bigint,name:string,extra:string>"
    assert sorted(tuple(r) for r in once.collect())[0] == (7, 1, "", "x")
    twice = evolve(once, shape)
    assert twice.schema.simpleString() == once.schema.simpleString() and twice.exceptAll(once).isEmpty()
    assert evolve(rows, shape, strict=True).columns == ["n", "id", "name"]


def test_evolve_stored_writes_once(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.create("items", spark.range(5).selectExpr("CAST(id AS INT) AS id"), ["id"], 4)
    shape = [Column("id", "bigint"), Column("name", "text", False, "''")]
    assert evolve_stored(store, "items", shape)
    version = store.current()[0]
    assert sorted(tuple(r) for r in store.table("items").collect()) == [(i, "") for i in range(5)]
    assert not evolve_stored(store, "items", shape) and store.current()[0] == version


def test_drifting_tables(spark):
    live, desired = spark.createDataFrame(LIVE, CATALOG), spark.createDataFrame(DESIRED, CATALOG)
    assert drifting_tables(drift(live, desired), ["t", "side"]) == {"t"}


def test_evolve_refuses_what_does_not_fit(spark):
    rows = spark.sql("SELECT 1 AS id, 'abcd' AS name")
    with pytest.raises(Exception, match="value too long for type character varying"):
        evolve(rows, [Column("id", "int"), Column("name", "varchar(3)")]).collect()


def test_missing_namespaces(spark):
    declared = spark.sql("SELECT * FROM VALUES ('public'), ('a'), ('a'), ('b'), (NULL), ('') AS t(namespace)")
    existing = spark.sql("SELECT 'b' AS namespace")
    assert [r.namespace for r in missing_namespaces(declared, existing).collect()] == ["a"]


def test_a_type_under_another_name_is_the_same(spark):
    from evenkeel.operators.evolve import CATALOG, drift

    names = ["int", "decimal(10,2)", "text", "varchar(9)", "timestamptz", "double", "bigint[]", "json"]
    others = ["INTEGER", "numeric(10, 2)", "string", "character varying(9)", "timestamp with time zone", "float8", "int8[]", "jsonb"]
    live = spark.createDataFrame([("s", "t", f"c{i}", n, True, None) for i, n in enumerate(names)], CATALOG)
    wanted = spark.createDataFrame([("s", "t", f"c{i}", n, True, None) for i, n in enumerate(others)], CATALOG)
    assert drift(live, wanted).collect() == []
    longer = spark.createDataFrame([("s", "t", "c3", "varchar(10)", True, None)], CATALOG)
    assert [r.kind for r in drift(live.filter("column_name = 'c3'"), longer).collect()] == ["type_changed"]


def test_serial_generated_and_not_null_columns_are_filled_or_refused(spark):
    rows = spark.sql("SELECT * FROM VALUES (3, 'c'), (1, 'a'), (2, NULL) AS t(id, name)")
    shape = [Column("id", "int"), Column("n", "serial", serial=True), Column("twice", "int", generated="id * 2")]
    got = evolve(rows, shape, key=["id"]).orderBy("id").select("id", "n", "twice").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2), (2, 2, 4), (3, 3, 6)]
    with pytest.raises(ValueError, match="serial"):
        evolve(rows, shape)
    for bad in (Column("more", "text", nullable=False), Column("name", "text", nullable=False)):
        with pytest.raises(Exception, match="must not be NULL"):
            evolve(rows, [Column("id", "int"), bad]).collect()
        assert evolve(rows.limit(0), [Column("id", "int"), bad]).collect() == []


def test_a_shorter_text_type_is_checked_and_the_catalog_is_of_what_is_stored(spark, tmp_path):
    from evenkeel.operators.evolve import catalog_of_stored

    store = store_at(spark, tmp_path)
    store.create("t", spark.sql("SELECT 1 AS id, 'abcdefghij' AS name"), ["id"])
    with pytest.raises(Exception, match="too long"):
        evolve_stored(store, "t", [Column("id", "int"), Column("name", "varchar(3)")])
    assert evolve_stored(store, "t", [Column("id", "int"), Column("name", "varchar(10)")]) is False
    assert [(r.column_name, r.type) for r in catalog_of_stored(store).collect()] == [("id", "int"), ("name", "string")]


def files(store, name):
    return sorted(store.table(name).inputFiles())


def test_columns_that_need_no_writing_write_no_file(spark, tmp_path):
    store = store_at(spark, tmp_path)
    rows = spark.range(50).selectExpr("CAST(id AS INT) AS id", "CAST(id AS FLOAT) AS f", "string(id) AS gone")
    store.create("t", rows, ["id"], 4)
    before = files(store, "t")
    shape = [Column("note", "text", False, "'it''s'"), Column("id", "bigint"), Column("f", "double"), Column("more", "int")]
    assert evolve_stored(store, "t", shape, strict=True)
    assert files(store, "t") == before
    got = sorted(tuple(r) for r in store.table("t").collect())
    assert got == [("it's", i, float(i), None) for i in range(50)] and store.table("t").columns == ["note", "id", "f", "more"]
    # a row is found in its bucket by the wider key
    bucket = store.bucket_of(spark.sql("SELECT 7L AS id"), ["id"], 4, store.schema(store.current()[1]["t"]))
    [b] = spark.sql("SELECT 7L AS id").select(bucket).first()
    assert store.read(store.current()[1]["t"], [b]).filter("id = 7").count() == 1


@pytest.mark.parametrize(
    "column",
    [
        Column("n", "serial", serial=True),
        Column("twice", "bigint", generated="id * 2"),
        Column("id", "text"),
        Column("made", "text", default="concat('a', 'b')"),
    ],
)
def test_what_changes_rows_is_written(spark, tmp_path, column):
    store = store_at(spark, tmp_path)
    store.create("t", spark.range(5).toDF("id"), ["id"], 2)
    before = files(store, "t")
    shape = [column] if column.name == "id" else [Column("id", "bigint"), column]
    assert evolve_stored(store, "t", shape)
    assert not set(files(store, "t")) & set(before) and store.table("t").count() == 5


def test_the_catalog_of_real_tables(spark, tmp_path):
    from evenkeel.operators.evolve import catalog_of_database, catalog_of_stored

    store = store_at(spark, tmp_path)
    spark.sql(f"CREATE TABLE {store.database}.items (id INT, name STRING DEFAULT 'x', n DECIMAL(9,2)) USING parquet")
    spark.sql(f"CREATE VIEW {store.database}.seen AS SELECT 1 AS one")
    live = catalog_of_database(spark, store.database, "shop")
    assert sorted((r.column_name, r.type, r.default_expr) for r in live.collect()) == [
        ("id", "int", None), ("n", "decimal(9,2)", None), ("name", "string", "'x'")
    ]
    wanted = TableContract("items", (Column("id", "bigint"), Column("name", "text", default="'x'"), Column("more", "text")))
    kinds = {(r.column_name, r.kind) for r in drift(live, catalog_of(spark, [wanted], "shop")).collect()}
    assert kinds == {("id", "type_changed"), ("more", "column_added"), ("n", "column_dropped")}
    store.create("t", spark.range(1).toDF("id"), ["id"])
    evolve_stored(store, "t", [Column("id", "bigint"), Column("note", "text", default="'-'")])
    assert [(r.column_name, r.default_expr) for r in catalog_of_stored(store).collect()] == [("id", None), ("note", "'-'")]
