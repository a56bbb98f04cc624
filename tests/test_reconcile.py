import os
import uuid
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException

from evenkeel.operators.reconcile import Reconciler, Violated, discard, has_pending
from evenkeel.operators.spec import (
    Column,
    ForeignKey,
    Refused,
    TableContract,
    TableSpec,
    check_declaration,
    check_isolation,
    declared_rows,
    order_by_foreign_keys,
)
from evenkeel.sources.catalog import CatalogStore, Conflict

OLD, NOW = datetime(2000, 1, 1), datetime(2024, 5, 1, 10, 0)


def store_at(spark, root):
    return CatalogStore(spark, f"test_{uuid.uuid4().hex[:12]}", str(root / "store"))


def text_table(name, *columns, **rest):
    return TableContract(name, tuple(Column(c, "text") for c in columns), (columns[0],), **rest)


class World:
    def __init__(self, spark, root, *contracts, buckets=1):
        self.spark, self.store = spark, store_at(spark, root)
        self.contracts = {c.name: c for c in contracts}
        for c in contracts:
            if c.is_table:
                self.store.create(c.name, c.empty(spark), list(c.primary_key or (c.columns[0].name,)), buckets)

    def spec(self, table, values, columns, **rest):
        rows = declared_rows(self.spark, f"SELECT * FROM VALUES {values} AS v({columns})")
        return TableSpec(table, rows, owner=f"{table}.sql", **rest)

    @property
    def reconciler(self):
        return Reconciler(self.store, self.contracts.values())

    def apply(self, *specs):
        return self.reconciler.apply(list(specs), NOW)

    def plan(self, *specs, **rest):
        return self.reconciler.plan(list(specs), **rest)

    def rows(self, table, *columns):
        df = self.store.table(table)
        return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)

    def version(self):
        return self.store.current()[0]


# The rows and refusals of FIXTURES.md (A1, A2), whose outcomes have to match.
MAPPING = TableContract(
    "vendor_mapping",
    (
        Column("id", "text", False),
        Column("match_type", "text", False),
        Column("keyword", "text", False),
        Column("carrier", "text"),
        Column("fee", "decimal(10,2)"),
        Column("created_at", "timestamp", False, "TIMESTAMP '2024-05-01 00:00:00'"),
        Column("updated_at", "timestamp", False, "TIMESTAMP '2024-05-01 00:00:00'"),
    ),
    ("id",),
    (("match_type", "keyword"),),
)
ROWS = """('vm_1', 'VENDOR_CONTAINS', 'landmark', 'LANDMARK', 1.234),
 ('vm_2', 'VENDOR_CONTAINS', 'funko', 'DHL_ECOM', NULL),
 ('vm_3', 'MERCHANT_EXACT', 'seko', 'SEKO_US', 2)"""


def test_converges_on_every_apply(spark, tmp_path, buckets=8):
    w = World(spark, tmp_path)
    w.contracts = {"vendor_mapping": MAPPING}
    key = ("match_type", "keyword")
    w.store.create("vendor_mapping", MAPPING.empty(spark), list(key), buckets)

    def spec(rows=ROWS, **rest):
        return w.spec(
            "vendor_mapping", rows, "id, match_type, keyword, carrier, fee", key=key, touch=("updated_at",), **rest
        )

    [pending] = w.plan(spec(), changing=["vendor_mapping"])
    assert not pending.empty and "changes in this release" in pending.pending

    drifted = spark.sql("SELECT 'public' AS namespace, 'vendor_mapping' AS table_name, 'x' AS column_name")
    assert w.plan(spec(), shape_drift=drifted)[0].pending and has_pending([pending])

    w.apply(spec())
    assert w.rows("vendor_mapping", "id", "carrier", "fee") == [
        ("vm_1", "LANDMARK", Decimal("1.23")),
        ("vm_2", "DHL_ECOM", None),
        ("vm_3", "SEKO_US", Decimal("2.00")),
    ]

    # Converged: the rounded value is no change, and nothing is written.
    before = w.store.current()
    assert not has_pending(w.apply(spec()))
    assert w.store.current() == before

    # A hand edit and a row nobody declared.
    edited = spark.sql(
        """SELECT * FROM VALUES ('vm_1', 'VENDOR_CONTAINS', 'landmark', 'LANDMARK', 1.23),
           ('vm_2', 'VENDOR_CONTAINS', 'funko', 'HAND_EDIT', 9), ('vm_3', 'MERCHANT_EXACT', 'seko', 'SEKO_US', 2),
           ('app_1', 'VENDOR_CONTAINS', 'app', 'APP', NULL) AS v(id, match_type, keyword, carrier, fee)"""
    ).selectExpr(
        "id", "match_type", "keyword", "carrier", "CAST(fee AS DECIMAL(10,2)) AS fee",
        "TIMESTAMP '2000-01-01 00:00:00' AS created_at", "TIMESTAMP '2000-01-01 00:00:00' AS updated_at",
    )
    w.store.create("vendor_mapping", edited, list(key), buckets)
    parts_before = w.store.partitions(w.store.current()[1]["vendor_mapping"])
    [plan] = w.plan(spec())
    assert (plan.inserts, plan.updates, plan.deletes) == (0, 1, 0)
    assert plan.lines() == ["~ ('VENDOR_CONTAINS', 'funko') carrier: 'HAND_EDIT' → 'DHL_ECOM', fee: '9.00' → NULL"]
    w.apply(spec())
    assert w.rows("vendor_mapping", "id", "carrier", "created_at", "updated_at") == [
        ("app_1", "APP", OLD, OLD),
        ("vm_1", "LANDMARK", OLD, OLD),
        ("vm_2", "DHL_ECOM", OLD, NOW),
        ("vm_3", "SEKO_US", OLD, OLD),
    ]
    parts = w.store.partitions(w.store.current()[1]["vendor_mapping"])
    assert sum(parts[b] != parts_before[b] for b in parts) == 1

    # Prune, and one more row.
    more = ROWS + ", ('vm_4', 'VENDOR_CONTAINS', 'royal mail', 'ROYAL_MAIL', NULL)"
    [plan] = w.plan(spec(more, prune=True))
    assert plan.lines() == [
        "+ ('VENDOR_CONTAINS', 'royal mail') id='vm_4' carrier='ROYAL_MAIL' fee=NULL",
        "- ('VENDOR_CONTAINS', 'app')",
    ]
    [done] = w.apply(spec(more, prune=True))
    assert (done.inserts, done.updates, done.deletes) == (1, 0, 1)
    assert [r[0] for r in w.rows("vendor_mapping", "id")] == ["vm_1", "vm_2", "vm_3", "vm_4"]


def test_serials_move_on_and_never_back(spark, tmp_path):
    serials = TableContract("serials", (Column("id", "int", serial=True), Column("code", "text")), ("id",), (("code",),))
    w = World(spark, tmp_path, serials)
    w.apply(w.spec("serials", "(1, 'UPS'), (2, 'FEDEX')", "id, code"))
    assert w.store.current()[1]["serials"].sequences == {"id": 2}
    # Rows matched on another key take the next ids.
    w.store.create("serials", w.store.table("serials"), ["code"])
    w.apply(w.spec("serials", "('UPS'), ('DHL'), ('APP')", "code", key=("code",)))
    assert w.rows("serials", "code", "id") == [("APP", 3), ("DHL", 4), ("FEDEX", 2), ("UPS", 1)]
    version, tables = w.store.current()
    stored = tables["serials"]
    w.store.publish({"serials": type(stored)(**{**vars(stored), "sequences": {"id": 100}})}, version)
    w.apply(w.spec("serials", "(5, 'X')", "id, code"))
    assert w.store.current()[1]["serials"].sequences == {"id": 100}


def test_types_without_equality_converge(spark, tmp_path):
    shapes = TableContract(
        "shapes",
        (Column("code", "text"), Column("meta", "json"), Column("loc", "point"), Column("doc", "xml")),
        ("code",),
    )
    w = World(spark, tmp_path, shapes)
    spec = w.spec("shapes", """('a', '{"x": 1, "y": [1, 2]}', '(1,2)', '<a>1</a>')""", "code, meta, loc, doc")
    w.apply(spec)
    version = w.version()
    w.apply(w.spec("shapes", """('a', '{"y":[1,2],"x":1}', '(1,2)', '<a>1</a>')""", "code, meta, loc, doc"))
    assert w.version() == version


def test_char_keeps_its_length(spark, tmp_path):
    iso = TableContract("iso", (Column("code", "char(2)"), Column("iso3", "char(3)"), Column("bits", "bit(3)")), ("code",))
    w = World(spark, tmp_path, iso)
    spec = w.spec("iso", "('US', 'USA', '101'), ('UK', 'GBR', '011')", "code, iso3, bits")
    w.apply(spec)
    assert w.rows("iso") == [("UK", "GBR", "011"), ("US", "USA", "101")]
    assert w.apply(spec)[0].empty
    # Rows put there without padding are found in their bucket all the same.
    w.store.create("iso", spark.sql("SELECT 'U' AS code, 'USA' AS iso3, '101' AS bits"), ["code"], 16)
    [plan] = w.apply(w.spec("iso", "('U', 'GBR', '011')", "code, iso3, bits"))
    assert (plan.inserts, plan.updates) == (0, 1) and w.rows("iso") == [("U", "GBR", "011")]


def test_generated_columns_follow(spark, tmp_path):
    gen = TableContract(
        "gen",
        (Column("code", "text"), Column("name", "text"), Column("upper_name", "text", generated="upper(name)")),
        ("code",),
    )
    w = World(spark, tmp_path, gen)
    w.apply(w.spec("gen", "('a', 'x')", "code, name"))
    w.apply(w.spec("gen", "('a', 'y')", "code, name"))
    assert w.rows("gen") == [("a", "y", "Y")]


def test_rekeying_a_row_that_keeps_its_other_unique_value(spark, tmp_path):
    rekey = TableContract("rekey", (Column("id", "text", False), Column("keyword", "text")), ("keyword",), (("id",),))
    w = World(spark, tmp_path, rekey)
    w.apply(w.spec("rekey", "('vm_1', 'dhl ecomm au')", "id, keyword"))
    w.apply(w.spec("rekey", "('vm_1', 'dhl ecom au')", "id, keyword", prune=True))
    assert w.rows("rekey") == [("vm_1", "dhl ecom au")]
    with pytest.raises(Violated, match=r"unique \(id\)"):
        w.apply(w.spec("rekey", "('vm_1', 'another')", "id, keyword"))


NATION = text_table("nation", "code")
PROVINCE = TableContract(
    "province",
    (Column("code", "text"), Column("nation", "text", False)),
    ("code",),
    foreign_keys=(ForeignKey("province_nation_fkey", ("nation",), "nation", ("code",)),),
)


def test_parents_first_and_a_child_leaves_a_pruned_parent(spark, tmp_path):
    w = World(spark, tmp_path, PROVINCE, NATION)
    plans = w.apply(
        w.spec("province", "('R', 'CA')", "code, nation"), w.spec("nation", "('US'), ('CA')", "code")
    )
    assert [p.spec.table for p in plans] == ["nation", "province"]
    version = w.version()
    w.apply(
        w.spec("province", "('R', 'US')", "code, nation", prune=True), w.spec("nation", "('US')", "code", prune=True)
    )
    assert (w.rows("nation"), w.rows("province")) == ([("US",)], [("R", "US")])
    assert w.version() == version + 1  # both tables in one commit
    with pytest.raises(Violated, match="province: foreign key province_nation_fkey: 1 violation"):
        w.apply(w.spec("nation", "('CA')", "code", prune=True))
    assert w.rows("nation") == [("US",)]


def test_failed_write_leaves_nothing(spark, tmp_path):
    fee = TableContract(
        "fee", (Column("code", "text"), Column("amount", "decimal(38,10)")), ("code",), checks={"fee_amount_check": "amount >= 0"}
    )
    w = World(spark, tmp_path, text_table("witness", "code", "name"), fee)
    version = w.version()
    with pytest.raises(Violated, match="fee: check fee_amount_check: 1 violation"):
        w.apply(w.spec("witness", "('w', 'x')", "code, name"), w.spec("fee", "('neg', -1)", "code, amount"))
    assert w.rows("witness") == [] and w.version() == version


def test_undeclared_not_null(spark, tmp_path):
    owned = TableContract(
        "owned", (Column("id", "int"), Column("name", "text"), Column("owner", "text", False)), ("id",)
    )
    w = World(spark, tmp_path, owned)
    w.store.create("owned", spark.sql("SELECT 1 AS id, 'a' AS name, 'ops' AS owner"), ["id"])
    w.apply(w.spec("owned", "(1, 'b')", "id, name"))
    assert w.rows("owned") == [(1, "b", "ops")]
    with pytest.raises(Violated, match="owned: not null owner: 1 violation"):
        w.apply(w.spec("owned", "(2, 'c')", "id, name"))


# Refused declarations and what the refusal says (FIXTURES.md, A2).
WITNESS = text_table("witness", "code", "name")
OK = text_table("ok", "code", "name")
REFUSED = {
    "no primary key": ("nokey", "('a', 'b')", "code, name", {}, "nokey has no primary key; name the key columns with key="),
    "key without a unique index": ("nokey", "('a', 'b')", "code, name", {"key": ("code",)}, "no unique index on nokey covers exactly the key (code)"),
    "unique index on more than the key": ("ok", "('a', 'b')", "code, name", {"key": ("code", "name")}, "no unique index on ok covers exactly the key (code, name)"),
    "key not declared": ("ok", "('b')", "name", {}, "key column code is not one of the query's columns"),
    "unknown column": ("ok", "('a', 'b')", "code, nmae", {}, "column nmae does not exist on ok"),
    "missing table": ("nope", "(1)", "code", {}, "table nope does not exist"),
    "generated column": ("gen", "('a', 'A')", "code, upper_name", {}, "column upper_name is generated"),
    "touch is declared": ("ok", "('a', 'b')", "code, name", {"touch": ("name",)}, "touch column name is also one of the query's columns"),
    "touch does not exist": ("ok", "('a', 'b')", "code, name", {"touch": ("updated_at",)}, "touch column updated_at does not exist on ok"),
    "duplicate key": ("ok", "('x', 'b'), ('x', 'c'), ('y', 'd')", "code, name", {}, "key (code) is declared more than once: ('x')"),
    "NULL key": ("ok", "(CAST(NULL AS STRING), 'b')", "code, name", {}, "a row declares a NULL key (NULL)"),
    "too long": ("short", "('a', 'abcd')", "code, name", {}, "value too long for type character varying(3)"),
    "char too long": ("cshort", "('USA')", "code", {}, "value too long for type character(2)"),
    "identity always": ("ident", "(1, 'a')", "id, name", {"key": ("name",)}, "column id is GENERATED ALWAYS AS IDENTITY"),
    "reads another declared table": ("ok", "('a', 'b')", "code, name", {"sources": ("witness",)}, "the query reads witness, which witness.sql declares"),
    "reads its own table": ("ok", "('a', 'b')", "code, name", {"sources": ("ok",)}, "the query reads ok, which ok.sql declares"),
    "wrong type": ("typed", "('abc')", "code", {}, "invalid input syntax for type integer"),
    "prune through a cascade": ("parent", "('a')", "code", {"prune": True}, "prune would delete through foreign key child_parent_fkey on child (ON DELETE CASCADE)"),
    "same table twice": ("witness", "('z')", "code", {}, "witness is already declared in witness.sql"),
    "prune of everything": ("ok", "('a', 'b')", "code, name", {"prune": True, "empty": True}, "deletes every row"),
}


@pytest.fixture(scope="module")
def refusing(spark, tmp_path_factory):
    child_fk = ForeignKey("child_parent_fkey", ("parent",), "parent", ("code",), "CASCADE")
    return World(
        spark,
        tmp_path_factory.mktemp("refusing"),
        WITNESS,
        OK,
        TableContract("nokey", (Column("code", "text"), Column("name", "text"))),
        TableContract("short", (Column("code", "text"), Column("name", "varchar(3)")), ("code",)),
        TableContract(
            "gen", (Column("code", "text"), Column("name", "text"), Column("upper_name", "text", generated="upper(name)")), ("code",)
        ),
        TableContract("typed", (Column("code", "int"),), ("code",)),
        TableContract("cshort", (Column("code", "char(2)"),), ("code",)),
        TableContract("ident", (Column("id", "int", identity_always=True), Column("name", "text")), ("id",), (("name",),)),
        text_table("parent", "code"),
        text_table("child", "code", "parent", foreign_keys=(child_fk,)),
    )


@pytest.mark.parametrize("case", REFUSED)
def test_refusals(refusing, case):
    table, values, columns, rest, message = REFUSED[case]
    w, rest = refusing, dict(rest)
    empty = rest.pop("empty", False)
    good = w.spec("witness", "('kept_out', 'x')", "code, name")
    bad = w.spec(table, values, columns, **rest)
    if empty:
        bad = TableSpec(table, bad.declared.filter("false"), owner=bad.owner, **rest)
    version = w.version()
    with pytest.raises(ValueError) as e:
        w.apply(good, bad)
    assert message in str(e.value)
    assert f"{table}.sql" in str(e.value)
    assert w.version() == version and w.rows("witness") == []


def test_refusals_without_a_store(spark):
    def spec(df, **rest):
        return TableSpec("ok", df, **rest)

    with pytest.raises(Refused, match="names column name twice"):
        check_declaration(spec(spark.sql("SELECT 'a' AS code, 'b' AS name, 'c' AS name")), OK)
    with pytest.raises(Refused, match="v is not a table"):
        check_declaration(TableSpec("v", spark.range(1)), TableContract("v", (), is_table=False))
    with pytest.raises(Refused, match="the query failed"):
        declared_rows(spark, "SELECT * FROM missing_table")
    with pytest.raises(TypeError, match="maps cannot be compared"):
        check_declaration(spec(spark.sql("SELECT 'a' AS code, map('a', 1) AS name")), OK)


def test_isolation_also_looks_at_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).selectExpr("string(id) AS code", "'x' AS name").write.parquet(path)
    table = spark.read.parquet(path)
    with pytest.raises(Refused, match="the query reads ok"):
        check_isolation([TableSpec("ok", table.filter("code > '0'"))], {"ok": path})
    check_isolation([TableSpec("ok", spark.sql("SELECT 'a' AS code, 'b' AS name"))], {"ok": path})


def test_order_and_cycle():
    def table(name, *parents):
        fks = tuple(ForeignKey(f"{name}_{p}", ("x",), p, ("code",)) for p in parents)
        return TableContract(name, (), ("code",), foreign_keys=fks)

    contracts = {t.name: t for t in (table("a", "b"), table("b"), table("c", "c"), table("d", "a"))}
    assert order_by_foreign_keys(["d", "c", "a", "b"], contracts) == ["c", "b", "a", "d"]
    contracts["b"] = table("b", "d")
    with pytest.raises(Refused, match=r"in a cycle \(a, b, d\)"):
        order_by_foreign_keys(["a", "b", "c", "d"], contracts)


def test_live_key_must_be_unique(spark, tmp_path):
    w = World(spark, tmp_path, OK)
    w.store.create("ok", spark.sql("SELECT * FROM VALUES ('a', '1'), ('a', '2') AS t(code, name)"), ["code"])
    with pytest.raises(Refused, match=r"the key \(code\) is not unique in ok: \('a'\)"):
        w.plan(w.spec("ok", "('a', 'b')", "code, name"))


def test_keyless_live_rows_stay_or_are_pruned(spark, tmp_path):
    loose = TableContract("loose", (Column("code", "text"), Column("name", "text")), uniques=(("code",),))
    w = World(spark, tmp_path, loose, buckets=4)
    rows = spark.sql("SELECT * FROM VALUES (CAST(NULL AS STRING), 'x'), (NULL, 'y'), ('a', 'z') AS t(code, name)")
    w.store.create("loose", rows, ["code"], 4)
    w.apply(w.spec("loose", "('a', 'new')", "code, name", key=("code",)))
    assert w.rows("loose", "name") == [("new",), ("x",), ("y",)]
    [plan] = w.apply(w.spec("loose", "('a', 'new')", "code, name", key=("code",), prune=True))
    assert plan.deletes == 2 and w.rows("loose", "name") == [("new",)]


def test_stale_writers_are_refused(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.create("t", spark.range(3).toDF("id"), ["id"])
    version, tables = store.current()
    store.create("u", spark.range(2).toDF("id"), ["id"])
    with pytest.raises(Conflict):
        store.publish({"t": tables["t"]}, version)
    assert store.table("t").count() == 3 and store.table("u").count() == 2


KEYED = (
    ("int", "bigint", "CAST({n} AS INT)", "CAST({n} AS BIGINT)"),
    ("bigint", "int", "CAST({n} AS BIGINT)", "CAST({n} AS INT)"),
    ("decimal(12,2)", "decimal(12,2)", "CAST({n} AS DECIMAL(12,2))", "CAST({n} AS DECIMAL(6,1))"),
    ("date", "date", "date_add(DATE '2020-01-01', {n})", "CAST(date_add(DATE '2020-01-01', {n}) AS STRING)"),
    ("char(6)", "char(6)", "CAST({n} AS STRING)", "rpad(CAST({n} AS STRING), 6, ' ')"),
    ("varchar(6)", "varchar(6)", "CAST({n} AS STRING)", "CAST({n} AS STRING)"),
)


@pytest.mark.parametrize("buckets", [1, 8])
@pytest.mark.parametrize("stored, declared, live_key, declared_key", KEYED)
def test_no_row_is_lost_whatever_types_keys_have(spark, tmp_path, stored, declared, live_key, declared_key, buckets):
    store = store_at(spark, tmp_path)
    live = spark.sql(f"SELECT {live_key.format(n='CAST(id AS INT)')} AS id, 'old' AS name FROM range(200)")
    store.create("t", live, ["id"], buckets)
    contract = TableContract("t", (Column("id", declared), Column("name", "text")), ("id",))
    rows = f"SELECT {declared_key.format(n='7')} AS id, 'new' AS name UNION ALL SELECT {declared_key.format(n='9')}, 'old'"
    [plan] = Reconciler(store, [contract]).apply([TableSpec("t", spark.sql(rows))], NOW)
    assert (plan.inserts, plan.updates, plan.deletes) == (0, 1, 0)
    after = store.table("t").collect()
    assert len(after) == 200 and len({str(r.id).strip() for r in after}) == 200
    assert sum(r.name == "new" for r in after) == 1


def test_a_table_of_another_shape_is_pending_and_refused(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.create("t", spark.sql("SELECT 1 AS id, 'a' AS name"), ["id"], 4)
    declared = spark.sql("SELECT 1 AS id, 'b' AS name")
    for columns in (
        (Column("id", "int"), Column("name", "text"), Column("more", "text")),
        (Column("id", "int"), Column("name", "date")),
    ):
        reconciler = Reconciler(store, [TableContract("t", columns, ("id",))])
        [plan] = reconciler.plan([TableSpec("t", declared)])
        assert plan.pending and not plan.empty
        with pytest.raises(Refused, match="another shape"):
            reconciler.apply([TableSpec("t", declared)], NOW)
    assert store.current()[0] == 1


def test_rows_in_a_bucket_that_was_not_read_are_an_error(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.create("t", spark.range(100).toDF("id"), ["id"], 8)
    stored = store.current()[1]["t"]
    with pytest.raises(AnalysisException, match="PARTITIONS_ALREADY_EXIST|already exist"):
        store.rewrite("t", stored, spark.range(100).toDF("id"), [0])
    assert store.table("t").count() == 100


def test_of_two_writers_one_publishes(spark, tmp_path):
    a = store_at(spark, tmp_path)
    b = CatalogStore(spark, a.database)
    a.create("t", spark.range(3).toDF("id"), ["id"])
    version, _ = a.current()
    new = {s: s.write("t", spark.range(n).toDF("id"), ["id"]) for s, n in ((a, 4), (b, 5))}
    a.publish({"t": new[a]}, version)
    with pytest.raises(Conflict):
        b.publish({"t": new[b]}, version)
    assert b.table("t").count() == 4


def test_names_of_superseded_tables_go_and_shared_files_stay(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.create("t", spark.range(100).selectExpr("id", "'it''s \\\\ old' AS name"), ["id"], 8)
    first = store.current()[1]["t"]
    bucket = store.table("t").filter("id = 7").select(store.bucket_of(store.table("t"), ["id"], 8)).first()[0]
    rows = store.read(first, [bucket]).selectExpr("id", "if(id = 7, 'new', name) AS name")
    second = store.rewrite("t", first, rows, [bucket])
    store.publish({"t": second}, 1)
    assert store.drop_superseded() == [first.at] and store.drop_superseded() == []
    assert store.table("t").count() == 100 and store.table("t").filter("name = 'new'").count() == 1
    old, new = store.partitions(second), str(tmp_path / "store" / "t" / second.at)
    assert [b for b, f in old.items() if new in f] == [bucket]


def test_only_the_buckets_asked_for_are_read(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.create("t", spark.range(1000).toDF("id"), ["id"], 16)
    stored = store.current()[1]["t"]
    plan = store.read(stored, [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket__" in plan and "bucket__" in plan
    everything = sum(store.read(stored, [b]).count() for b in range(16))
    assert everything == 1000 and store.read(stored, []).count() == 0


def test_rules_are_counted_by_the_write_itself(spark, tmp_path):
    contract = TableContract(
        "t",
        (Column("id", "bigint"), Column("a", "text", nullable=False), Column("b", "int")),
        ("id",),
        (("a",),),
        {"positive": "b > 0", "small": "b < 50"},
    )
    w = World(spark, tmp_path, contract)
    # rows that break rules already are not the declaration's fault
    w.store.create("t", spark.sql("SELECT id, IF(id = 3, NULL, concat('a', id)) AS a, CAST(-id AS INT) AS b FROM range(9)"), ["id"], 4)
    with pytest.raises(Violated) as e:
        w.apply(w.spec("t", "(1L, NULL, 5), (2L, 'x', -1), (20L, 'x', 60), (21L, 'y', NULL)", "id, a, b"))
    assert e.value.broken == [
        ("t", "check positive", 1), ("t", "check small", 1), ("t", "not null a", 1), ("t", "unique (a)", 1)
    ]
    w.apply(w.spec("t", "(1L, 'z', 5)", "id, a, b"))
    assert w.store.table("t").filter("id = 1").first().a == "z"


def test_a_serial_is_looked_up_once_and_then_remembered(spark, tmp_path):
    t = TableContract("t", (Column("id", "bigint", serial=True), Column("code", "text")), ("id",), (("code",),))
    w = World(spark, tmp_path, t)
    w.store.create("t", spark.sql("SELECT id, concat('c', id) AS code FROM range(10, 20)"), ["code"], 4)
    w.apply(w.spec("t", "('new')", "code", key=("code",)))
    assert w.store.current()[1]["t"].sequences == {"id": 20}
    w.apply(w.spec("t", "('newer')", "code", key=("code",)))
    assert w.store.table("t").filter("code = 'newer'").first().id == 21


def test_discarded_plans_leave_nothing_in_the_shared_folder(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.create("t", spark.sql("SELECT 1 AS id, 'a' AS name"), ["id"])
    contract = TableContract("t", (Column("id", "int"), Column("name", "text")), ("id",))
    plans = Reconciler(store, [contract]).plan([TableSpec("t", spark.sql("SELECT 1 AS id, 'b' AS name"))])
    folders = [f.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://") for f in (plans[0].declared, plans[0].feed)]
    assert all(map(os.path.isdir, folders))
    discard(plans)
    assert not any(map(os.path.exists, folders))
