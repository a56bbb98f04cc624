"""Queries that go through tables of the catalog and the ledger's files.

Each run writes to a database and folders of its own below the shared folder, which the result
reads; ``DROP DATABASE ... CASCADE`` and deleting ``<shared>/evenkeel`` after the run are the clean-up.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from evenkeel.operators import evolve as ev
from evenkeel.operators import ledger as lg
from evenkeel.operators.reconcile import Reconciler, Violated, discard
from evenkeel.operators.spec import Column, ForeignKey, TableContract, TableSpec
from evenkeel.plans.base import Query, in_spark, table, with_inputs
from evenkeel.plans.ledger import AT, BY, ITEMS
from evenkeel.plans.reconcile import DECLARED_ROWS
from evenkeel.session import new_path
from evenkeel.sources.catalog import CatalogStore
from evenkeel.sources.ledger_store import Item, LedgerStore

NOW = datetime(2024, 6, 1, 12, 0, 0)
BUCKETS = 8

REGION = TableContract("region", (Column("r_regionkey", "int"), Column("r_name", "text")), ("r_regionkey",))
NATION = TableContract(
    "nation",
    (Column("n_nationkey", "int"), Column("n_name", "text"), Column("n_regionkey", "int")),
    ("n_nationkey",),
    foreign_keys=(ForeignKey("nation_region", ("n_regionkey",), "region", ("r_regionkey",)),),
)
CUSTOMER = TableContract(
    "customer",
    (
        Column("c_custkey", "bigint"),
        Column("c_name", "text"),
        Column("c_nationkey", "int"),
        Column("c_acctbal", "double precision"),
        Column("c_mktsegment", "text"),
    ),
    ("c_custkey",),
    foreign_keys=(ForeignKey("customer_nation", ("c_nationkey",), "nation", ("n_nationkey",)),),
)


def _new_store(spark) -> CatalogStore:
    return CatalogStore(spark, f"evenkeel_{uuid.uuid4().hex[:12]}", new_path(spark, "store"))


def _store(spark, d) -> CatalogStore:
    store = _new_store(spark)
    for contract in (REGION, NATION, CUSTOMER):
        store.create(contract.name, table(spark, d, contract.name), list(contract.primary_key), BUCKETS)
    return store


def _specs(spark, d) -> list[TableSpec]:
    nations = in_spark(spark, d, "SELECT n_nationkey, upper(n_name) || '!' AS n_name, n_regionkey FROM {nation}")
    customers = in_spark(spark, d, DECLARED_ROWS)
    return [TableSpec("customer", customers, prune=True), TableSpec("nation", nations, prune=False)]


def _applied(spark, d):
    """Customers after two declared tables were applied together."""
    store = _store(spark, d)
    discard(Reconciler(store, [REGION, NATION, CUSTOMER]).apply(_specs(spark, d), NOW))
    nations = store.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return store.table("customer").join(nations, "c_nationkey").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "n_name"
    )


def _applied_twice(spark, d):
    """What a second apply of the same declaration changes: nothing, table by table."""
    store = _store(spark, d)
    reconciler = Reconciler(store, [REGION, NATION, CUSTOMER])
    discard(reconciler.apply(_specs(spark, d), NOW))
    before = store.current()
    discard(reconciler.apply(_specs(spark, d), NOW))
    same = store.current() == before
    rows = None
    for name in ("customer", "nation", "region"):
        one = store.table(name).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table_name"), "n", F.lit(same).alias("unchanged")
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


STRICT_CUSTOMER = TableContract(
    "customer",
    (
        Column("c_custkey", "bigint"),
        Column("c_name", "text", nullable=False),
        Column("c_nationkey", "int"),
        Column("c_acctbal", "double precision"),
        Column("c_mktsegment", "text"),
    ),
    ("c_custkey",),
    (("c_name",),),
    {"customer_balance": "c_acctbal >= 0", "customer_segment": "c_mktsegment <> 'NONE'"},
    (ForeignKey("customer_nation", ("c_nationkey",), "nation", ("n_nationkey",)),),
)

# Each segment's customers break another rule; those of BUILDING stay as they are.
BROKEN_ROWS = """
SELECT c_custkey,
       CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN NULL
            WHEN c_mktsegment = 'FURNITURE' THEN concat('nation ', c_nationkey) ELSE c_name END AS c_name,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment
FROM {customer}
"""


def _refused(spark, d):
    """All rules a declaration breaks, in tables that hold what they held before it was refused."""
    store = _new_store(spark)
    for name, key in (("nation", "n_nationkey"), ("customer", "c_custkey")):
        store.create(name, table(spark, d, name), [key], BUCKETS)
    before = store.current()
    nations = in_spark(spark, d, "SELECT n_nationkey, upper(n_name) || '!' AS n_name, n_regionkey FROM {nation}")
    specs = [TableSpec("customer", in_spark(spark, d, BROKEN_ROWS)), TableSpec("nation", nations)]
    try:
        Reconciler(store, [NATION, STRICT_CUSTOMER]).apply(specs, NOW)
        broken = []
    except Violated as e:
        broken = e.broken
    found = spark.createDataFrame(broken, "table_name string, rule string, n long")
    same = store.current() == before
    for name in ("customer", "nation"):
        now = store.table(name)
        for rule, rows in (("rows", now), ("rows that differ", now.exceptAll(table(spark, d, name)))):
            n = rows.agg(F.count(F.lit(1)).alias("n"))
            found = found.unionByName(n.select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), "n"))
    return found.withColumn("published", F.lit(not same))


def _appended(spark, d):
    """A ledger after two appends, and what the second was refused: run-once successes the first has made."""
    store = LedgerStore(spark, new_path(spark, "ledger"))
    items = in_spark(spark, d, ITEMS).withColumn("checksum", lg.checksum(F.col("text")))
    manifest = items.select(*lg.MANIFEST, "lang").filter("type <> 'reference'")
    manifest = manifest.dropDuplicates(["type", "version", "name", "namespace"])
    # the first time items in French fail, the second time those in German; all others succeed both times
    store.append(lg.results(manifest, F.lit(1), F.col("lang") != "fr"), AT, BY)
    refused = store.append_new(lg.results(manifest, F.lit(2), F.col("lang") != "de"), AT, BY)

    def counted(rows, what, *more):
        groups = rows.groupBy("type", "success", "execution_ms")
        return groups.agg(F.count(F.lit(1)).alias("n"), *more).withColumn("what", F.lit(what))

    least = F.count_distinct("id").alias("ids")
    return counted(store.read(), "added", least).unionByName(
        counted(refused, "refused").withColumn("ids", F.lit(0).cast("long"))
    )


EVENTS_WITH_GAPS = """
SELECT event_id, user_id, event_type, CASE WHEN props LIKE '%7%' THEN NULL ELSE value END AS value FROM {events}
"""


def _backfilled(spark, d):
    """A backfill in steps, one a type of event, that stops where its input is missing and goes on from there.

    The ledger after both runs, with the rows each successful step has filled.
    """
    events = in_spark(spark, d, EVENTS_WITH_GAPS)
    folder, rates = new_path(spark, "backfill"), new_path(spark, "rates")
    kinds = sorted(r.event_type for r in events.select("event_type").distinct().collect())

    def step(kind):
        def run():
            rows = events.filter((F.col("event_type") == kind) & F.col("value").isNull())
            if kind == "error":  # the lowest value of the user, which the first run does not find
                known = spark.read.parquet(rates)
                rows = rows.drop("value").join(known, "user_id", "left")
            lg.backfill(rows, {"value": "CAST(0 AS DOUBLE)"}).write.mode("overwrite").parquet(f"{folder}/{kind}")

        return run

    items = [Item("data", kind, f"v1 {kind}", step(kind), version=f"{n:03}") for n, kind in enumerate(kinds, 1)]
    store = LedgerStore(spark, new_path(spark, "ledger"))
    store.run(items)
    events.groupBy("user_id").agg(F.min("value").alias("value")).write.parquet(rates)
    store.run(items)
    filled = None
    for kind in kinds:
        one = spark.read.parquet(f"{folder}/{kind}").agg(
            F.lit(kind).alias("name"), F.count(F.lit(1)).alias("filled"), F.max("value").alias("highest")
        )
        filled = one if filled is None else filled.unionByName(one)
    entries = store.read().join(F.broadcast(filled), "name")
    done = F.col("success")
    return entries.select(
        "id", "version", "name", "success",
        F.when(done, F.col("filled")).alias("filled"), F.when(done, F.col("highest")).alias("highest"),
    )


ORDERS_SHAPE = [
    Column("o_orderkey", "bigint"),
    Column("o_custkey", "bigint"),
    Column("o_note", "text", nullable=False, default="'none'"),
    Column("o_shippriority", "int", default="0"),
    Column("o_lines", "bigint"),
    Column("o_clerk", "text"),
]


def _evolved(spark, d):
    """Stored orders with new columns and a wider one, defined over the files they were in."""
    store = _new_store(spark)
    rows = table(spark, d, "orders").withColumn("o_lines", F.length("o_orderpriority"))
    store.create("orders", rows, ["o_orderkey"], BUCKETS)

    def files():
        return sorted(store.table("orders").inputFiles())

    before = files()
    ev.evolve_stored(store, "orders", ORDERS_SHAPE)
    return store.table("orders").withColumn("same_files", F.lit(files() == before))


QUERIES = {
    "r_apply_published": Query(
        _applied,
        with_inputs(
            """SELECT r.c_custkey, r.c_name, r.c_nationkey, l.c_acctbal, r.c_mktsegment, upper(n.n_name) || '!' AS n_name
FROM r LEFT JOIN l ON l.c_custkey = r.c_custkey JOIN nation n ON n.n_nationkey = r.c_nationkey""",
            r=DECLARED_ROWS,
            l="SELECT c_custkey, c_acctbal FROM {customer}",
        ),
    ),
    "r_apply_twice": Query(
        _applied_twice,
        with_inputs(
            """SELECT 'customer' AS table_name, count(*) AS n, TRUE AS unchanged FROM r
UNION ALL SELECT 'nation', count(*), TRUE FROM nation UNION ALL SELECT 'region', count(*), TRUE FROM region""",
            r=DECLARED_ROWS,
        ),
    ),
    "x_refused_apply": Query(
        _refused,
        with_inputs(
            """SELECT 'customer' AS table_name, 'not null c_name' AS rule, count(*) AS n, FALSE AS published
FROM t WHERE c_name IS NULL HAVING count(*) > 0
UNION ALL SELECT 'customer', 'check customer_balance', count(*), FALSE FROM t WHERE c_acctbal < 0 HAVING count(*) > 0
UNION ALL SELECT 'customer', 'check customer_segment', count(*), FALSE FROM t WHERE c_mktsegment = 'NONE' HAVING count(*) > 0
UNION ALL SELECT 'customer', 'unique (c_name)', count(*), FALSE FROM (
  SELECT c_name FROM b WHERE c_name IN (SELECT c_name FROM t) GROUP BY c_name HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'customer', 'foreign key customer_nation', count(*), FALSE FROM t
WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey) HAVING count(*) > 0
UNION ALL SELECT 'customer', 'rows', count(*), FALSE FROM customer
UNION ALL SELECT 'nation', 'rows', count(*), FALSE FROM nation
UNION ALL SELECT 'customer', 'rows that differ', 0, FALSE UNION ALL SELECT 'nation', 'rows that differ', 0, FALSE""",
            b=BROKEN_ROWS,
            t="""SELECT b.*, l.c_acctbal FROM b JOIN customer l ON l.c_custkey = b.c_custkey
WHERE b.c_name IS DISTINCT FROM l.c_name OR b.c_nationkey IS DISTINCT FROM l.c_nationkey
   OR b.c_mktsegment IS DISTINCT FROM l.c_mktsegment""",
        ),
    ),
    "l_append_read": Query(
        _appended,
        with_inputs(
            """SELECT type, lang <> 'fr' AS success, 1::BIGINT AS execution_ms, count(*) AS n, count(*) AS ids, 'added' AS what
FROM m GROUP BY 1, 2
UNION ALL
SELECT type, lang <> 'de', 2, count(*), count(*), 'added' FROM m
WHERE NOT (type IN ('ops', 'data') AND lang <> 'de' AND lang <> 'fr') GROUP BY 1, 2
UNION ALL
SELECT type, TRUE, 2, count(*), 0, 'refused' FROM m
WHERE type IN ('ops', 'data') AND lang <> 'de' AND lang <> 'fr' GROUP BY 1""",
            i=ITEMS,
            m="SELECT * FROM i WHERE type <> 'reference'",
        ),
    ),
    "l_backfill_resume": Query(
        _backfilled,
        with_inputs(
            """SELECT id, version, name, success, filled, highest FROM (
  SELECT CAST(k + CASE WHEN k >= e THEN 1 ELSE 0 END AS BIGINT) AS id, lpad(CAST(k AS VARCHAR), 3, '0') AS version,
         event_type AS name, TRUE AS success, filled, highest FROM s
  UNION ALL
  SELECT CAST(k AS BIGINT), lpad(CAST(k AS VARCHAR), 3, '0'), event_type, FALSE, NULL, NULL FROM s WHERE k = e)""",
            g=EVENTS_WITH_GAPS,
            r="SELECT user_id, min(value) AS low FROM g GROUP BY user_id",
            s="""SELECT t.event_type, t.k, (SELECT count(DISTINCT event_type) FROM g WHERE event_type <= 'error') AS e,
       count(*) AS filled, max(CASE WHEN t.event_type = 'error' THEN coalesce(r.low, 0.0::DOUBLE) ELSE 0.0::DOUBLE END) AS highest
FROM (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM g)) t
JOIN g ON g.event_type = t.event_type AND g.value IS NULL LEFT JOIN r ON r.user_id = g.user_id GROUP BY t.event_type, t.k""",
        ),
    ),
    "s_evolve_stored": Query(
        _evolved,
        """SELECT o_orderkey, o_custkey, 'none' AS o_note, 0 AS o_shippriority,
       CAST(length(o_orderpriority) AS BIGINT) AS o_lines, CAST(NULL AS VARCHAR) AS o_clerk,
       o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, TRUE AS same_files FROM orders""",
    ),
}
