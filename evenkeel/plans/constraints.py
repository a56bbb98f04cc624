"""Queries over broken rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.operators import constraints as cs
from evenkeel.operators.cascade import Cascade
from evenkeel.operators.pair import missing_rows
from evenkeel.operators.rejects import reject_summary
from evenkeel.operators.spec import ForeignKey, TableContract
from evenkeel.plans.base import Query, in_spark, table, with_inputs
from evenkeel.plans.reconcile import (
    DECLARED_ROWS,
    KEY,
    LINE_KEY,
    LINES,
    LIVE_ROWS,
    PART_TEXT,
    REJECTED,
    conform_rejects,
)

DOCUMENTS_WITH_NULLS = """
SELECT doc_id, nullif(lang, 'de') AS lang, nullif(source, 'src3') AS source, text FROM {documents}
"""
DOCUMENTS_WITH_DRIFT = """
SELECT doc_id, text, CASE WHEN lang = 'es' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM {documents}
"""
CREDITORS = "SELECT * FROM {customer} WHERE c_acctbal >= 0"
DEBTORS = "SELECT * FROM {customer} WHERE c_acctbal < 0"
ORDER_CUSTOMER = [("o_custkey", "c_custkey")]
DISCOUNT_RULE = "l_discount <= 0.05 OR l_returnflag = 'N'"


def _action(action: str, **how):
    return lambda s, d: cs.fk_action(table(s, d, "orders"), in_spark(s, d, DEBTORS), ORDER_CUSTOMER, action, **how)


def _freed_sql(value: str) -> str:
    return with_inputs(
        f"""SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM g WHERE c_custkey = o_custkey) THEN {value}
            ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""",
        g=DEBTORS,
    )


def _identity_fill(spark, d):
    live = table(spark, d, "customer")
    added = missing_rows(live, in_spark(spark, d, DECLARED_ROWS), KEY)
    start = live.agg(F.max("c_custkey")).first()[0]
    return cs.identity_fill(added, "new_id", KEY, start)


def _key(name: str, column: str, parent: str, key: str, action: str) -> ForeignKey:
    return ForeignKey(name, (column,), parent, (key,), action)


TREE = [
    TableContract("region", (), ("r_regionkey",)),
    TableContract(
        "nation", (), ("n_nationkey",), foreign_keys=(_key("nation_region", "n_regionkey", "region", "r_regionkey", "CASCADE"),)
    ),
    TableContract(
        "supplier", (), ("s_suppkey",), foreign_keys=(_key("supplier_nation", "s_nationkey", "nation", "n_nationkey", "SET NULL"),)
    ),
    TableContract(
        "customer", (), ("c_custkey",), foreign_keys=(_key("customer_nation", "c_nationkey", "nation", "n_nationkey", "CASCADE"),)
    ),
    TableContract(
        "orders", (), ("o_orderkey",), foreign_keys=(_key("orders_customer", "o_custkey", "customer", "c_custkey", "CASCADE"),)
    ),
    TableContract(
        "lineitem",
        (),
        ("l_orderkey", "l_linenumber"),
        foreign_keys=(
            _key("lineitem_orders", "l_orderkey", "orders", "o_orderkey", "RESTRICT"),
            _key("lineitem_supplier", "l_suppkey", "supplier", "s_suppkey", "NO ACTION"),
        ),
    ),
]
GONE = "SELECT r_regionkey FROM {region} WHERE r_name LIKE 'A%A'"


def _cascade_reach(spark, d):
    cascade = Cascade({c.name: table(spark, d, c.name) for c in TREE}, TREE)
    return cascade.reach({"region": in_spark(spark, d, GONE)})


def _rejects(spark, d):
    """What conforming the parts and checking the lines refuses, the lines met twice."""
    values = conform_rejects(spark, d).select(
        F.col("reason").alias("kind"),
        F.concat("column_name", F.lit("="), "value").alias("detail"),
        F.col("p_partkey").alias("seq"),
    )
    lines = cs.check_violations(table(spark, d, "lineitem"), DISCOUNT_RULE).select(
        F.lit("check l_discount").alias("kind"),
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("detail"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return values.unionByName(lines).unionByName(lines)


QUERIES = {
    "c_not_null": Query(
        lambda s, d: cs.not_null_violations(in_spark(s, d, DOCUMENTS_WITH_NULLS), ["doc_id", "lang", "source"]),
        with_inputs(
            """SELECT 'lang' AS column_name, count(*) AS n FROM n WHERE lang IS NULL HAVING count(*) > 0
UNION ALL SELECT 'source', count(*) FROM n WHERE source IS NULL HAVING count(*) > 0
UNION ALL SELECT 'doc_id', count(*) FROM n WHERE doc_id IS NULL HAVING count(*) > 0""",
            n=DOCUMENTS_WITH_NULLS,
        ),
    ),
    "c_unique": Query(
        lambda s, d: cs.unique_violations(in_spark(s, d, LINES), LINE_KEY),
        with_inputs(
            """SELECT l_orderkey, l_linenumber, count(*) AS n FROM k
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""",
            k=LINES,
        ),
    ),
    "c_check": Query(
        lambda s, d: cs.check_violations(table(s, d, "lineitem"), DISCOUNT_RULE),
        f"SELECT * FROM lineitem WHERE NOT ({DISCOUNT_RULE})",
    ),
    "c_fk_orphans": Query(
        lambda s, d: cs.fk_orphans(table(s, d, "orders"), in_spark(s, d, CREDITORS), ORDER_CUSTOMER),
        with_inputs(
            """SELECT * FROM orders WHERE o_custkey IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM p WHERE c_custkey = o_custkey)""",
            p=CREDITORS,
        ),
    ),
    "c_fk_action": Query(
        _action("CASCADE"),
        with_inputs("SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM g WHERE c_custkey = o_custkey)", g=DEBTORS),
    ),
    "c_fk_action_set_null": Query(
        lambda s, d: _action("SET NULL")(s, d).withColumn("o_custkey", F.col("o_custkey").cast("string")),
        f"SELECT * REPLACE (CAST(o_custkey AS VARCHAR) AS o_custkey) FROM ({_freed_sql('NULL')})",
    ),
    "c_fk_action_set_default": Query(_action("SET DEFAULT", defaults={"o_custkey": "0"}), _freed_sql("0")),
    "c_fk_action_restrict": Query(
        _action("RESTRICT"),
        with_inputs("SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM g WHERE c_custkey = o_custkey)", g=DEBTORS),
    ),
    "c_fk_cascade_reach": Query(
        _cascade_reach,
        with_inputs(
            """SELECT * FROM (
  SELECT 'nation' AS table_name, 'nation_region' AS constraint_name, 'CASCADE' AS action, count(*) AS rows_reached FROM n
  UNION ALL SELECT 'customer', 'customer_nation', 'CASCADE', count(*) FROM c
  UNION ALL SELECT 'supplier', 'supplier_nation', 'SET NULL', count(*) FROM supplier
            WHERE s_nationkey IN (SELECT n_nationkey FROM n)
  UNION ALL SELECT 'orders', 'orders_customer', 'CASCADE', count(*) FROM o
  UNION ALL SELECT 'lineitem', 'lineitem_orders', 'RESTRICT', count(*) FROM lineitem
            WHERE l_orderkey IN (SELECT o_orderkey FROM o)) WHERE rows_reached > 0""",
            g=GONE,
            n="SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM g)",
            c="SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)",
            o="SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)",
        ),
    ),
    "c_generated": Query(
        lambda s, d: cs.generated_mismatches(
            in_spark(s, d, DOCUMENTS_WITH_DRIFT), "n_chars", "CAST(length(text) AS BIGINT)", ["doc_id"]
        ),
        with_inputs(
            """SELECT doc_id, n_chars AS stored, CAST(length(text) AS BIGINT) AS expected FROM g
WHERE n_chars IS DISTINCT FROM length(text)""",
            g=DOCUMENTS_WITH_DRIFT,
        ),
    ),
    "c_identity_fill": Query(
        _identity_fill,
        with_inputs(
            """SELECT r.*, (SELECT max(c_custkey) FROM l) + row_number() OVER (ORDER BY c_custkey) AS new_id FROM r
WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.c_custkey = r.c_custkey)""",
            l=LIVE_ROWS,
            r=DECLARED_ROWS,
        ),
    ),
    "x_reject_summary": Query(
        lambda s, d: reject_summary(_rejects(s, d)),
        with_inputs(
            """SELECT kind, count(*) AS n, arg_min(detail, seq) AS example, min(seq) AS first_seq
FROM (SELECT detail, kind, min(seq) AS seq FROM a GROUP BY detail, kind) GROUP BY kind""",
            p=PART_TEXT,
            q=REJECTED,
            a=f"""SELECT reason AS kind, column_name || '=' || value AS detail, p_partkey AS seq FROM q
UNION ALL SELECT 'check l_discount', l_orderkey || '/' || l_linenumber, l_orderkey * 10 + l_linenumber FROM lineitem
WHERE NOT ({DISCOUNT_RULE})""",
        ),
    ),
}
