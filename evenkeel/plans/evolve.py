"""Queries over table shapes. Every event stands for a column of some table."""

from __future__ import annotations


from evenkeel.operators import evolve as ev
from evenkeel.operators.spec import Column
from evenkeel.plans.base import Query, in_spark, table, with_inputs

LIVE_CATALOG = """
SELECT event_type AS namespace, concat('t', user_id) AS table_name, concat('c', event_id) AS column_name,
       CASE WHEN value > 50 THEN 'decimal(10,2)' WHEN value > 10 THEN 'int' ELSE 'text' END AS type,
       value > 5 AS nullable, CASE WHEN value < 1 THEN '0' END AS default_expr
FROM {events}
"""

# Nothing of signup is declared, nor of users above 100; some columns are gone,
# some have another type, nullability or default, some are new.
DESIRED_CATALOG = """
SELECT event_type AS namespace, concat('t', user_id) AS table_name, concat('c', event_id) AS column_name,
       CASE WHEN value > 100 THEN 'bigint' WHEN value > 50 THEN 'decimal(10,2)' WHEN value > 10 THEN 'int'
            ELSE 'text' END AS type,
       value > 5 AND NOT (value > 20 AND value < 22) AS nullable,
       CASE WHEN value < 0.5 THEN '1' WHEN value < 1 THEN '0' END AS default_expr
FROM {events} WHERE event_type <> 'signup' AND user_id <= 100 AND NOT (value > 3 AND value < 4)
UNION ALL
SELECT event_type AS namespace, concat('t', user_id) AS table_name, concat('n', event_id) AS column_name,
       'text' AS type, TRUE AS nullable, CAST(NULL AS STRING) AS default_expr
FROM {events} WHERE event_type <> 'signup' AND user_id <= 100 AND value > 90
"""


def _drift(strict: bool):
    return lambda s, d: ev.drift(in_spark(s, d, LIVE_CATALOG), in_spark(s, d, DESIRED_CATALOG), strict=strict)


def _drift_sql(strict: bool) -> str:
    scope = "w.namespace = j.namespace" + ("" if strict else " AND w.table_name = j.table_name")
    return with_inputs(
        f"""SELECT namespace, table_name, column_name, 'column_added' AS kind, NULL AS live_value, wt AS desired_value
FROM j WHERE NOT in_live
UNION ALL
SELECT namespace, table_name, column_name, 'column_dropped', lt, NULL FROM j
WHERE NOT in_desired AND EXISTS (SELECT 1 FROM w WHERE {scope})
UNION ALL
SELECT namespace, table_name, column_name, 'type_changed', lt, wt FROM j
WHERE in_live AND in_desired AND lt IS DISTINCT FROM wt
UNION ALL
SELECT namespace, table_name, column_name, 'nullability_changed', CAST(ln AS VARCHAR), CAST(wn AS VARCHAR) FROM j
WHERE in_live AND in_desired AND ln IS DISTINCT FROM wn
UNION ALL
SELECT namespace, table_name, column_name, 'default_changed', ld, wd FROM j
WHERE in_live AND in_desired AND ld IS DISTINCT FROM wd""",
        c=LIVE_CATALOG,
        w=DESIRED_CATALOG,
        j="""SELECT coalesce(c.namespace, w.namespace) AS namespace, coalesce(c.table_name, w.table_name) AS table_name,
       coalesce(c.column_name, w.column_name) AS column_name, c.namespace IS NOT NULL AS in_live,
       w.namespace IS NOT NULL AS in_desired, c.type AS lt, w.type AS wt, c.nullable AS ln, w.nullable AS wn,
       c.default_expr AS ld, w.default_expr AS wd
FROM c FULL JOIN w ON c.namespace = w.namespace AND c.table_name = w.table_name AND c.column_name = w.column_name""",
    )


PART_SHAPE = [
    Column("p_size", "bigint"),
    Column("p_partkey", "bigint"),
    Column("p_name", "varchar(12)"),
    Column("p_brand", "string"),
    Column("p_retailprice", "double"),
    Column("p_note", "string", nullable=False, default="''"),
]

DECLARED_NAMESPACES = "SELECT concat(lang, '_', source) AS namespace FROM {documents} UNION ALL SELECT 'public'"
EXISTING_NAMESPACES = "SELECT concat(lang, '_', source) AS namespace FROM {documents} WHERE n_chars > 10000"

QUERIES = {
    "s_drift": Query(_drift(False), _drift_sql(False)),
    "s_drift_strict": Query(_drift(True), _drift_sql(True)),
    "s_evolve": Query(
        lambda s, d: ev.evolve(table(s, d, "part"), PART_SHAPE),
        "SELECT CAST(p_size AS BIGINT) AS p_size, p_partkey, p_name, p_brand, p_retailprice, '' AS p_note, p_type FROM part",
    ),
    "s_evolve_strict": Query(
        lambda s, d: ev.evolve(table(s, d, "part"), PART_SHAPE, strict=True),
        "SELECT CAST(p_size AS BIGINT) AS p_size, p_partkey, p_name, p_brand, p_retailprice, '' AS p_note FROM part",
    ),
    "s_missing_namespaces": Query(
        lambda s, d: ev.missing_namespaces(in_spark(s, d, DECLARED_NAMESPACES), in_spark(s, d, EXISTING_NAMESPACES)),
        with_inputs(
            """SELECT DISTINCT namespace FROM w WHERE namespace <> 'public'
AND NOT EXISTS (SELECT 1 FROM e WHERE e.namespace = w.namespace)""",
            w=DECLARED_NAMESPACES,
            e=EXISTING_NAMESPACES,
        ),
    ),
}
