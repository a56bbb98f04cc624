"""Queries over declared rows: what differs, what to do, what comes out."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.compare import comparable, same
from evenkeel.operators import conform as cf
from evenkeel.operators import diff
from evenkeel.operators.constraints import prune_reach
from evenkeel.operators.converge import converge
from evenkeel.operators.evolve import drift
from evenkeel.operators.pair import DECLARED, IN_LIVE, LIVE, missing_rows, pair, unlisted_rows
from evenkeel.operators.spec import Column, ForeignKey, TableContract, order_by_foreign_keys
from evenkeel.plans.base import Query, in_spark, in_sql, table, with_inputs
from evenkeel.plans.evolve import DESIRED_CATALOG, LIVE_CATALOG
from evenkeel.session import new_path
from evenkeel.sources.bucketed import highest_values, keep_bucketed

KEY = ["c_custkey"]
VALUES = ["c_name", "c_nationkey", "c_mktsegment"]
NOW = datetime(2024, 6, 1, 12, 0, 0)

LIVE_ROWS = "SELECT * FROM {customer}"

# Customers in debt are not declared, the richest are declared a second time
# under a new key; rich ones move to another nation, nation 7 loses its segment.
DECLARED_ROWS = """
SELECT c_custkey, c_name,
       CASE WHEN c_acctbal > 8000 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS c_nationkey,
       CASE WHEN c_nationkey = 7 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM {customer} WHERE c_acctbal >= 0
UNION ALL
SELECT -1 - c_custkey AS c_custkey, c_name || '#new' AS c_name, c_nationkey, c_mktsegment
FROM {customer} WHERE c_acctbal > 9000
"""

# Live rows some of which lack a segment, so that NULL meets NULL.
LIVE_NULL_ROWS = """
SELECT c_custkey, c_name, c_nationkey, c_acctbal,
       CASE WHEN c_nationkey IN (7, 8) THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM {customer}
"""

# Declared rows that add the cases of a value gone and a value changed.
DECLARED_NULL_ROWS = """
SELECT c_custkey, CASE WHEN c_nationkey IN (7, 9) THEN NULL WHEN c_nationkey = 10 THEN lower(c_mktsegment)
       ELSE c_mktsegment END AS c_mktsegment
FROM {customer} WHERE c_acctbal >= 0
"""

LIVE_TOUCHED_ROWS = "SELECT *, TIMESTAMP '2020-01-01 00:00:00' AS updated_at FROM {customer}"


def _live(spark, d):
    return table(spark, d, "customer")


def _declared(spark, d):
    return in_spark(spark, d, DECLARED_ROWS)


def _feed(spark, d, prune=True):
    return diff.change_feed(_live(spark, d), _declared(spark, d), KEY, prune=prune)


def _flat(feed: DataFrame) -> DataFrame:
    """The feed without lists, and with whole numbers that may be NULL as text."""
    numbers = {c: F.col(c).cast("string") for c in ("old_c_nationkey", "new_c_nationkey")}
    return feed.withColumns({"changed": F.concat_ws(",", "changed"), **numbers})


BOTH = {"l": LIVE_ROWS, "r": DECLARED_ROWS}
SAME = (
    "l.c_name IS NOT DISTINCT FROM r.c_name AND l.c_nationkey IS NOT DISTINCT FROM r.c_nationkey "
    "AND l.c_mktsegment IS NOT DISTINCT FROM r.c_mktsegment"
)
UPDATES = f"""
SELECT 'update' AS op, r.c_custkey,
       concat_ws(',', CASE WHEN l.c_name IS DISTINCT FROM r.c_name THEN 'c_name' END,
                      CASE WHEN l.c_nationkey IS DISTINCT FROM r.c_nationkey THEN 'c_nationkey' END,
                      CASE WHEN l.c_mktsegment IS DISTINCT FROM r.c_mktsegment THEN 'c_mktsegment' END) AS changed,
       l.c_name AS old_c_name, l.c_nationkey AS old_c_nationkey, l.c_mktsegment AS old_c_mktsegment,
       r.c_name AS new_c_name, r.c_nationkey AS new_c_nationkey, r.c_mktsegment AS new_c_mktsegment
FROM r JOIN l ON l.c_custkey = r.c_custkey WHERE NOT ({SAME})
"""
INSERTS = """
SELECT 'insert' AS op, c_custkey, '' AS changed, NULL AS old_c_name, NULL AS old_c_nationkey,
       NULL AS old_c_mktsegment, c_name AS new_c_name, c_nationkey AS new_c_nationkey, c_mktsegment AS new_c_mktsegment
FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.c_custkey = r.c_custkey)
"""
DELETES = """
SELECT 'delete' AS op, c_custkey, '' AS changed, NULL AS old_c_name, NULL AS old_c_nationkey,
       NULL AS old_c_mktsegment, NULL AS new_c_name, NULL AS new_c_nationkey, NULL AS new_c_mktsegment
FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE l.c_custkey = r.c_custkey)
"""
FEED = f"{UPDATES} UNION ALL {INSERTS} UNION ALL {DELETES}"

FLAT = """SELECT * REPLACE (CAST(old_c_nationkey AS VARCHAR) AS old_c_nationkey,
                  CAST(new_c_nationkey AS VARCHAR) AS new_c_nationkey) FROM {}"""

# --- conform -----------------------------------------------------------------

PART_TEXT = """
SELECT p_partkey, p_name,
       CAST(p_partkey AS STRING) || '.' || CAST(p_size AS STRING) AS p_price,
       CASE WHEN p_size > 45 THEN p_type ELSE replace(p_brand, 'Brand#', ' ') END AS p_code
FROM {part}
"""
PART_CONTRACT = TableContract(
    "part_text",
    (
        Column("p_partkey", "bigint"),
        Column("p_name", "varchar(9)"),
        Column("p_price", "decimal(8,1)"),
        Column("p_code", "int"),
    ),
    ("p_partkey",),
)


def _conform(spark, d):
    kept = cf.conform_kept(in_spark(spark, d, PART_TEXT), PART_CONTRACT)
    return kept.withColumn("p_price", F.col("p_price").cast("string"))


def conform_rejects(spark, d):
    return cf.conform_rejects(in_spark(spark, d, PART_TEXT), PART_CONTRACT, ["p_partkey"])


REJECTED = """
SELECT p_partkey, 'p_name' AS column_name, p_name AS value,
       'value too long for type character varying(9)' AS reason
FROM p WHERE length(rtrim(p_name)) > 9
UNION ALL
SELECT p_partkey, 'p_price', p_price, 'invalid input syntax for type numeric(8,1)'
FROM p WHERE try_cast(p_price AS DECIMAL(8,1)) IS NULL
UNION ALL
SELECT p_partkey, 'p_code', p_code, 'invalid input syntax for type integer'
FROM p WHERE try_cast(p_code AS INTEGER) IS NULL
"""

# --- keys --------------------------------------------------------------------

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINES = """
SELECT l_orderkey, nullif(l_linenumber, 7) AS l_linenumber, l_partkey, l_suppkey FROM {lineitem}
"""

# --- values with their own equality -------------------------------------------

# What a digit in the props of an event makes of a number: two ways to write the same value, by any of
# which the second may hold another number. The last pair is never the same: text is not a number.
JSON_SHAPES = [
    ("{n}", "{n}.0"),
    ("{n}00", "{n}e2"),
    ('{{"k": {{"x": [{n}, 2]}}, "z": 1}}', '{{ "z":1.0,"k":{{"x":[{n}.00,2e0]}}}}'),
    ('[{n}, "{n}"]', '[{n}.0,"{n}"]'),
    ("1234567890123456789012345678901234567890{n}", "1234567890123456789012345678901234567890{n}.0"),
    ('{{"a": 1, "s": "1e2, {n}"}}', '{{"s":"1e2, {n}","a":10e-1}}'),
    ('{{"v": {n}.50}}', '{{"v":{n}.5E0}}'),
    ("[-{n}, -0]", "[-{n}.0e+00,0]"),
    (r'{{"t": "\u0041 {n}", "u": "\"{n}"}}', r'{{"u":"\u0022{n}","t":"A {n}"}}'),
    ('"{n}"', "{n}"),
]


def _json_equal(spark, d):
    events = table(spark, d, "events")
    shape = F.regexp_extract("props", "([0-9])", 1).cast("int")
    n = F.col("event_id").cast("string")
    other = (F.col("event_id") + F.when(F.col("event_type") == "error", 1).otherwise(0)).cast("string")

    def written(side, number):
        texts = [F.replace(F.lit(pair[side].replace("{n}", "#").format()), F.lit("#"), number) for pair in JSON_SHAPES]
        return F.get(F.array(*texts), shape)

    rows = events.select("event_id", shape.alias("shape"), written(0, n).alias("a"), written(1, other).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "event_id",
        "shape",
        same(a, b, "json").alias("is_equal"),
        same(F.array(a, b), F.array(b, a), "json[]").alias("arrays_equal"),
        (comparable(a, "json") == comparable(a, "json")).alias("same_as_itself"),
    )


def _null_safe(spark, d):
    live = in_spark(spark, d, LIVE_NULL_ROWS)
    met = pair(live.select(*KEY, "c_mktsegment"), in_spark(spark, d, DECLARED_NULL_ROWS), KEY, keep_unlisted=False)
    old, new = F.col(LIVE + "c_mktsegment"), F.col(DECLARED + "c_mktsegment")

    def kind(c):
        return F.when(c.isNull(), "NULL").otherwise("value")

    return (
        met.filter(F.col(IN_LIVE))
        .groupBy(kind(old).alias("live_value"), kind(new).alias("declared_value"), same(old, new).alias("is_equal"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- converge ----------------------------------------------------------------


def _converged_sql(live: str, undeclared: dict[str, str], prune: bool) -> str:
    """``undeclared``: SQL per undeclared column over ``l``, ``added`` and ``written``."""
    columns = ", ".join(f"{sql} AS {name}" for name, sql in undeclared.items())
    kind = "RIGHT" if prune else "FULL"
    return with_inputs(
        f"""SELECT coalesce(c_custkey, rk) AS c_custkey,
       CASE WHEN written THEN rn ELSE c_name END AS c_name,
       CASE WHEN written THEN rnk ELSE c_nationkey END AS c_nationkey,
       CASE WHEN written THEN rm ELSE c_mktsegment END AS c_mktsegment, {columns}
FROM m""",
        l=live,
        r=DECLARED_ROWS,
        m=f"""
SELECT l.*, r.c_custkey AS rk, r.c_name AS rn, r.c_nationkey AS rnk, r.c_mktsegment AS rm,
       l.c_custkey IS NULL AS added,
       r.c_custkey IS NOT NULL AND (l.c_custkey IS NULL OR NOT ({SAME})) AS written
FROM l {kind} JOIN r ON l.c_custkey = r.c_custkey""",
    )


def _converge(live_rows=LIVE_ROWS, **how):
    return lambda spark, d: converge(in_spark(spark, d, live_rows), _declared(spark, d), KEY, **how)


def _second_pass(spark, d):
    declared = _declared(spark, d)
    once = converge(_live(spark, d), declared, KEY, prune=True)
    return diff.plan_summary(diff.change_feed(once, declared, KEY, prune=True))


FIRST_PASS = f"""
SELECT r.c_custkey, CASE WHEN NOT ({SAME}) THEN r.c_name ELSE l.c_name END AS c_name,
       CASE WHEN NOT ({SAME}) THEN r.c_nationkey ELSE l.c_nationkey END AS c_nationkey,
       CASE WHEN NOT ({SAME}) THEN r.c_mktsegment ELSE l.c_mktsegment END AS c_mktsegment
FROM r LEFT JOIN l ON l.c_custkey = r.c_custkey
"""
SECOND_PASS = f"""
SELECT (SELECT count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.c_custkey = r.c_custkey)) AS inserts,
       (SELECT count(*) FROM r JOIN n ON n.c_custkey = r.c_custkey
        WHERE NOT ({SAME.replace("l.", "n.")})) AS updates,
       (SELECT count(*) FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE n.c_custkey = r.c_custkey)) AS deletes
"""

# --- several tables -----------------------------------------------------------

MULTI = {
    "customer": (["c_custkey"], LIVE_ROWS, DECLARED_ROWS),
    "nation": (
        ["n_nationkey"],
        "SELECT * FROM {nation}",
        "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN n_name || ' II' ELSE n_name END AS n_name, n_regionkey "
        "FROM {nation} WHERE n_regionkey <> 4 UNION ALL SELECT 25, 'NEWLAND', 5",
    ),
    "region": (
        ["r_regionkey"],
        "SELECT * FROM {region}",
        "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN r_name || ' II' ELSE r_name END AS r_name "
        "FROM {region} WHERE r_regionkey <> 4 UNION ALL SELECT 5, 'NEW REGION'",
    ),
}


def _multi_contracts() -> dict[str, TableContract]:
    nation_fk = ForeignKey("customer_nation", ("c_nationkey",), "nation", ("n_nationkey",))
    region_fk = ForeignKey("nation_region", ("n_regionkey",), "region", ("r_regionkey",))
    return {
        "customer": TableContract("customer", (), ("c_custkey",), foreign_keys=(nation_fk,)),
        "nation": TableContract("nation", (), ("n_nationkey",), foreign_keys=(region_fk,)),
        "region": TableContract("region", (), ("r_regionkey",)),
    }


def _multi_feed(spark, d):
    feeds = []
    for position, name in enumerate(order_by_foreign_keys(list(MULTI), _multi_contracts())):
        key, live, declared = MULTI[name]
        feed = diff.change_feed(in_spark(spark, d, live), in_spark(spark, d, declared), key, prune=True)
        feeds.append(
            feed.select(
                F.lit(position).alias("position"),
                F.lit(name).alias("table_name"),
                "op",
                F.col(key[0]).cast("long").alias("row_key"),
                F.concat_ws(",", "changed").alias("changed"),
            )
        )
    return feeds[0].unionByName(feeds[1]).unionByName(feeds[2])


def _multi_sql() -> str:
    def one(position, name, key, columns):
        changed = ", ".join(f"CASE WHEN l.{c} IS DISTINCT FROM r.{c} THEN '{c}' END" for c in columns)
        differs = " OR ".join(f"l.{c} IS DISTINCT FROM r.{c}" for c in columns)
        _, live, declared = MULTI[name]
        return f"""
SELECT {position} AS position, '{name}' AS table_name,
       CASE WHEN l.{key} IS NULL THEN 'insert' WHEN r.{key} IS NULL THEN 'delete' ELSE 'update' END AS op,
       CAST(coalesce(r.{key}, l.{key}) AS BIGINT) AS row_key,
       CASE WHEN l.{key} IS NULL OR r.{key} IS NULL THEN '' ELSE concat_ws(',', {changed}) END AS changed
FROM ({in_sql(live)}) l FULL JOIN ({in_sql(declared)}) r ON l.{key} = r.{key}
WHERE l.{key} IS NULL OR r.{key} IS NULL OR {differs}"""

    return " UNION ALL ".join(
        [
            one(0, "region", "r_regionkey", ["r_name"]),
            one(1, "nation", "n_nationkey", ["n_name", "n_regionkey"]),
            one(2, "customer", "c_custkey", VALUES),
        ]
    )


# --- prune reach, surrogate keys, reports ---------------------------------------


def _prune_reach(spark, d):
    deleted = unlisted_rows(_live(spark, d), _declared(spark, d), KEY)
    return prune_reach(
        deleted, table(spark, d, "orders"), [("o_custkey", "c_custkey")], "orders_customer", "CASCADE", ["c_nationkey"]
    )


BUCKETS = 16
STORED = {"customer": ("c_custkey", 0), "orders": ("o_orderkey", 10**15), "part": ("p_partkey", 1)}


def _next_key(spark, d):
    """Of some tables the next value of a key, from what is stored and the footers of their files."""
    found = []
    for name, (column, stored) in STORED.items():
        highest = highest_values(spark, f"{d}/{name}.parquet", [column])[column]
        found.append((name, max(stored, highest or 0) + 1))
    return spark.createDataFrame(found, "table_name string, next_value long")


def _bucketed_feed(spark, d):
    """The feed between tables kept by their key, in the form for two large sides: nothing is shuffled."""
    database = f"evenkeel_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{new_path(spark, 'bucketed')}'")
    live = keep_bucketed(_live(spark, d), f"{database}.live", KEY, BUCKETS)
    declared = keep_bucketed(_declared(spark, d), f"{database}.declared", KEY, BUCKETS)
    return _flat(diff.change_feed(live, declared, KEY, prune=True, broadcast_rows=0))


NEXT_KEY = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, greatest({stored}, max({column})) + 1 AS next_value FROM {name}"
    for name, (column, stored) in STORED.items()
)

LITERAL = "coalesce('''' || replace(CAST({c} AS VARCHAR), '''', '''''') || '''', 'NULL')"


def _lines_sql() -> str:
    def lit(c):
        return LITERAL.format(c=c)

    assigned = " || ".join(f"' {c}=' || {lit('new_' + c)}" for c in VALUES)
    replaced = ", ".join(
        f"CASE WHEN list_contains(string_split(changed, ','), '{c}') "
        f"THEN '{c}: ' || {lit('old_' + c)} || ' → ' || {lit('new_' + c)} END"
        for c in VALUES
    )
    return with_inputs(
        f"""SELECT op, CAST(position AS INTEGER) AS position,
       CASE op WHEN 'insert' THEN '+ (' || {lit('c_custkey')} || ')' || {assigned}
               WHEN 'update' THEN '~ (' || {lit('c_custkey')} || ') ' || concat_ws(', ', {replaced})
               ELSE '- (' || {lit('c_custkey')} || ')' END AS line
FROM n WHERE position <= 20
UNION ALL
SELECT op, 21, '  … and ' || (count(*) - 20) || ' more' FROM f GROUP BY op HAVING count(*) > 20""",
        **BOTH,
        f=FEED,
        n="SELECT *, row_number() OVER (PARTITION BY op ORDER BY c_custkey) AS position FROM f",
    )


def _summary(spark, d):
    return diff.plan_summary(_feed(spark, d)).select(F.lit("customer").alias("table_name"), "*")


def _gate(spark, d):
    live = _live(spark, d)
    shape = drift(in_spark(spark, d, LIVE_CATALOG), in_spark(spark, d, DESIRED_CATALOG))
    feed = _feed(spark, d)
    as_it_is = diff.change_feed(live, live.select(*KEY, *VALUES), KEY, prune=True)
    return (
        diff.pending_gate(feed, "customer")
        .unionByName(diff.pending_gate(as_it_is, "as_it_is"))
        .unionByName(diff.pending_gate(feed, "reshaped", shape))
    )


GATE = """
SELECT 'customer' AS table_name, CASE WHEN EXISTS (SELECT 1 FROM f) THEN 'pending' ELSE 'converged' END AS state
UNION ALL
SELECT 'as_it_is', CASE WHEN EXISTS (
    SELECT 1 FROM l WHERE NOT EXISTS (SELECT 1 FROM l k WHERE k.c_custkey = l.c_custkey)) THEN 'pending'
    ELSE 'converged' END
UNION ALL
SELECT 'reshaped', CASE WHEN EXISTS (
    SELECT 1 FROM c FULL JOIN w USING (namespace, table_name, column_name) WHERE c.type IS DISTINCT FROM w.type)
    THEN 'cannot diff yet' ELSE 'pending' END
"""


def _sql(body: str, **inputs: str) -> str:
    return with_inputs(body, **(inputs or BOTH))


QUERIES = {
    "r_change_feed": Query(lambda s, d: _flat(_feed(s, d)), _sql(FLAT.format("f"), **BOTH, f=FEED)),
    "r_change_feed_bucketed": Query(_bucketed_feed, _sql(FLAT.format("f"), **BOTH, f=FEED)),
    "r_inserts": Query(
        lambda s, d: missing_rows(_live(s, d), _declared(s, d), KEY),
        _sql("SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.c_custkey = r.c_custkey)"),
    ),
    "r_updates": Query(lambda s, d: _flat(diff.updates(_feed(s, d, prune=False))), _sql(FLAT.format("u"), **BOTH, u=UPDATES)),
    "r_update_columns": Query(
        lambda s, d: diff.update_columns(_feed(s, d, prune=False), KEY),
        _sql(
            " UNION ALL ".join(
                f"SELECT r.c_custkey, '{c}' AS column_name, CAST(l.{c} AS VARCHAR) AS old_value, "
                f"CAST(r.{c} AS VARCHAR) AS new_value FROM r JOIN l ON l.c_custkey = r.c_custkey "
                f"WHERE l.{c} IS DISTINCT FROM r.{c}"
                for c in VALUES
            )
        ),
    ),
    "r_deletes": Query(
        lambda s, d: unlisted_rows(_live(s, d).select(*KEY), _declared(s, d), KEY),
        _sql("SELECT c_custkey FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE l.c_custkey = r.c_custkey)"),
    ),
    "r_null_safe": Query(
        _null_safe,
        _sql(
            """SELECT CASE WHEN l.c_mktsegment IS NULL THEN 'NULL' ELSE 'value' END AS live_value,
       CASE WHEN r.c_mktsegment IS NULL THEN 'NULL' ELSE 'value' END AS declared_value,
       l.c_mktsegment IS NOT DISTINCT FROM r.c_mktsegment AS is_equal, count(*) AS n
FROM l JOIN r ON l.c_custkey = r.c_custkey GROUP BY 1, 2, 3""",
            l=LIVE_NULL_ROWS,
            r=DECLARED_NULL_ROWS,
        ),
    ),
    "r_json_equal": Query(
        _json_equal,
        """SELECT event_id, CAST(regexp_extract(props, '([0-9])', 1) AS INTEGER) AS shape,
       event_type <> 'error' AND shape < 9 AS is_equal, is_equal AS arrays_equal, TRUE AS same_as_itself FROM events""",
    ),
    "r_conform": Query(
        _conform,
        _sql(
            """SELECT p_partkey, p_name, CAST(CAST(p_price AS DECIMAL(8,1)) AS VARCHAR) AS p_price,
       CAST(p_code AS INTEGER) AS p_code
FROM p WHERE length(rtrim(p_name)) <= 9 AND try_cast(p_price AS DECIMAL(8,1)) IS NOT NULL
         AND try_cast(p_code AS INTEGER) IS NOT NULL""",
            p=PART_TEXT,
        ),
    ),
    "r_conform_rejects": Query(conform_rejects, _sql(REJECTED, p=PART_TEXT)),
    "r_null_keys": Query(
        lambda s, d: cf.null_keys(in_spark(s, d, LINES), LINE_KEY).select(
            "l_orderkey", F.col("l_linenumber").cast("string").alias("l_linenumber"), "l_partkey", "l_suppkey"
        ),
        _sql(
            """SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_partkey, l_suppkey FROM k
WHERE l_orderkey IS NULL OR l_linenumber IS NULL""",
            k=LINES,
        ),
    ),
    "r_duplicate_keys": Query(
        lambda s, d: cf.duplicate_keys(table(s, d, "lineitem"), LINE_KEY),
        "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 5",
    ),
    "r_live_key_duplicates": Query(
        lambda s, d: cf.key_counts(table(s, d, "lineitem"), LINE_KEY),
        "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "r_converge": Query(_converge(), _converged_sql(LIVE_ROWS, {"c_acctbal": "c_acctbal"}, False)),
    "r_converge_prune": Query(_converge(prune=True), _converged_sql(LIVE_ROWS, {"c_acctbal": "c_acctbal"}, True)),
    "r_converge_touch": Query(
        _converge(LIVE_TOUCHED_ROWS, touch=["updated_at"], now=NOW),
        _converged_sql(
            LIVE_TOUCHED_ROWS,
            {
                "c_acctbal": "c_acctbal",
                "updated_at": f"CASE WHEN written THEN TIMESTAMP '{NOW}' ELSE updated_at END",
            },
            False,
        ),
    ),
    "r_insert_defaults": Query(
        _converge(defaults={"c_acctbal": "CAST(0 AS DOUBLE)"}),
        _converged_sql(LIVE_ROWS, {"c_acctbal": "CASE WHEN added THEN 0.0::DOUBLE ELSE c_acctbal END"}, False),
    ),
    "r_second_pass_empty": Query(_second_pass, _sql(SECOND_PASS, **BOTH, n=FIRST_PASS)),
    "r_multi_table_feed": Query(_multi_feed, _multi_sql()),
    "r_prune_reach": Query(
        _prune_reach,
        _sql(
            """SELECT 'orders_customer' AS constraint_name, 'CASCADE' AS action, l.c_nationkey,
       CAST(sum(o.n) AS BIGINT) AS rows_reached, count(*) AS parents
FROM l JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = l.c_custkey
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.c_custkey = l.c_custkey) GROUP BY l.c_nationkey"""
        ),
    ),
    "r_next_key": Query(_next_key, NEXT_KEY),
    "r_plan_lines": Query(lambda s, d: diff.plan_lines(_feed(s, d), KEY), _lines_sql()),
    "r_plan_summary": Query(
        _summary,
        _sql(
            """SELECT 'customer' AS table_name, count(*) FILTER (WHERE op = 'insert') AS inserts,
       count(*) FILTER (WHERE op = 'update') AS updates, count(*) FILTER (WHERE op = 'delete') AS deletes FROM f""",
            **BOTH,
            f=FEED,
        ),
    ),
    "r_pending_gate": Query(_gate, _sql(GATE, **BOTH, f=FEED, c=LIVE_CATALOG, w=DESIRED_CATALOG)),
}
