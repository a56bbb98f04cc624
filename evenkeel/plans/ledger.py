"""Queries over work that is remembered. Every document is an item."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from evenkeel.operators import ledger as lg
from evenkeel.plans.base import Query, in_spark, table, with_inputs
from evenkeel.sources.manifest import parse_manifest

AT = datetime(2024, 7, 1, 8, 30, 0)
BY = "keeper"
BASELINE_VERSION = "5"

ITEM_COLUMNS = """
CASE doc_id % 6 WHEN 0 THEN 'ops' WHEN 1 THEN 'schema' WHEN 2 THEN 'logic' WHEN 3 THEN 'permissions'
                WHEN 4 THEN 'reference' ELSE 'data' END AS type,
CASE WHEN doc_id % 6 IN (0, 5) THEN CAST(doc_id AS STRING) END AS version,
concat('doc_', doc_id) AS name,
CASE WHEN doc_id % 6 = 1 THEN lang END AS namespace
"""

# In Spark the checksum is the operator under test, so it is not part of the text.
ITEMS = f"SELECT doc_id, text, lang, source, n_chars, {ITEM_COLUMNS} FROM {{documents}}"

MANIFEST_SQL = "SELECT type, version, name, namespace, sha256(text) AS checksum FROM i"

# Items in Spanish never ran, those in French failed the first time, those in
# German have changed since. Long ones ran again a day later.
LEDGER_SQL = """
SELECT doc_id * 2 + 1 AS id, version, name, type, namespace,
       CASE WHEN lang = 'de' THEN sha256(text || 'x') ELSE sha256(text) END AS checksum,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS applied_at, n_chars AS execution_ms,
       source AS applied_by, lang <> 'fr' AS success
FROM i WHERE lang <> 'es' AND type <> 'reference'
UNION ALL
SELECT doc_id * 2 + 2, version, name, type, namespace, sha256(text),
       TIMESTAMP '2024-01-02 00:00:00' + to_seconds(doc_id), n_chars, source, TRUE
FROM i WHERE lang <> 'es' AND type <> 'reference' AND n_chars > 1000
"""

ITEM_KEY = """type AS item_type, CASE WHEN type IN ('ops', 'data') THEN version ELSE coalesce(namespace, '') END AS item_scope,
       CASE WHEN type IN ('ops', 'data') THEN '' ELSE name END AS item_name"""

LATEST_SQL = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY item_type, item_scope, item_name ORDER BY applied_at DESC, id DESC) AS rn
  FROM (SELECT {ITEM_KEY}, h.* FROM h WHERE success))
WHERE rn = 1
"""

STATE_SQL = f"""
SELECT k.*, e.item_type IS NOT NULL AS done, e.checksum AS applied_checksum
FROM (SELECT m.*, {ITEM_KEY} FROM m) k
LEFT JOIN e ON e.item_type = k.item_type AND e.item_scope = k.item_scope AND e.item_name = k.item_name
"""

STATUS_SQL = """
SELECT type, version, name, namespace, checksum,
       CASE WHEN type = 'reference' THEN 'diffed' WHEN NOT done THEN 'pending'
            WHEN checksum = applied_checksum THEN 'applied' WHEN type IN ('ops', 'data') THEN 'drift'
            ELSE 'changed' END AS status
FROM j
"""

# What a run over the items would come to: every seventh fails.
OUTCOMES_SQL = """
SELECT version, name, type, namespace, checksum, 7::BIGINT AS execution_ms,
       CASE WHEN status IN ('pending', 'changed') THEN split_part(name, '_', 2)::BIGINT % 7 <> 0 END AS success
FROM st
"""

PATHS = """
SELECT doc_id, text AS content,
       CASE doc_id % 6
         WHEN 0 THEN concat('ops/', CASE WHEN lang = 'es' THEN 'note' ELSE concat(20240000 + doc_id, '_001') END,
                            '__add_', source, '_', lang, '.sql')
         WHEN 1 THEN concat('schema/', lang, '/doc_', doc_id, '.sql')
         WHEN 2 THEN concat('logic/proc_', doc_id, CASE WHEN lang = 'fr' THEN '.txt' ELSE '.sql' END)
         WHEN 3 THEN concat('permissions/', CASE WHEN lang = 'de' THEN 'old/' ELSE '' END, 'grant_', doc_id, '.sql')
         WHEN 4 THEN concat('reference/', source, '_', doc_id, '.sql')
         ELSE concat('data/', 20240000 + doc_id, '__fill_', source, '.sql') END AS path,
       CASE doc_id % 4
         WHEN 0 THEN concat('V', doc_id, '_1__add_', source, '.sql') WHEN 1 THEN concat('S__', source, '_', doc_id, '.sql')
         WHEN 2 THEN concat('R__view_', doc_id, '.sql') ELSE concat('note_', doc_id, '.sql') END AS flat_path
FROM {documents}
"""


def manifest(spark, d):
    return in_spark(spark, d, ITEMS).select(
        "type", "version", "name", "namespace", lg.checksum(F.col("text")).alias("checksum")
    )


def _with_unknown_types(entries):
    """The ledger with types nobody knows on the entries that took longest."""
    old = F.concat(F.lit("old "), F.col("type"))
    return entries.withColumn("type", F.when(F.col("execution_ms") > 3000, old).otherwise(F.col("type")))


def ledger(spark, d):
    items = in_spark(spark, d, ITEMS).filter("lang <> 'es' AND type <> 'reference'")

    def run(offset, start, content, success):
        return items.select(
            (F.col("doc_id") * 2 + offset).alias("id"),
            "version",
            "name",
            "type",
            "namespace",
            lg.checksum(content).alias("checksum"),
            F.timestamp_seconds(F.lit(start) + F.col("doc_id")).alias("applied_at"),
            F.col("n_chars").alias("execution_ms"),
            F.col("source").alias("applied_by"),
            success.alias("success"),
            "n_chars",
        )

    edited = F.when(F.col("lang") == "de", F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    first = run(1, 1704067200, edited, F.col("lang") != "fr")
    second = run(2, 1704153600, F.col("text"), F.lit(True)).filter("n_chars > 1000")
    return first.unionByName(second).drop("n_chars")


def _outcomes(spark, d):
    state = lg.status(manifest(spark, d), ledger(spark, d))
    runs = F.col("status").isin("pending", "changed")
    # Stands in for running the items: every seventh fails.
    succeeded = F.split("name", "_")[1].cast("long") % 7 != 0
    return lg.results(state, F.lit(7), F.when(runs, succeeded))


def _record(spark, d):
    entries = ledger(spark, d)
    last = entries.agg(F.max("id")).first()[0]
    return lg.recorded(_outcomes(spark, d).filter("success IS NOT NULL"), last, AT, BY)


def _backfill(version):
    def run(spark, d):
        events = in_spark(spark, d, EVENTS_WITH_GAPS)
        return lg.backfill_once(events, {"value": "CAST(0 AS DOUBLE)"}, ledger(spark, d), version)

    return run


EVENTS_WITH_GAPS = """
SELECT event_id, user_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM {events}
"""


def _sql(body: str) -> str:
    return with_inputs(
        body,
        i=ITEMS,
        m=MANIFEST_SQL,
        h=LEDGER_SQL,
        e=LATEST_SQL,
        j=STATE_SQL,
        st=STATUS_SQL,
        oc=OUTCOMES_SQL,
        ev=EVENTS_WITH_GAPS,
        pa=PATHS,
    )


def _backfill_sql(version: str) -> str:
    return _sql(
        f"""SELECT event_id, user_id, event_type,
       CASE WHEN EXISTS (SELECT 1 FROM h WHERE type = 'data' AND version = '{version}' AND success) THEN value
            ELSE coalesce(value, 0.0::DOUBLE) END AS value FROM ev"""
    )


MANIFEST_COLUMNS = "type, version, name, namespace, checksum"

QUERIES = {
    "l_manifest": Query(
        lambda s, d: parse_manifest(in_spark(s, d, PATHS)),
        _sql(
            r"""SELECT split_part(path, '/', 1) AS type, version, name, namespace, sha256(content) AS checksum,
       path AS filename
FROM (SELECT *,
        CASE WHEN path LIKE 'ops/%' OR path LIKE 'data/%'
             THEN regexp_extract(path, '^[a-z]+/(\d+(?:_\d+)*)__(.+)\.sql$', 1) END AS version,
        CASE WHEN path LIKE 'ops/%' OR path LIKE 'data/%'
             THEN replace(regexp_extract(path, '^[a-z]+/(\d+(?:_\d+)*)__(.+)\.sql$', 2), '_', ' ')
             ELSE regexp_extract(path, '([^/]+)\.sql$', 1) END AS name,
        CASE WHEN path LIKE 'schema/%' THEN split_part(path, '/', 2) END AS namespace FROM pa)
WHERE name <> '' AND NOT (path LIKE 'permissions/%/%')"""
        ),
    ),
    "l_manifest_flat": Query(
        lambda s, d: parse_manifest(in_spark(s, d, PATHS).withColumn("path", F.col("flat_path")), "flat"),
        _sql(
            r"""SELECT CASE left(flat_path, 1) WHEN 'V' THEN 'ops' WHEN 'S' THEN 'schema' ELSE 'logic' END AS type,
       CASE WHEN left(flat_path, 1) = 'V' THEN regexp_extract(flat_path, '^V([0-9_]+)__', 1) END AS version,
       CASE WHEN left(flat_path, 1) = 'V' THEN replace(regexp_extract(flat_path, '__(.+)\.sql$', 1), '_', ' ')
            ELSE regexp_extract(flat_path, '__(.+)\.sql$', 1) END AS name,
       CASE WHEN left(flat_path, 1) = 'S' THEN 'public' END AS namespace,
       sha256(content) AS checksum, flat_path AS filename
FROM pa WHERE left(flat_path, 1) IN ('V', 'S', 'R')"""
        ),
    ),
    "l_checksum": Query(
        lambda s, d: table(s, d, "documents").select("doc_id", lg.checksum(F.col("text")).alias("checksum")),
        "SELECT doc_id, sha256(text) AS checksum FROM documents",
    ),
    "l_record": Query(
        _record,
        _sql(
            f"""SELECT (SELECT max(id) FROM h) + row_number() OVER (ORDER BY item_type, item_scope, item_name) AS id,
       version, name, type, namespace, checksum, TIMESTAMP '{AT}' AS applied_at, execution_ms, '{BY}' AS applied_by,
       success
FROM (SELECT oc.*, {ITEM_KEY} FROM oc WHERE success IS NOT NULL)"""
        ),
    ),
    "l_applied": Query(
        lambda s, d: lg.applied(ledger(s, d), "ops"), _sql("SELECT * FROM h WHERE type = 'ops' AND success")
    ),
    "l_latest": Query(lambda s, d: lg.latest(ledger(s, d)), _sql("SELECT * FROM e")),
    "l_history": Query(lambda s, d: lg.history(ledger(s, d)), _sql("SELECT * FROM h ORDER BY applied_at, id")),
    "l_pending": Query(
        lambda s, d: lg.pending(manifest(s, d), ledger(s, d)),
        _sql(
            """SELECT * FROM m WHERE type IN ('ops', 'data') AND NOT EXISTS (
    SELECT 1 FROM h WHERE h.type = m.type AND h.version = m.version AND h.success)"""
        ),
    ),
    "l_changed": Query(
        lambda s, d: lg.changed(manifest(s, d), ledger(s, d)),
        _sql(
            f"""SELECT {MANIFEST_COLUMNS}, applied_checksum FROM j WHERE type IN ('schema', 'logic', 'permissions')
AND checksum IS DISTINCT FROM applied_checksum"""
        ),
    ),
    "l_drift": Query(
        lambda s, d: lg.drifted(manifest(s, d), ledger(s, d)),
        _sql(
            f"""SELECT {MANIFEST_COLUMNS}, applied_checksum FROM j WHERE type IN ('ops', 'data') AND done
AND checksum <> applied_checksum"""
        ),
    ),
    "l_status": Query(lambda s, d: lg.status(manifest(s, d), ledger(s, d)), _sql("SELECT * FROM st")),
    "l_baseline": Query(
        lambda s, d: lg.baseline(manifest(s, d), BASELINE_VERSION),
        _sql(
            f"""SELECT CASE WHEN type IN ('ops', 'data') THEN version END AS version, name, type, namespace, checksum,
       0::BIGINT AS execution_ms, TRUE AS success
FROM m WHERE type <> 'reference' AND (type NOT IN ('ops', 'data') OR version <= '{BASELINE_VERSION}')"""
        ),
    ),
    "l_adopt_actions": Query(
        lambda s, d: lg.adopt_actions(manifest(s, d)),
        _sql(
            """SELECT *, CASE WHEN type IN ('ops', 'data') THEN 'baseline' WHEN type = 'schema' THEN 'diff'
    WHEN type = 'reference' THEN 'reconcile' ELSE 'run' END AS action FROM m"""
        ),
    ),
    "l_work_list": Query(
        lambda s, d: lg.work_list(manifest(s, d)),
        _sql(
            """SELECT *, CASE type WHEN 'ops' THEN 0 WHEN 'schema' THEN 1 WHEN 'logic' THEN 2 WHEN 'permissions' THEN 3
    WHEN 'reference' THEN 4 ELSE 5 END AS type_rank FROM m"""
        ),
    ),
    "l_backfill": Query(_backfill("missing"), _backfill_sql("missing")),
    "l_backfill_done": Query(_backfill("11"), _backfill_sql("11")),
    "l_integrity": Query(
        lambda s, d: lg.integrity(_with_unknown_types(ledger(s, d))),
        _sql(
            """SELECT 'one success per version' AS rule, type, version, count(*) AS n FROM h
WHERE success AND type IN ('ops', 'data') AND execution_ms <= 3000 GROUP BY 2, 3 HAVING count(*) > 1
UNION ALL
SELECT 'known type', 'old ' || type, version, count(*) FROM h WHERE execution_ms > 3000 GROUP BY 2, 3"""
        ),
    ),
    "l_totals": Query(
        lambda s, d: lg.totals(_outcomes(s, d)),
        _sql(
            """SELECT count(*) FILTER (WHERE success) AS applied, count(*) FILTER (WHERE success IS NULL) AS skipped,
       count(*) FILTER (WHERE NOT success) AS failed FROM oc"""
        ),
    ),
}
