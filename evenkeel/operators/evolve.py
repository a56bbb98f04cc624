"""How tables differ from their desired shape, and data made to fit it.

A catalog is a table of columns: namespace, table_name, column_name, type,
nullable, default_expr.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.fixed import DEFAULT_NAMESPACE
from evenkeel.functions.assign import assignment, canonical_type, refusal, split_type, storage_type
from evenkeel.operators.constraints import identity_fill, matching
from evenkeel.operators.spec import Column, TableContract
from evenkeel.sources.catalog import BUCKET, CatalogStore

CATALOG = "namespace string, table_name string, column_name string, type string, nullable boolean, default_expr string"
COLUMN_KEY = ["namespace", "table_name", "column_name"]
ATTRIBUTES = ("type", "nullable", "default_expr")


def catalog_of(spark, contracts: list[TableContract], namespace: str = DEFAULT_NAMESPACE) -> DataFrame:
    rows = [(namespace, t.name, c.name, c.type, c.nullable, c.default) for t in contracts for c in t.columns]
    return spark.createDataFrame(rows, CATALOG)


def drift(
    live: DataFrame,
    desired: DataFrame,
    *,
    strict: bool = False,
    namespaces: list[str] | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """One row per difference: kind, the column, live_value, desired_value.

    Live columns are looked at only in tables the desired catalog declares, in
    strict mode in all tables of its namespaces (or of those given). A type
    under another of its names is the same type.
    """

    def meant(attribute: str, name: str):
        return canonical_type(F.col(name)) if attribute == "type" else F.col(name)

    if namespaces is not None:
        live = live.filter(F.col("namespace").isin(namespaces))
        desired = desired.filter(F.col("namespace").isin(namespaces))
    scope = ["namespace"] if strict else ["namespace", "table_name"]
    declared = desired.select(*scope).distinct()
    live = matching(live, declared, [(c, c) for c in scope], "left_semi", broadcast_rows)
    left = live.select(*COLUMN_KEY, *[F.col(a).alias(f"live__{a}") for a in ATTRIBUTES], F.lit(True).alias("in_live"))
    right = desired.select(
        *COLUMN_KEY, *[F.col(a).alias(f"desired__{a}") for a in ATTRIBUTES], F.lit(True).alias("in_desired")
    )
    both = left.join(right, COLUMN_KEY, "full")

    def difference(kind, live_value, desired_value):
        return F.struct(
            F.lit(kind).alias("kind"),
            live_value.cast("string").alias("live_value"),
            desired_value.cast("string").alias("desired_value"),
        )

    none = F.lit(None).cast("string")
    absent, extra = F.col("in_live").isNull(), F.col("in_desired").isNull()
    kinds = {"type": "type_changed", "nullable": "nullability_changed", "default_expr": "default_changed"}
    found = F.array(
        F.when(absent, difference("column_added", none, F.col("desired__type"))),
        F.when(extra, difference("column_dropped", F.col("live__type"), none)),
        *[
            F.when(
                ~absent & ~extra & ~meant(a, f"live__{a}").eqNullSafe(meant(a, f"desired__{a}")),
                difference(kinds[a], F.col(f"live__{a}"), F.col(f"desired__{a}")),
            )
            for a in ATTRIBUTES
        ],
    )
    return both.select(*COLUMN_KEY, F.explode(F.array_compact(found)).alias("d")).select(*COLUMN_KEY, "d.*")


def _columns_of(namespace: str, name: str, schema: T.StructType) -> list[tuple]:
    fields = [f for f in schema.fields if f.name != BUCKET]
    defaults = [(f.metadata or {}).get("CURRENT_DEFAULT") for f in fields]
    return [(namespace, name, f.name, f.dataType.simpleString(), f.nullable, d) for f, d in zip(fields, defaults)]


def catalog_of_stored(store: CatalogStore, namespace: str = DEFAULT_NAMESPACE) -> DataFrame:
    """The catalog of the current tables of a store, as Spark's own catalog has them; no rows are read."""
    current = store.current()[1].items()
    rows = [r for name, stored in current for r in _columns_of(namespace, name, store.catalog_schema(stored))]
    return store.spark.createDataFrame(rows, CATALOG)


def catalog_of_database(spark: SparkSession, database: str, namespace: str | None = None) -> DataFrame:
    """The catalog of all tables of a database of ``spark.catalog``, views left out; no rows are read."""
    tables = [t.name for t in spark.catalog.listTables(f"`{database}`") if t.tableType in ("MANAGED", "EXTERNAL")]
    schemas = {t: spark.table(f"`{database}`.`{t}`").schema for t in tables}
    rows = [r for t, schema in schemas.items() for r in _columns_of(namespace or database, t, schema)]
    return spark.createDataFrame(rows, CATALOG)


def drifting_tables(differences: DataFrame, tables: list[str]) -> set[str]:
    """Which of these tables have a shape difference."""
    found = differences.filter(F.col("table_name").isin(tables)).select("table_name").distinct()
    return {r.table_name for r in found.collect()}


def evolve(
    rows: DataFrame, desired: list[Column], *, strict: bool = False, key: list[str] | None = None
) -> DataFrame:
    """The rows in the desired shape: one projection.

    Missing columns take their default or what they are generated as; a serial
    one numbers the rows in the order of ``key``, which is unique. Types follow
    the assignment rules, and order the declaration. A value that does not fit
    fails the job, as does a NULL, or a new column without a default, where NULL
    is not allowed; without rows nothing fails. Extra columns go only in strict mode.
    """
    have = {f.name: f.dataType for f in rows.schema.fields}
    for column in desired:
        if column.serial and column.name not in have:
            if not key:
                raise ValueError(f"column {column.name} is serial: name the key whose order numbers the rows")
            rows = identity_fill(rows, column.name, key, 0)
            have[column.name] = T.LongType()
    out = []
    for column in desired:
        must = F.lit(f"column {column.name} must not be NULL")
        if column.name not in have:
            if column.default is not None or column.generated:
                value = F.expr(column.default if column.default is not None else column.generated)
            else:
                value = F.lit(None) if column.nullable else F.raise_error(must)
        elif not column.nullable:
            assigned, bad = assignment(F.col(f"`{column.name}`"), have[column.name], column.type)
            text = F.lit(f"{refusal(column.type)} (column {column.name})")
            value = F.when(F.col(f"`{column.name}`").isNull(), F.raise_error(must))
            value = value.when(bad, F.raise_error(text)).otherwise(assigned)
        elif have[column.name].simpleString() == storage_type(column.type) == column.type:
            out.append(F.col(f"`{column.name}`"))
            continue
        else:
            assigned, bad = assignment(F.col(f"`{column.name}`"), have[column.name], column.type)
            text = F.lit(f"{refusal(column.type)} (column {column.name})")
            value = F.when(bad, F.raise_error(text)).otherwise(assigned)
        out.append(value.cast(storage_type(column.type)).alias(column.name))
    named = {c.name for c in desired}
    kept = [] if strict else [F.col(f"`{c}`") for c in rows.columns if c not in named]
    return rows.select(*out, *kept)


def missing_namespaces(declared: DataFrame, existing: DataFrame) -> DataFrame:
    """Declared namespaces that do not exist; the default one always does."""
    wanted = declared.select("namespace").filter(
        F.col("namespace").isNotNull() & ~F.col("namespace").isin("", DEFAULT_NAMESPACE)
    )
    return wanted.distinct().join(existing.select("namespace").distinct(), "namespace", "left_anti")


#: Types a file may hold where the table has the type they lead to: Spark reads the one as the other.
_READ_AS = {
    "tinyint": ("smallint", "int", "bigint"),
    "smallint": ("int", "bigint"),
    "int": ("bigint",),
    "float": ("double",),
}


def by_definition(have: T.StructType, desired: list[Column], strict: bool) -> list[tuple[str, str, str | None]] | None:
    """The columns of a table definition over the files as they are, None if rows have to be written anew.

    A new column can be read as its default, if that is a constant, or as NULL; a number as a wider one. Whatever
    numbers or computes rows, or changes what is in them, cannot.
    """
    kinds = {f.name: f.dataType.simpleString() for f in have.fields}
    out = []
    for column in desired:
        kind, wanted = kinds.get(column.name), storage_type(column.type)
        if kind is None:
            computed = column.serial or column.generated or "(" in (column.default or "")
            if computed or (column.default is None and not column.nullable):
                return None
        elif kind != wanted and wanted not in _READ_AS.get(kind, ()):
            return None
        out.append((column.name, wanted, column.default))
    named = {c.name for c in desired}
    return out if strict else out + [(f.name, kinds[f.name], None) for f in have.fields if f.name not in named]


def evolve_stored(store: CatalogStore, name: str, desired: list[Column], *, strict: bool = False) -> bool:
    """Bring a stored table to the desired shape; False if it has that shape, and then nothing is changed.

    Where a definition is enough, the next table is defined over the present files and
    none is written. Values are checked in any case: a shorter text type is stored like a longer one.
    """
    version, tables = store.current()
    stored = tables[name]
    have, rows = store.schema(stored), store.read(stored)
    kinds = {f.name: f.dataType.simpleString() for f in have.fields}
    shaped = evolve(rows, desired, strict=strict, key=stored.key)
    same = shaped.schema.simpleString() == rows.schema.simpleString()
    columns = by_definition(have, desired, strict)
    if same or columns is not None:
        narrow = [c for c in desired if c.name in kinds and (not c.nullable or split_type(c.type)[1] is not None)]
        if narrow:
            evolve(rows, narrow, strict=True).write.format("noop").mode("overwrite").save()
    if same:
        return False
    if columns is not None:
        new = store.reshape(name, stored, columns)
    else:
        new = replace(stored, at=store.write(name, shaped, stored.key, stored.buckets).at, unique=[])
    store.publish({name: new}, version)
    return True
