"""Declared rows brought to the types of their table, and the rows that cannot be."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.fixed import DUPLICATE_KEY_LIMIT
from evenkeel.functions.assign import assignment, refusal, storage_type
from evenkeel.functions.compare import comparable
from evenkeel.functions.text import row_text
from evenkeel.operators.spec import Refused, TableContract, TableSpec


def conform(declared: DataFrame, contract: TableContract) -> DataFrame:
    """Cast to the table's types; a value that has to be refused fails the job.

    The failure is part of the expression, so no separate pass is needed and no
    bad value can turn into a NULL unseen.
    """
    out = []
    for field in declared.schema.fields:
        declared_type = contract.types[field.name]
        c = F.col(f"`{field.name}`")
        value, bad = assignment(c, field.dataType, declared_type)
        checked = F.when(bad, F.raise_error(F.lit(f"{refusal(declared_type)} (column {field.name})"))).otherwise(value)
        out.append(checked.cast(storage_type(declared_type)).alias(field.name))
    return declared.select(*out)


def conform_kept(declared: DataFrame, contract: TableContract) -> DataFrame:
    """Only the rows every value of which can be assigned, cast."""
    values, bads = [], []
    for field in declared.schema.fields:
        declared_type = contract.types[field.name]
        value, bad = assignment(F.col(f"`{field.name}`"), field.dataType, declared_type)
        values.append(value.cast(storage_type(declared_type)).alias(field.name))
        bads.append(bad)
    return declared.filter(~reduce(or_, bads)).select(*values)


def conform_rejects(declared: DataFrame, contract: TableContract, key: list[str]) -> DataFrame:
    """One row per value that has to be refused: key, column_name, value, reason."""
    found = []
    for field in declared.schema.fields:
        declared_type = contract.types[field.name]
        c = F.col(f"`{field.name}`")
        _, bad = assignment(c, field.dataType, declared_type)
        found.append(
            F.when(
                bad,
                F.struct(
                    F.lit(field.name).alias("column_name"),
                    c.cast("string").alias("value"),
                    F.lit(refusal(declared_type)).alias("reason"),
                ),
            )
        )
    rejected = declared.select(*key, F.explode(F.array_compact(F.array(*found))).alias("r"))
    return rejected.select(*key, "r.*")


def any_null(cols: list[str]):
    return reduce(or_, [F.col(f"`{c}`").isNull() for c in cols])


def none_null(cols: list[str]):
    return reduce(and_, [F.col(f"`{c}`").isNotNull() for c in cols])


def null_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key has a NULL part. NULL matches nothing, so such a row has no identity."""
    return rows.filter(any_null(key))


def unpadded(rows: DataFrame, columns: list[str], types: dict[str, str] | None) -> DataFrame:
    """Only these columns, fixed-length text without its padding, so that equal values are equal text."""
    types = types or {}
    return rows.select(*[comparable(F.col(f"`{c}`"), types.get(c, "string")).alias(c) for c in columns])


def key_counts(rows: DataFrame, key: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Keys held by more than one row. Counts are combined before the shuffle."""
    return unpadded(rows, key, types).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_keys(
    rows: DataFrame, key: list[str], limit: int = DUPLICATE_KEY_LIMIT, types: dict[str, str] | None = None
) -> DataFrame:
    """The first few keys declared more than once."""
    return key_counts(rows, key, types).select(*key).orderBy(*key).limit(limit)


def check_keys(rows: DataFrame, spec: TableSpec, contract: TableContract) -> None:
    """Refuse declared rows whose keys are NULL or not unique."""
    key = list(spec.resolved_key(contract))
    text = row_text([F.col(f"`{k}`") for k in key]).alias("k")
    nulls = null_keys(rows, key).select(text).take(1)
    if nulls:
        raise Refused("null_key", spec.owner, key=nulls[0].k)
    repeated = duplicate_keys(rows, key, types=contract.types).select(text).collect()
    if repeated:
        raise Refused("duplicate_key", spec.owner, key=", ".join(key), keys=", ".join(r.k for r in repeated))


def check_live_key(live: DataFrame, spec: TableSpec, contract: TableContract) -> None:
    """Refuse a key that is not unique in the live table; rows without a key do not count."""
    key = list(spec.resolved_key(contract))
    text = row_text([F.col(f"`{k}`") for k in key]).alias("k")
    repeated = duplicate_keys(live.filter(none_null(key)), key, types=contract.types).select(text).collect()
    if repeated:
        raise Refused(
            "live_duplicates", spec.owner, table=spec.table, key=", ".join(key), keys=", ".join(r.k for r in repeated)
        )
