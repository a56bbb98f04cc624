"""Rows that break a table's keys, checks, foreign keys and generated columns."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.bounded import fits
from evenkeel.functions.skew import hot_keys
from evenkeel.functions.assign import split_type
from evenkeel.functions.compare import comparable
from evenkeel.operators.conform import any_null, key_counts, none_null, unpadded
from evenkeel.session import new_path


def not_null_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs per column that may hold none, all columns in one pass: column_name, n."""
    counted = rows.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    per_column = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n")) for c in columns])
    return counted.select(F.explode(per_column).alias("v")).select("v.*").filter("n > 0")


def unique_violations(
    rows: DataFrame, columns: list[str], where: str | None = None, types: dict[str, str] | None = None
) -> DataFrame:
    """Values held more than once, with how often; NULL equals nothing. ``where`` makes the rule partial."""
    if where:
        rows = rows.filter(where)
    return key_counts(rows.filter(none_null(columns)), columns, types)


def check_violations(rows: DataFrame, predicate: str) -> DataFrame:
    """Rows for which the predicate is false; unknown passes."""
    return rows.filter(f"NOT ({predicate})")


def generated_mismatches(rows: DataFrame, column: str, expression: str, key: list[str]) -> DataFrame:
    """Rows whose stored value is not what the expression gives: key, stored, expected."""
    expected = F.expr(expression)
    return rows.filter(~F.col(column).eqNullSafe(expected)).select(
        *key, F.col(column).alias("stored"), expected.alias("expected")
    )


Pairs = list[tuple[str, str]]


def _link(pairs: Pairs) -> Column:
    return reduce(and_, [F.col(f"`{child}`") == F.col(f"parent__{parent}") for child, parent in pairs])


def matching(
    child: DataFrame,
    parent: DataFrame,
    pairs: Pairs,
    how: str,
    broadcast_rows: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Child rows by whether their (child, parent) columns meet a parent.

    ``left_semi`` gives those that do, ``left_anti`` those that do not,
    ``left`` all of them with a column ``matched``.

    Parents measured to be small are broadcast and the child stays where it
    lies. Otherwise both are shuffled on the key, but for two kinds of children
    that would pile up in one task: those without a key, which match nothing,
    and those of a hot parent. There are few hot parents, so those are broadcast.
    """
    fk = [c for c, _ in pairs]
    parent_key = [f"parent__{p}" for _, p in pairs]
    keys = parent.select(*[F.col(f"`{p}`").alias(f"parent__{p}") for _, p in pairs]).filter(none_null(parent_key))
    keyless = child.filter(any_null(fk))
    if how == "left":
        # A parent listed twice must not double its children.
        keys = keys.distinct().withColumn("parent__hit", F.lit(True))
        keyless = keyless.withColumn("matched", F.lit(False))

    def met(rows: DataFrame, known: DataFrame) -> DataFrame:
        joined = rows.join(known, _link(pairs), how)
        if how == "left":
            return joined.select(*child.columns, F.col("parent__hit").isNotNull().alias("matched"))
        return joined

    if fits(keys, broadcast_rows):
        return met(child, F.broadcast(keys))
    keyed = child.filter(none_null(fk))
    hot = hot_keys(keyed.select(*fk), fk, hot_rows)
    if hot is None:
        result = met(keyed, keys)
    else:
        hot_parents = keys.join(F.broadcast(hot.toDF(*parent_key)), parent_key, "left_semi").distinct()
        hot_children = keyed.join(F.broadcast(hot), fk, "left_semi")
        others = keyed.join(F.broadcast(hot), fk, "left_anti")
        result = met(others, keys).unionByName(met(hot_children, F.broadcast(hot_parents)))
    return result if how == "left_semi" else result.unionByName(keyless)


def fk_orphans(
    child: DataFrame,
    parent: DataFrame,
    pairs: Pairs,
    broadcast_rows: int | None = None,
    types: dict[str, str] | None = None,
) -> DataFrame:
    """Child rows whose parent does not exist; a NULL part passes.

    ``types`` are the declared types of the parent's columns: fixed-length text
    meets its parent padded or not. Children measured to be few are not worth a
    shuffle of the parents: those that exist are found by the children's keys.
    """
    fk = [c for c, _ in pairs]
    keyed = child.filter(none_null(fk))
    if padded := {c: t for c, p in pairs if split_type(t := (types or {}).get(p, "string"))[0] == "char"}:
        keyed = keyed.withColumns({f"{c}__": comparable(F.col(f"`{c}`"), t) for c, t in padded.items()})
        parent = unpadded(parent, [p for _, p in pairs], types)
        pairs = [(f"{c}__" if c in padded else c, p) for c, p in pairs]
        fk = [c for c, _ in pairs]
    held = keyed.select(*fk)
    if fits(held, broadcast_rows) and not fits(parent.select(*[p for _, p in pairs]), broadcast_rows):
        keys = F.broadcast(held.select(*[F.col(f"`{c}`").alias(f"parent__{p}") for c, p in pairs]).distinct())
        names = [f"parent__{p}" for _, p in pairs]
        parents = parent.select(*[F.col(f"`{p}`").alias(f"parent__{p}") for _, p in pairs])
        # one row a key the few children hold, so as bounded as these
        known = parents.join(keys, names, "left_semi").distinct()
        orphans = keyed.join(F.broadcast(known), _link(pairs), "left_anti")
    else:
        orphans = matching(keyed, parent, pairs, "left_anti", broadcast_rows)
    return orphans.select(*[F.col(f"`{c}`") for c in child.columns])


def fk_action(
    child: DataFrame,
    deleted: DataFrame,
    pairs: Pairs,
    action: str,
    defaults: dict[str, str] | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """The child table after its parents in ``deleted`` are gone.

    CASCADE drops the children, SET NULL and SET DEFAULT let go of the parent.
    RESTRICT and NO ACTION allow no such delete: they return the children in its way.
    """
    if action == "CASCADE":
        return matching(child, deleted, pairs, "left_anti", broadcast_rows)
    if action in ("RESTRICT", "NO ACTION"):
        return matching(child, deleted, pairs, "left_semi", broadcast_rows)
    if action not in ("SET NULL", "SET DEFAULT"):
        raise ValueError(f"unknown referential action {action}")
    met = matching(child, deleted, pairs, "left", broadcast_rows)
    fk = [c for c, _ in pairs]
    freed = {c: F.expr((defaults or {})[c]) if action == "SET DEFAULT" else F.lit(None) for c in fk}
    return met.select(
        *[
            F.when(F.col("matched"), freed[f.name]).otherwise(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name)
            if f.name in fk
            else F.col(f"`{f.name}`")
            for f in child.schema.fields
        ]
    )


def prune_reach(
    deleted: DataFrame, child: DataFrame, pairs: Pairs, constraint: str, action: str, by: list[str] = ()
) -> DataFrame:
    """How many child rows a prune would reach, per ``by`` columns of the deleted rows.

    Children are counted per parent key before they are shuffled, so a parent
    with very many children is one row by then.
    """
    fk = [c for c, _ in pairs]
    parents = deleted.select(*[F.col(f"`{p}`").alias(f"parent__{p}") for _, p in pairs])
    if fits(parents):
        # few deleted parents: only their children are counted
        child = child.join(F.broadcast(parents.distinct()), _link(pairs), "left_semi")
    per_parent = child.filter(none_null(fk)).groupBy(*fk).agg(F.count(F.lit(1)).alias("rows_reached"))
    gone = deleted.select(*by, *[F.col(f"`{p}`").alias(f"parent__{p}") for _, p in pairs])
    return (
        gone.join(per_parent, _link(pairs))
        .groupBy(*by)
        .agg(F.sum("rows_reached").cast("long").alias("rows_reached"), F.count(F.lit(1)).alias("parents"))
        .select(
            F.lit(constraint).alias("constraint_name"), F.lit(action).alias("action"), *by, "rows_reached", "parents"
        )
    )


def identity_fill(
    rows: DataFrame,
    column: str,
    order_by: list[str],
    start: int,
    *,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Number the rows ``start + 1, start + 2, ...`` in the order of a unique key.

    A measured small feed is numbered in one window. A large one is range-sorted
    and written once to the shared folder with the range each row fell into, so
    the ranges cannot shift when a task is run again; every range is numbered on
    its own and moved on by the counts of the ranges before it.
    """
    rows = rows.drop(column)
    if fits(rows, broadcast_rows):
        number = F.row_number().over(Window.orderBy(*order_by))
        return rows.withColumn(column, (F.lit(start) + number).cast("long"))
    spark = rows.sparkSession
    path = new_path(spark, "ranges")
    rows.repartitionByRange(*order_by).withColumn("range__", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    # One row per range: the number of shuffle partitions at most.
    sizes = ranged.groupBy("range__").agg(F.count(F.lit(1)).alias("size__"))
    before = Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range__", F.coalesce(F.sum("size__").over(before), F.lit(0)).alias("offset__"))
    number = F.row_number().over(Window.partitionBy("range__").orderBy(*order_by))
    return (
        ranged.withColumn("number__", number)
        .join(F.broadcast(offsets), "range__")
        .withColumn(column, (F.lit(start) + F.col("offset__") + F.col("number__")).cast("long"))
        .drop("range__", "number__", "offset__")
    )
