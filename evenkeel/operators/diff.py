"""What has to change: inserts, updates and deletes, and reports on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.fixed import PLAN_ROW_LIMIT
from evenkeel.functions.compare import all_same, same
from evenkeel.functions.text import literal, row_text
from evenkeel.operators.pair import DECLARED, IN_DECLARED, IN_LIVE, LIVE, pair

OPS = ("insert", "update", "delete")


def _differs(columns: list[str], types: dict[str, str]) -> Column:
    return ~all_same([(F.col(LIVE + c), F.col(DECLARED + c), types.get(c, "string")) for c in columns])


def operation(columns: list[str], types: dict[str, str], prune: bool) -> Column:
    """The change a paired row stands for, NULL for none."""
    unlisted = F.lit("delete") if prune else F.lit(None).cast("string")
    return (
        F.when(F.col(IN_LIVE).isNull(), "insert")
        .when(F.col(IN_DECLARED).isNull(), unlisted)
        .when(_differs(columns, types), "update")
    )


def change_feed(
    live: DataFrame,
    declared: DataFrame,
    key: list[str],
    *,
    prune: bool = False,
    types: dict[str, str] | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """One row per change: op, key, ``changed`` column names, ``old_*`` and ``new_*`` values.

    Without ``prune`` live rows nobody declared are not even looked for. Only
    declared columns are read from the live table.
    """
    types = types or {}
    values = [c for c in declared.columns if c not in key]
    paired = pair(
        live.select(*key, *values), declared, key, keep_unlisted=prune, types=types, broadcast_rows=broadcast_rows
    ).withColumn("op", operation(values, types, prune))
    update = F.col("op") == "update"
    changed = [
        F.when(update & ~same(F.col(LIVE + c), F.col(DECLARED + c), types.get(c, "string")), F.lit(c)) for c in values
    ]
    return paired.filter(F.col("op").isNotNull()).select(
        "op",
        *[F.coalesce(LIVE + k, DECLARED + k).alias(k) for k in key],
        (F.array_compact(F.array(*changed)) if changed else F.array().cast("array<string>")).alias("changed"),
        *[F.when(update, F.col(LIVE + c)).alias(f"old_{c}") for c in values],
        *[F.when(F.col("op") != "delete", F.col(DECLARED + c)).alias(f"new_{c}") for c in values],
    )


def updates(feed: DataFrame) -> DataFrame:
    return feed.filter("op = 'update'")


def update_columns(feed: DataFrame, key: list[str]) -> DataFrame:
    """One row per changed value: key, column_name, old_value, new_value as text."""
    values = [c.removeprefix("new_") for c in feed.columns if c.startswith("new_")]
    detail = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"old_{c}").cast("string").alias("old_value"),
                F.col(f"new_{c}").cast("string").alias("new_value"),
            )
            for c in values
        ]
    )
    listed = F.filter(detail, lambda d: F.array_contains("changed", d["column_name"]))
    return updates(feed).select(*key, F.explode(listed).alias("d")).select(*key, "d.*")


def plan_lines(feed: DataFrame, key: list[str], limit: int = PLAN_ROW_LIMIT) -> DataFrame:
    """At most ``limit`` lines per kind of change in key order, and a line for the rest.

    Every task keeps its own first rows per kind before anything is shuffled,
    so what meets in one task does not grow with the feed. Spark does so for the
    numbering up to a limit of its own; beyond it each kind is cut by an ordered
    limit first.
    """
    values = [c.removeprefix("new_") for c in feed.columns if c.startswith("new_")]
    key_text = row_text([F.col(f"`{k}`") for k in key])
    assigned = [F.concat(F.lit(f" {c}="), literal(F.col(f"new_{c}"))) for c in values]
    replaced = [
        F.when(
            F.array_contains("changed", F.lit(c)),
            F.concat(F.lit(f"{c}: "), literal(F.col(f"old_{c}")), F.lit(" → "), literal(F.col(f"new_{c}"))),
        )
        for c in values
    ]
    line = (
        F.when(F.col("op") == "insert", F.concat(F.lit("+ "), key_text, *assigned))
        .when(F.col("op") == "update", F.concat(F.lit("~ "), key_text, F.lit(" "), F.concat_ws(", ", *replaced)))
        .otherwise(F.concat(F.lit("- "), key_text))
    )
    first = Window.partitionBy("op").orderBy(*key)
    candidates = feed
    if limit > int(feed.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        firsts = [feed.filter(F.col("op") == op).orderBy(*key).limit(limit) for op in OPS]
        candidates = reduce(DataFrame.unionByName, firsts)
    shown = (
        candidates.withColumn("position", F.row_number().over(first))
        .filter(F.col("position") <= limit)
        .select("op", "position", line.alias("line"))
    )
    rest = (
        feed.groupBy("op")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > limit)
        .select(
            "op",
            F.lit(limit + 1).alias("position"),
            F.concat(F.lit("  … and "), F.col("n") - limit, F.lit(" more")).alias("line"),
        )
    )
    return shown.unionByName(rest)


def plan_summary(feed: DataFrame) -> DataFrame:
    """One row: how many rows of each kind."""
    return feed.agg(*[F.count_if(F.col("op") == op).alias(f"{op}s") for op in OPS])


def pending_gate(feed: DataFrame, table: str, shape_drift: DataFrame | None = None) -> DataFrame:
    """One row: is there anything to do?

    ``cannot diff yet`` if the table's own shape is about to change, as the rows
    would be compared with a table that is not the one to be written. One row of
    each side is enough to tell.
    """
    found = feed.limit(1).select(F.lit("rows").alias("what"))
    if shape_drift is not None:
        found = found.unionByName(shape_drift.limit(1).select(F.lit("shape").alias("what")))
    state = (
        F.when(F.count_if(F.col("what") == "shape") > 0, "cannot diff yet")
        .when(F.count_if(F.col("what") == "rows") > 0, "pending")
        .otherwise("converged")
    )
    return found.agg(state.alias("state")).select(F.lit(table).alias("table_name"), "state")
