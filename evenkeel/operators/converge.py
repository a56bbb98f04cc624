"""The table as it has to look once the changes are made."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.assign import storage_type
from evenkeel.operators.diff import operation
from evenkeel.operators.pair import DECLARED, LIVE, pair


def converge(
    live: DataFrame,
    declared: DataFrame,
    key: list[str],
    *,
    prune: bool = False,
    touch: list[str] | tuple[str, ...] = (),
    now: datetime | None = None,
    defaults: dict[str, str] | None = None,
    types: dict[str, str] | None = None,
    broadcast_rows: int | None = None,
    mark: str | None = None,
) -> DataFrame:
    """The next state of ``live``: missing rows added, changed rows corrected.

    An unchanged row keeps every value it has, also where an equal value is
    written differently. A changed row takes all declared values. Columns nobody
    declared stay as they are and take their default (an SQL expression) on
    added rows. ``touch`` columns are set to ``now`` on added and changed rows
    only. Unlisted rows stay unless ``prune``. ``mark`` names a column that says
    whether a row was added or changed.
    """
    if touch and now is None:
        raise ValueError("touch columns need the time to set")
    types, defaults = types or {}, defaults or {}
    values = [c for c in declared.columns if c not in key]
    paired = pair(live, declared, key, keep_unlisted=not prune, types=types, broadcast_rows=broadcast_rows)
    # With prune the pairs hold declared rows only, so there is nothing left to delete.
    paired = paired.withColumn("op", operation(values, types, prune=False))
    written = F.col("op").isNotNull()
    added = F.coalesce(F.col("op") == "insert", F.lit(False))
    out = []
    for field in live.schema.fields:
        name, old = field.name, F.col(LIVE + field.name)
        if name in key:
            value = F.coalesce(old, F.col(DECLARED + name))
        elif name in values:
            value = F.when(written, F.col(DECLARED + name)).otherwise(old)
        elif name in touch:
            value = F.when(written, F.lit(now)).otherwise(old)
        elif name in defaults:
            value = F.when(added, F.expr(defaults[name])).otherwise(old)
        else:
            value = old
        out.append(value.cast(field.dataType).alias(name))
    if mark:
        out.append(written.alias(mark))
    return paired.select(*out)


def next_key(rows: DataFrame, column: str, stored: int) -> DataFrame:
    """The next value of a surrogate key: past what is stored and what is in the table, never backwards."""
    return rows.agg((F.greatest(F.lit(stored).cast("long"), F.max(column).cast("long")) + 1).alias("next_value"))


def conformed_defaults(contract) -> dict[str, str]:
    return {
        c.name: f"CAST({c.default} AS {storage_type(c.type)})" for c in contract.columns if c.default is not None
    }
