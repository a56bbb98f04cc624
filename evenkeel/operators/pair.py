"""Live and declared rows side by side: the one join everything else reads from."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.bounded import fits
from evenkeel.functions.compare import comparable
from evenkeel.operators.conform import any_null, none_null

LIVE, DECLARED = "live__", "declared__"
IN_LIVE, IN_DECLARED = "in_live", "in_declared"


def pair(
    live: DataFrame,
    declared: DataFrame,
    key: list[str],
    *,
    keep_unlisted: bool,
    types: dict[str, str] | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Match rows by key: ``live__*`` and ``declared__*`` columns and two presence flags.

    The key is unique on both sides, so a key meets at most one row and no key
    can be hot. Two shapes give the same rows:

    * the declared rows are measured to be small: they are broadcast and the
      live table is read where it lies, never shuffled;
    * both are large: one shuffle of each side on the key.

    ``keep_unlisted`` says whether live rows nobody declared are wanted. Their
    NULL keys match nothing; in the shuffled shape they go around the join, as
    otherwise all of them would meet in one task. ``types`` lets fixed-length
    text keys match whether or not they are padded.
    """
    types = types or {}
    left = live.select(*[F.col(f"`{c}`").alias(LIVE + c) for c in live.columns], F.lit(True).alias(IN_LIVE))
    right = declared.select(
        *[F.col(f"`{c}`").alias(DECLARED + c) for c in declared.columns], F.lit(True).alias(IN_DECLARED)
    )
    live_key, declared_key = [LIVE + k for k in key], [DECLARED + k for k in key]
    match = key_match(live_key, declared_key, [types.get(k, "string") for k in key])

    if fits(declared, broadcast_rows):
        met = left.join(F.broadcast(right), match, "left" if keep_unlisted else "inner")
        missing = _missing_from_small(left.select(*live_key), right, match, declared_key)
        return met.unionByName(missing, allowMissingColumns=True)

    if not keep_unlisted:
        return right.join(left, match, "left")
    keyless = left.filter(any_null(live_key))
    met = left.filter(none_null(live_key)).join(right, match, "full")
    return met.unionByName(keyless, allowMissingColumns=True)


def _missing_from_small(live_keys: DataFrame, small: DataFrame, match, small_key: list[str]) -> DataFrame:
    # One row per key that both hold, so as bounded as the small side.
    listed = live_keys.join(F.broadcast(small.select(*small_key)), match, "left_semi").distinct()
    return small.join(F.broadcast(listed), match, "left_anti")


def key_match(left: list[str], right: list[str], declared: list[str]):
    """Whether two keys are the same: fixed-length text is, padded or not."""
    return reduce(
        and_,
        [comparable(F.col(f"`{a}`"), t) == comparable(F.col(f"`{b}`"), t) for a, b, t in zip(left, right, declared)],
    )


def missing_rows(
    live: DataFrame,
    declared: DataFrame,
    key: list[str],
    broadcast_rows: int | None = None,
    types: dict[str, str] | None = None,
) -> DataFrame:
    """Declared rows without a live row."""
    live_keys = live.select(*[F.col(f"`{k}`").alias(LIVE + k) for k in key])
    match = key_match(key, [LIVE + k for k in key], [(types or {}).get(k, "string") for k in key])
    if fits(declared, broadcast_rows):
        return _missing_from_small(live_keys, declared, match, key)
    return declared.join(live_keys, match, "left_anti")


def unlisted_rows(
    live: DataFrame,
    declared: DataFrame,
    key: list[str],
    broadcast_rows: int | None = None,
    types: dict[str, str] | None = None,
) -> DataFrame:
    """Live rows without a declared row, those without a key among them."""
    listed = declared.select(*[F.col(f"`{k}`").alias(DECLARED + k) for k in key])
    match = key_match(key, [DECLARED + k for k in key], [(types or {}).get(k, "string") for k in key])
    if fits(listed, broadcast_rows):
        return live.join(F.broadcast(listed), match, "left_anti")
    keyed = live.filter(none_null(key)).join(listed, match, "left_anti")
    return keyed.unionByName(live.filter(any_null(key)))
