"""Work that is remembered: what is new, changed, drifted or done.

An item is any keyed thing with content: a file, or a row of a table. A manifest
lists items as they are now: type, version, name, namespace, checksum. A ledger
is the append-only log of what was done with them.

Run-once items (see ``RUN_ONCE``) are known by type and version, the others by
type, namespace and name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.fixed import LEDGER_TYPES, RERUNNABLE, RUN_ONCE, TYPE_RANK
from evenkeel.functions.bounded import fits
from evenkeel.operators.constraints import check_violations, identity_fill, unique_violations

MANIFEST = ["type", "version", "name", "namespace", "checksum"]
LEDGER = (
    "id bigint, version string, name string, type string, namespace string, checksum string, "
    "applied_at timestamp, execution_ms bigint, applied_by string, success boolean"
)


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def is_run_once(c: Column | str = "type") -> Column:
    return (F.col(c) if isinstance(c, str) else c).isin(*RUN_ONCE)


def _identity() -> list[Column]:
    """What an item is known by, without NULLs so that it can be joined on."""
    once = is_run_once()
    return [
        F.col("type").alias("item_type"),
        F.when(once, F.col("version")).otherwise(F.coalesce("namespace", F.lit(""))).alias("item_scope"),
        F.when(once, F.lit("")).otherwise(F.col("name")).alias("item_name"),
    ]


_ITEM = ["item_type", "item_scope", "item_name"]


def applied(ledger: DataFrame, type_: str) -> DataFrame:
    """Successful entries of a type in version order."""
    return ledger.filter((F.col("type") == type_) & F.col("success")).orderBy("version", "id")


def history(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy("applied_at", "id")


def latest(ledger: DataFrame) -> DataFrame:
    """The last success of every item, the higher id where times are equal.

    Every task reduces its entries to one per item before the shuffle, so an
    item with a long history is no burden.
    """
    entry = F.struct(*[F.col(c) for c in ledger.columns])
    return (
        ledger.filter("success")
        .groupBy(*_identity())
        .agg(F.max_by(entry, F.struct("applied_at", "id")).alias("entry"))
        .select(*_ITEM, "entry.*")
    )


def _against(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Manifest items with the checksum of their last success, NULL if there is none.

    Only what is compared goes through the shuffle, and of the ledger only
    entries of the manifest's items, if these are few.
    """
    entries = ledger.filter("success").select(*_identity(), "checksum", "applied_at", "id")
    items = manifest.select(*_identity())
    if fits(items):
        entries = entries.join(F.broadcast(items.distinct()), _ITEM, "left_semi")
    last = F.max_by(F.struct("checksum"), F.struct("applied_at", "id"))
    done = entries.groupBy(*_ITEM).agg(last.alias("last")).select(
        *_ITEM, F.col("last.checksum").alias("applied_checksum"), F.lit(True).alias("done")
    )
    return manifest.select("*", *_identity()).join(done, _ITEM, "left").drop(*_ITEM)


def _differs() -> Column:
    return ~F.col("checksum").eqNullSafe(F.col("applied_checksum"))


def pending(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Run-once items whose version never succeeded under their type."""
    done = ledger.filter(is_run_once() & F.col("success")).select("type", "version").distinct()
    return manifest.filter(is_run_once()).join(done, ["type", "version"], "left_anti").select(*manifest.columns)


def changed(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Re-runnable items that never succeeded or whose content is not that of the last success."""
    items = manifest.filter(F.col("type").isin(*RERUNNABLE))
    return _against(items, ledger).filter(F.col("done").isNull() | _differs()).drop("done")


def drifted(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Run-once items that are done but whose content has changed since; reported, never run again."""
    return _against(manifest.filter(is_run_once()), ledger).filter(F.col("done") & _differs()).drop("done")


def status(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every item with its state: applied, pending, changed, drift, or diffed (on every run)."""
    state = (
        F.when(~F.col("type").isin(*RUN_ONCE, *RERUNNABLE), "diffed")
        .when(F.col("done").isNull(), "pending")
        .when(~_differs(), "applied")
        .when(is_run_once(), "drift")
        .otherwise("changed")
    )
    return _against(manifest, ledger).withColumn("status", state).drop("done", "applied_checksum")


def baseline(manifest: DataFrame, up_to_version: str | None = None) -> DataFrame:
    """Results that mark items as done without running them.

    A version limit holds for run-once items only and compares as text. Items
    of a type without a ledger are left out.
    """
    marked = manifest.filter(F.col("type").isin(*LEDGER_TYPES))
    if up_to_version is not None:
        marked = marked.filter(~is_run_once() | (F.col("version") <= up_to_version))
    return results(marked, F.lit(0), F.lit(True))


def results(items: DataFrame, execution_ms: Column, success: Column) -> DataFrame:
    """Outcomes of items in the form ``recorded`` takes."""
    return items.select(
        F.when(is_run_once(), F.col("version")).alias("version"),
        "name",
        "type",
        "namespace",
        "checksum",
        execution_ms.cast("long").alias("execution_ms"),
        success.alias("success"),
    )


def recorded(outcomes: DataFrame, last_id: int, at, by: str, order_by: list[str] | None = None) -> DataFrame:
    """Ledger entries for outcomes: ids after the last one, one time, one user.

    The order has to be unique among the outcomes; by default it is what an item
    is known by.
    """
    stamped = outcomes.select("*", F.lit(at).cast("timestamp").alias("applied_at"), F.lit(by).alias("applied_by"))
    if order_by is None:
        stamped = stamped.select("*", *_identity())
    numbered = identity_fill(stamped, "id", order_by or _ITEM, last_id)
    names = [part.split()[0] for part in LEDGER.split(", ")]
    return numbered.select(*names)


def adopt_actions(manifest: DataFrame) -> DataFrame:
    """What taking over an existing system does with each item, whatever the ledger says."""
    action = (
        F.when(is_run_once(), "baseline")
        .when(F.col("type") == "schema", "diff")
        .when(F.col("type") == "reference", "reconcile")
        .otherwise("run")
    )
    return manifest.withColumn("action", action)


def work_rank() -> Column:
    ranks = F.lit(None).cast("int")
    for type_, rank in reversed(TYPE_RANK.items()):
        ranks = F.when(F.col("type") == type_, rank).otherwise(ranks)
    return ranks


def work_list(items: DataFrame) -> DataFrame:
    """Items in the order they are worked through."""
    once, by_namespace = is_run_once(), F.col("type") == "schema"
    return items.withColumn("type_rank", work_rank()).orderBy(
        "type_rank",
        F.when(once, F.col("version")),
        F.when(by_namespace, F.col("namespace")),
        "name",
    )


def integrity(ledger: DataFrame) -> DataFrame:
    """What must not be in a ledger: rule, type, version, n."""
    twice = unique_violations(ledger, ["type", "version"], where="success AND type IN %s" % (RUN_ONCE,))
    unknown = check_violations(ledger, "type IN %s" % (LEDGER_TYPES,))
    return twice.select(F.lit("one success per version").alias("rule"), "type", "version", "n").unionByName(
        unknown.groupBy("type", "version")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("known type").alias("rule"), "type", "version", "n")
    )


def totals(outcomes: DataFrame) -> DataFrame:
    """Outcomes (success true, false, or NULL for not run) as applied, skipped, failed."""
    return outcomes.agg(
        F.count_if("success").alias("applied"),
        F.count_if(F.col("success").isNull()).alias("skipped"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def has_run(ledger: DataFrame, type_: str, version: str) -> bool:
    done = (F.col("type") == type_) & (F.col("version") == version) & F.col("success")
    return not ledger.filter(done).select("id").isEmpty()


def backfill(rows: DataFrame, fills: dict[str, str]) -> DataFrame:
    """Missing values filled by expressions over the row; what is there stays."""
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.expr(e).cast(rows.schema[c].dataType)) for c, e in fills.items()}
    return rows.withColumns(filled)


def backfill_once(rows: DataFrame, fills: dict[str, str], ledger: DataFrame, version: str, type_: str = "data"):
    """The backfill if its version has not succeeded yet, else the rows as they are."""
    return rows if has_run(ledger, type_, version) else backfill(rows, fills)
