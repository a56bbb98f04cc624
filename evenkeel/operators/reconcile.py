"""Several declared tables brought to their declared state, all or none."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.assign import storage_type
from evenkeel.functions.bounded import broadcast_if_fits
from evenkeel.operators import constraints
from evenkeel.operators.conform import check_keys, check_live_key, conform, conform_rejects, unpadded
from evenkeel.operators.converge import conformed_defaults, converge
from evenkeel.operators.diff import change_feed, plan_lines, plan_summary
from evenkeel.operators.evolve import drifting_tables
from evenkeel.operators.spec import (
    Refused,
    TableContract,
    TableSpec,
    check_declaration,
    check_isolation,
    order_by_foreign_keys,
)
from evenkeel.session import forget, new_path
from evenkeel.sources.catalog import CatalogStore, Stored


class Violated(RuntimeError):
    """The next state of a table would break one of its rules; nothing was published.

    ``broken`` lists all of them: table, rule and number of violations.
    """

    def __init__(self, broken: list[tuple[str, str, int]]):
        self.broken = sorted(broken)
        table, rule, n = self.broken[0]
        rest = f" (and {len(broken) - 1} more)" if len(broken) > 1 else ""
        super().__init__(f"{table}: {rule}: {n} violation(s){rest}")


@dataclass(frozen=True)
class TablePlan:
    """What reconciling one table finds. ``pending`` says why it cannot be diffed yet."""

    spec: TableSpec
    key: list[str]
    declared: DataFrame | None = None
    feed: DataFrame | None = None
    inserts: int = 0
    updates: int = 0
    deletes: int = 0
    pending: str = ""

    @property
    def empty(self) -> bool:
        return not (self.pending or self.inserts or self.updates or self.deletes)

    def lines(self) -> list[str]:
        kinds = {"insert": 0, "update": 1, "delete": 2}
        rows = plan_lines(self.feed, self.key).collect()
        return [r.line for r in sorted(rows, key=lambda r: (kinds[r.op], r.position))]


def has_pending(plans: list[TablePlan]) -> bool:
    """Whether applying the plans would do anything."""
    return not all(p.empty for p in plans)


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, read with pruning, safe from lost executors."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _counted(table: str, rule: str, broken: DataFrame) -> DataFrame:
    return broken.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "n"
    )


#: Marks the rows of a next state that were added or changed.
TOUCHED = "touched__"


def row_rules(contract: TableContract) -> dict[str, Column]:
    """The rules a single row can break, each with whether it does; unknown passes."""
    filled = [c.name for c in contract.columns if not c.nullable or c.name in contract.primary_key]
    rules = {f"not null {c}": F.col(f"`{c}`").isNull() for c in filled}
    return rules | {f"check {name}": ~F.expr(f"({predicate})") for name, predicate in contract.checks.items()}


def watched(rows: DataFrame, contract: TableContract) -> tuple[DataFrame, Observation | None]:
    """The rows without their mark, counting on the way how many of the marked ones break each rule.

    Only a row that was added or changed can break what held before. The counts are
    made by whatever job reads the rows, so the write that stores them is the only scan.
    """
    rules = row_rules(contract)
    if not rules:
        return rows.drop(TOUCHED), None
    watch = Observation()
    counts = [F.count_if(F.col(TOUCHED) & bad).alias(f"rule_{n}") for n, bad in enumerate(rules.values())]
    return rows.observe(watch, *counts).drop(TOUCHED), watch


def seen(contract: TableContract, watch: Observation | None) -> list[tuple[str, str, int]]:
    """The broken rules of a watched write that is done: table, rule, number of rows."""
    if watch is None:
        return []
    counts = watch.get
    numbered = enumerate(row_rules(contract))
    return [(contract.name, rule, counts[f"rule_{n}"]) for n, rule in numbered if counts[f"rule_{n}"]]


def unique_rules(contract: TableContract, rows: DataFrame, touched: DataFrame, key: list[str]) -> list[DataFrame]:
    """Counts of values held more than once (table_name, rule, n), one frame per rule.

    Only values a touched row holds are counted. The reconcile key is unique by construction.
    """
    found = []
    for unique in (contract.primary_key, *contract.uniques):
        if unique and set(unique) != set(key):
            values = broadcast_if_fits(unpadded(touched, list(unique), contract.types).distinct())
            held = unpadded(rows, list(unique), contract.types).join(values, list(unique), "left_semi")
            broken = constraints.unique_violations(held, list(unique))
            found.append(_counted(contract.name, f"unique ({', '.join(unique)})", broken))
    return found


def refuse_violations(found: list[DataFrame], broken: list[tuple[str, str, int]] = ()) -> None:
    """One job over the rules that need joins, of all tables, and what the writes have seen."""
    broken = list(broken)
    if found:
        counts = found[0]
        for more in found[1:]:
            counts = counts.unionByName(more)
        broken += [tuple(r) for r in counts.filter("n > 0").select("table_name", "rule", "n").collect()]
    if broken:
        raise Violated(broken)


def _of_the_query(e: PySparkException) -> bool:
    """Whether the declared rows themselves failed, and not an executor or the storage: Spark names such errors."""
    return bool(e.getSqlState()) or "USER_RAISED_EXCEPTION" in str(e)


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def shape_difference(contract: TableContract, schema: T.StructType) -> str:
    """How the stored table differs from its contract, empty if rows can go from one to the other.

    Whole numbers of another width are no difference: values that do not fit
    fail when they are written. Columns only the stored table has stay as they are.
    """
    have = {f.name: f.dataType for f in schema.fields}
    for column in contract.columns:
        kind = have.get(column.name)
        if kind is None:
            return f"it has no column {column.name}"
        wanted = T.DataType.fromDDL(f"c {storage_type(column.type)}")[0].dataType
        if kind != wanted and not (isinstance(kind, _WHOLE) and isinstance(wanted, _WHOLE)):
            return f"column {column.name} is {kind.simpleString()}, not {wanted.simpleString()}"
    return ""


def discard(plans: Iterable[TablePlan]) -> None:
    """Delete what plans have written to the shared folder; their frames cannot be read afterwards."""
    for plan in plans:
        for frame in (plan.declared, plan.feed):
            if frame is not None:
                forget(frame)


class Reconciler:
    """Plans and applies declarations against the tables of a store."""

    def __init__(self, store: CatalogStore, contracts: Iterable[TableContract]):
        self.store, self.spark = store, store.spark
        self.contracts = {c.name: c for c in contracts}

    def plan(
        self, specs: list[TableSpec], changing: Iterable[str] = (), shape_drift: DataFrame | None = None
    ) -> list[TablePlan]:
        """What would be done, parents first.

        Tables that are about to get another shape, named in ``changing`` or
        found in ``shape_drift``, are reported as not to be diffed yet.
        """
        reshaped = set(changing)
        if shape_drift is not None:
            reshaped |= drifting_tables(shape_drift, [s.table for s in specs])
        return self._plan(specs, reshaped, self.store.current()[1])

    def _plan(self, specs: list[TableSpec], changing: set[str], tables: dict[str, Stored]) -> list[TablePlan]:
        specs = [replace(s, owner=s.owner or s.table) for s in specs]
        check_isolation(
            [s for s in specs if s.table not in changing], {t: self.store.folder(t) for t in tables}
        )
        for spec in specs:
            if spec.table not in changing:
                known = self.contracts.get(spec.table) if spec.table in tables else None
                check_declaration(spec, known, self.contracts.values())
        by_table = {s.table: s for s in specs}
        plans = []
        for table in order_by_foreign_keys(list(by_table), self.contracts):
            spec = by_table[table]
            if table in changing:
                plans.append(TablePlan(spec, [], pending=f"the shape of {table} changes in this release"))
            elif table in tables and (other := shape_difference(self.contracts[table], self.store.schema(tables[table]))):
                plans.append(TablePlan(spec, [], pending=f"the stored table {table} has another shape: {other}"))
            else:
                plans.append(self._plan_table(spec, self.contracts[table], tables[table]))
        return plans

    def _plan_table(self, spec: TableSpec, contract: TableContract, stored: Stored) -> TablePlan:
        key = list(spec.resolved_key(contract))
        try:
            declared = written(conform(spec.declared, contract), "declared")
        except PySparkException as e:
            if not _of_the_query(e):
                raise
            rejected = conform_rejects(spec.declared, contract, key).take(1)
            if not rejected:
                raise Refused("query_failed", spec.owner, error=str(e).splitlines()[0]) from e
            raise ValueError(f"{spec.owner}: {rejected[0].reason}: {rejected[0].value}") from e
        check_keys(declared, spec, contract)
        if sorted(key) not in stored.unique:
            check_live_key(self.store.read(stored), spec, contract)
        if spec.prune and not spec.allow_empty and declared.isEmpty():
            raise ValueError(f"{spec.owner}: prune with no declared rows deletes every row; set allow_empty to do so")
        # Without prune only the buckets of declared keys can hold a change.
        wanted = None if spec.prune else self._buckets(stored, declared, key)
        feed = change_feed(self.store.read(stored, wanted), declared, key, prune=spec.prune, types=contract.types)
        feed = written(feed, "feed")
        counts = plan_summary(feed).first()
        return TablePlan(spec, key, declared, feed, **counts.asDict())

    def _buckets(self, stored: Stored, rows: DataFrame, key: list[str]) -> list[int] | None:
        """The buckets of the rows, None for all: if they are kept by another key, any may be meant."""
        if set(stored.key) != set(key):
            return None
        # One row per bucket: the number of buckets at most.
        bucket = self.store.bucket_of(rows, stored.key, stored.buckets, self.store.schema(stored))
        return [r[0] for r in rows.select(bucket).distinct().collect()]

    def apply(self, specs: list[TableSpec], now: datetime) -> list[TablePlan]:
        """Write and check every table's next snapshot, then publish all of them at once.

        A table whose shape is not that of its contract is refused before anything is written.

        A table without changes is not written, and of the others only the
        buckets that hold changed keys.
        """
        version, tables = self.store.current()
        plans = {p.spec.table: p for p in self._plan(specs, set(), tables)}
        for plan in plans.values():
            if plan.pending:
                raise Refused("cannot_diff", plan.spec.owner or plan.spec.table, reason=plan.pending)
        changes: dict[str, Stored] = {}
        touched: dict[str, DataFrame] = {}
        found: list[DataFrame] = []
        broken: list[tuple[str, str, int]] = []
        for table, plan in plans.items():
            if plan.empty:
                continue
            contract, stored = self.contracts[table], tables[table]
            hit = self._buckets(stored, plan.feed, plan.key)
            rows, watch = watched(self._next(plan, contract, stored, hit, now), contract)
            if hit is None:
                new = replace(stored, at=self.store.write(table, rows, stored.key, stored.buckets).at)
            else:
                new = self.store.rewrite(table, stored, rows, hit)
            broken += seen(contract, watch)
            known = [*stored.unique, sorted(plan.key)]
            new = replace(new, unique=[list(k) for k in dict.fromkeys(map(tuple, known))])
            changes[table] = replace(new, sequences=self._sequences(contract, stored, new, plan, hit))
            upserted = plan.feed.filter("op <> 'delete'").select(*plan.key)
            touched[table] = self.store.read(new, hit).join(broadcast_if_fits(upserted), plan.key, "left_semi")
            found += unique_rules(contract, self.store.read(new), touched[table], plan.key)
        after = {t: self.store.read(s) for t, s in {**tables, **changes}.items()}
        for contract in self.contracts.values():
            if contract.name in after:
                found += self._fk_violations(contract, after, touched, plans)
        refuse_violations(found, broken)
        if changes:
            self.store.publish(changes, version)
        return list(plans.values())

    def _fk_violations(
        self,
        contract: TableContract,
        after: dict[str, DataFrame],
        touched: dict[str, DataFrame],
        plans: dict[str, TablePlan],
    ) -> list[DataFrame]:
        """Foreign keys a touched child or a parent that is gone can break."""
        found, child = [], contract.name
        for fk in contract.foreign_keys:
            if fk.parent not in after:
                continue
            pairs = list(zip(fk.columns, fk.parent_columns))
            suspects = [touched[child].select(*fk.columns)] if child in touched else []
            parent_plan = plans.get(fk.parent)
            if parent_plan and (parent_plan.deletes or parent_plan.updates):
                children = after[child].select(*fk.columns)
                if set(parent_plan.key) == set(fk.parent_columns):
                    gone = parent_plan.feed.filter("op = 'delete'")
                    children = constraints.fk_action(children, gone, pairs, "RESTRICT")
                suspects.append(children)
            for rows in suspects:
                known = self.contracts.get(fk.parent)
                types = known.types if known else None
                orphans = constraints.fk_orphans(rows, after[fk.parent], pairs, types=types)
                found.append(_counted(child, f"foreign key {fk.name}", orphans))
        return found

    def _next(
        self, plan: TablePlan, contract: TableContract, stored: Stored, hit: list[int] | None, now: datetime
    ) -> DataFrame:
        live, declared = self.store.read(stored, hit), plan.declared
        if hit is not None:
            declared = declared.filter(
                self.store.bucket_of(declared, stored.key, stored.buckets, self.store.schema(stored)).isin(hit)
            )
        rows = converge(
            live,
            declared,
            plan.key,
            prune=plan.spec.prune,
            touch=plan.spec.touch,
            now=now,
            defaults=conformed_defaults(contract),
            types=contract.types,
            mark=TOUCHED,
        )
        serials = [c.name for c in contract.columns if c.serial and c.name not in declared.columns]
        for name in serials if plan.inserts else ():
            added = plan.feed.filter("op = 'insert'").select(*plan.key)
            start = self._last_value(stored, name)
            numbered = constraints.identity_fill(added, "number__", plan.key, start)
            rows = rows.join(numbered, plan.key, "left").withColumn(
                name, F.coalesce(name, F.col("number__").cast(rows.schema[name].dataType))
            )
            rows = rows.drop("number__")
        generated = {
            c.name: F.expr(c.generated).cast(storage_type(c.type)) for c in contract.columns if c.generated
        }
        return (rows.withColumns(generated) if generated else rows).select(*live.columns, TOUCHED)

    def _last_value(self, stored: Stored, column: str) -> int:
        """The last value of a serial column; its rows are looked at only if the store does not know it yet."""
        if column in stored.sequences:
            return stored.sequences[column]
        return self.store.read(stored).agg(F.max(column)).first()[0] or 0

    def _sequences(
        self, contract: TableContract, before: Stored, after: Stored, plan: TablePlan, hit: list[int] | None
    ) -> dict[str, int]:
        """The last value of every serial column: past the rows, never back. Deletes alone move none.

        Rows that were not rewritten are covered by the value before, so only rewritten buckets are read.
        """
        serials = [c.name for c in contract.columns if c.serial and (plan.inserts or plan.updates)]
        if not serials:
            return before.sequences
        highest = self.store.read(after, hit).agg(*[F.max(c).alias(c) for c in serials]).first()
        return {**before.sequences, **{c: max(self._last_value(before, c), highest[c] or 0) for c in serials}}
