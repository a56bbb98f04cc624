"""What a table is, what it must hold, and the checks that need no data."""

from __future__ import annotations

import graphlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evenkeel.fixed import REACHING_ACTIONS, REFUSALS
from evenkeel.functions.assign import storage_type


OWN_REFUSALS = {
    "cannot_diff": "cannot be applied yet: {reason}",
    "unknown_type": "column {column} has type {type}, which is not known",
}


class Refused(ValueError):
    """A declaration that cannot be carried out exactly as written."""

    def __init__(self, kind: str, owner: str = "", **parts: str):
        self.kind = kind
        text = {**REFUSALS, **OWN_REFUSALS}[kind].format(**parts)
        super().__init__(f"{owner}: {text}" if owner else text)


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    generated: str | None = None
    identity_always: bool = False
    serial: bool = False


@dataclass(frozen=True)
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "NO ACTION"


@dataclass(frozen=True)
class TableContract:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()
    is_table: bool = True

    @classmethod
    def of(cls, df: DataFrame, name: str, primary_key: Iterable[str] = (), **rest) -> TableContract:
        """The contract a frame's own schema implies."""
        columns = tuple(Column(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields)
        return cls(name, columns, tuple(primary_key), **rest)

    @property
    def types(self) -> dict[str, str]:
        return {c.name: c.type for c in self.columns}

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def empty(self, spark) -> DataFrame:
        ddl = ", ".join(f"`{c.name}` {storage_type(c.type)}" for c in self.columns)
        return spark.createDataFrame([], ddl)


@dataclass(frozen=True)
class TableSpec:
    """The rows a table must hold.

    ``sources`` names the tables the declared rows were read from; rows written
    out inline have none. ``owner`` is how refusals name the declaration.
    """

    table: str
    declared: DataFrame
    key: tuple[str, ...] = ()
    prune: bool = False
    touch: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    owner: str = ""
    allow_empty: bool = False

    def resolved_key(self, contract: TableContract) -> tuple[str, ...]:
        return tuple(self.key or contract.primary_key)

    def non_key(self, contract: TableContract) -> list[str]:
        key = self.resolved_key(contract)
        return [c for c in self.declared.columns if c not in key]


def check_declaration(spec: TableSpec, contract: TableContract | None, contracts: Iterable[TableContract] = ()) -> None:
    """Refuse a declaration its table's contract cannot take."""
    owner = spec.owner

    def refuse(kind: str, **parts: str):
        raise Refused(kind, owner, **{"table": spec.table, **parts})

    if contract is None:
        refuse("no_table")
    if not contract.is_table:
        refuse("not_a_table")
    for column in contract.columns:
        try:
            storage_type(column.type)
        except ValueError:
            refuse("unknown_type", column=column.name, type=column.type)
    seen = set()
    for name in spec.declared.columns:
        column = contract.column(name)
        if column is None:
            refuse("no_column", column=name)
        if column.generated:
            refuse("generated", column=name)
        if column.identity_always:
            refuse("identity", column=name)
        if name in seen:
            refuse("column_twice", column=name)
        seen.add(name)
    key = spec.resolved_key(contract)
    if not key:
        refuse("no_primary_key")
    for name in key:
        if name not in seen:
            refuse("key_not_declared", column=name)
    for name in spec.touch:
        if contract.column(name) is None:
            refuse("no_touch", column=name)
        if name in seen:
            refuse("touch_declared", column=name)
    for field_ in spec.declared.schema.fields:
        if isinstance(field_.dataType, T.MapType):
            raise TypeError(f"{owner}: column {field_.name} is a map, and maps cannot be compared")
    unique = [set(u) for u in (contract.primary_key, *contract.uniques) if u]
    if set(key) not in unique:
        refuse("no_unique", key=", ".join(key))
    if spec.prune:
        reaching = sorted(
            (fk.name, other.name, fk.on_delete)
            for other in contracts
            for fk in other.foreign_keys
            if fk.parent == spec.table and fk.on_delete in REACHING_ACTIONS
        )
        if reaching:
            name, child, action = reaching[0]
            refuse("prune_reach", constraint=name, child=child, action=action)


def scanned_roots(df: DataFrame) -> list[str]:
    """The paths given to the file scans of a frame, not the files below them."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for k in range(leaves.size()):
        try:
            paths = leaves.apply(k).relation().location().rootPaths()
        except Py4JError:  # a leaf that is no scan of files
            continue
        found += [paths.apply(i).toString() for i in range(paths.size())]
    return found


def check_isolation(specs: list[TableSpec], folders: dict[str, str] | None = None) -> None:
    """Refuse two declarations of one table, and one that reads a declared table.

    All declarations are compared with the tables as they were before any of
    them is written, so such a read would see old rows. ``sources`` is what
    counts; where the folders of the declared tables are known, the paths Spark
    scans for a declaration are a second line.
    """
    owner_of: dict[str, str] = {}
    for spec in specs:
        if spec.table in owner_of:
            raise Refused("declared_twice", spec.owner, table=spec.table, other=owner_of[spec.table])
        owner_of[spec.table] = spec.owner or spec.table
    for spec in specs:
        read = [s for s in spec.sources if s in owner_of]
        if folders and not read:
            roots = scanned_roots(spec.declared)
            read = [t for t in owner_of if t in folders and any(f"{folders[t]}/" in f"{r}/" for r in roots)]
        if read:
            raise Refused("reads_declared", spec.owner, source=read[0], other=owner_of[read[0]])


def order_by_foreign_keys(tables: list[str], contracts: dict[str, TableContract]) -> list[str]:
    """Parents before children, otherwise in the given order."""
    sorter = graphlib.TopologicalSorter()
    for table in tables:
        contract = contracts.get(table)
        parents = [fk.parent for fk in contract.foreign_keys] if contract else []
        sorter.add(table, *[p for p in parents if p in tables and p != table])
    try:
        sorter.prepare()
    except graphlib.CycleError as e:
        members = [t for t in tables if t in e.args[1]]
        raise Refused("cycle", tables=", ".join(members)) from None
    ordered, ready = [], []
    while sorter.is_active():
        ready = sorted([*ready, *sorter.get_ready()], key=tables.index)
        ordered.append(ready.pop(0))
        sorter.done(ordered[-1])
    return ordered


def declared_rows(spark, query: str, owner: str = "") -> DataFrame:
    """The rows of an inline ``VALUES`` or ``SELECT`` query."""
    try:
        return spark.sql(query)
    except Exception as e:
        raise Refused("query_failed", owner, error=str(e).splitlines()[0]) from e
