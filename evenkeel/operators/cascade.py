"""What deleting rows does to other tables, through foreign keys of foreign keys."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.conform import none_null
from evenkeel.operators.constraints import matching
from evenkeel.operators.spec import ForeignKey, TableContract
from evenkeel.session import forget, new_path

RESTRICTING = ("RESTRICT", "NO ACTION")
REACH = "table_name string, constraint_name string, action string, rows_reached long"


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Cascade:
    """The rows that go with deleted ones, found round by round until no table has new ones.

    ``tables`` are the tables as they are and ``contracts`` say how they hang together; every table
    that others refer to has a primary key. Rows are known by the columns the rules
    need: the primary key and whatever foreign keys refer to. Each round's new rows are written, so
    a lost executor costs a task of one round, and a table that refers to itself takes as many rounds as it is
    deep. Rows without a key and references that are NULL hang on nothing.
    """

    def __init__(self, tables: dict[str, DataFrame], contracts: Iterable[TableContract]):
        self.tables = tables
        self.contracts = {c.name: c for c in contracts if c.name in tables}
        self.links = [
            (c.name, fk) for c in self.contracts.values() for fk in c.foreign_keys if fk.parent in self.contracts
        ]
        self._rounds: dict[str, list[DataFrame]] = {t: [] for t in self.contracts}

    def _identity(self, table: str) -> list[str]:
        key = list(self.contracts[table].primary_key)
        if not key:
            raise ValueError(f"{table} has no primary key, so its rows cannot be told apart")
        return key

    def _needed(self, table: str) -> list[str]:
        """The columns by which a table's rows are known."""
        referred = [c for _, fk in self.links if fk.parent == table for c in fk.parent_columns]
        return list(dict.fromkeys([*self._identity(table), *referred]))

    def _children(self, child: str, fk: ForeignKey, parents: DataFrame) -> DataFrame:
        """The child's rows that refer to one of the parents; hot parents do not meet in one task."""
        columns = list(dict.fromkeys([*self._needed(child), *fk.columns]))
        rows = self.tables[child].select(*[F.col(f"`{c}`") for c in columns])
        return matching(rows, parents, list(zip(fk.columns, fk.parent_columns)), "left_semi")

    def _without(self, table: str, rows: DataFrame) -> DataFrame:
        """Rows that no earlier round has found."""
        key = self._identity(table)
        for found in self._rounds[table]:
            rows = matching(rows, found, [(k, k) for k in key], "left_anti")
        return rows

    def run(self, deleted: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Every table's deleted rows, those given and those that cascading keys take with them."""
        fresh = {}
        for table, rows in deleted.items():
            rows = rows.filter(none_null(self._identity(table)))
            fresh[table] = self._keep(table, rows.select(*[F.col(f"`{c}`") for c in self._needed(table)]).distinct())
        while fresh:
            found: dict[str, DataFrame] = {}
            for child, fk in self.links:
                if fk.on_delete != "CASCADE" or fk.parent not in fresh:
                    continue
                rows = self._children(child, fk, fresh[fk.parent]).filter(none_null(self._identity(child)))
                rows = rows.select(*[F.col(f"`{c}`") for c in self._needed(child)])
                found[child] = found[child].unionByName(rows) if child in found else rows
            new = {t: _written(self._without(t, rows.distinct()), "cascade") for t, rows in found.items()}
            fresh = {}
            for table, rows in new.items():
                if rows.take(1):
                    self._rounds[table].append(rows)
                    fresh[table] = rows
                else:
                    forget(rows)
        return {t: reduce(DataFrame.unionByName, rounds) for t, rounds in self._rounds.items() if rounds}

    def _keep(self, table: str, rows: DataFrame) -> DataFrame:
        kept = _written(rows, "cascade")
        self._rounds[table].append(kept)
        return kept

    def reach(self, deleted: dict[str, DataFrame]) -> DataFrame:
        """table_name, constraint_name, action, rows_reached: what every foreign key does, where it does anything.

        CASCADE counts the rows it takes along and SET NULL or SET DEFAULT the rows that stay and
        let go. RESTRICT counts rows in its way, and NO ACTION those of them that are not
        deleted by some other way.
        """
        gone = self.run(deleted)
        counts = []
        for child, fk in self.links:
            if fk.parent not in gone:
                continue
            rows = self._children(child, fk, gone[fk.parent])
            if fk.on_delete not in ("CASCADE", "RESTRICT") and child in gone:
                rows = matching(rows, gone[child], [(k, k) for k in self._identity(child)], "left_anti")
            names = [F.lit(x).alias(n) for x, n in ((child, "table_name"), (fk.name, "constraint_name"), (fk.on_delete, "action"))]
            counts.append(rows.agg(F.count(F.lit(1)).alias("rows_reached")).select(*names, "rows_reached"))
        if not counts:
            spark = next(iter(self.tables.values())).sparkSession
            return spark.createDataFrame([], REACH)
        return reduce(DataFrame.unionByName, counts).filter("rows_reached > 0")

    def allowed(self, reach: DataFrame) -> bool:
        """Whether nothing is in the way of the delete."""
        return not reach.filter(F.col("action").isin(*RESTRICTING)).take(1)
