"""Tables of Spark's catalog, written by Spark's writers and published together.

Rows are in Parquet tables partitioned by a hash bucket of the key. A table's next state
is a table of its own: Spark writes the partitions that change into it, and the
catalog attaches the others where they already lie, so a change that touches few buckets
writes only those and the present table is not touched. One view of the
database names, for every table, the catalog table that is current. Replacing that view is
the one step that publishes, whatever the number of tables: before it readers see all of them
as they were, after it all as they are to be.

The step is as atomic as the catalog's own CREATE OR REPLACE VIEW. One writer at a time;
a writer that finds the view replaced since it read the tables is refused. Catalog tables
are external: dropping one that is no longer current drops its name, and the files of
partitions a later table has attached stay.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators.conform import any_null

BUCKET = "bucket__"
KEYLESS = -1
PUBLISHED = "published__"
_ATTACHED_AT_ONCE = 500
_FOLDER = re.compile(rf"(.*/{BUCKET}=(-?\d+))/[^/]*")


@dataclass(frozen=True)
class Stored:
    """A current table: the catalog table with its rows, its key and number of buckets.

    ``sequences`` are the last values of its serial columns; ``unique`` remembers keys that
    were found unique, as reconciling by a key keeps it so.
    """

    at: str
    key: list[str]
    buckets: int
    sequences: dict[str, int] = field(default_factory=dict)
    unique: list[list[str]] = field(default_factory=list)


class Conflict(RuntimeError):
    """Something else was published since the tables were read."""


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


class CatalogStore:
    """The tables of one database; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, database: str, location: str | None = None):
        self.spark, self.database = spark, database
        where = f" LOCATION {_quoted(location)}" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{where}")
        self.location = spark.catalog.getDatabase(database).locationUri.rstrip("/")

    def _name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def current(self) -> tuple[int, dict[str, Stored]]:
        """How often was published, and the current tables. No job: the view holds one row a table."""
        if not self.spark.catalog.tableExists(self._name(PUBLISHED)):
            return 0, {}
        rows = self.spark.table(self._name(PUBLISHED)).collect()
        return rows[0].version, {r.table_name: Stored(**json.loads(r.stored)) for r in rows}

    def catalog_schema(self, stored: Stored) -> T.StructType:
        """The columns as the catalog has them, with their defaults and the bucket."""
        return self.spark.table(self._name(stored.at)).schema

    def schema(self, stored: Stored) -> T.StructType:
        """Names and types of a table's own columns."""
        kept = [f for f in self.catalog_schema(stored).fields if f.name != BUCKET]
        return T.StructType([T.StructField(f.name, f.dataType) for f in kept])

    def read(self, stored: Stored, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets: a filter on the partition column, so no other file is read."""
        rows = self.spark.table(self._name(stored.at))
        if buckets is not None:
            rows = rows.filter(F.col(BUCKET).isin(buckets))
        return rows.drop(BUCKET)

    def table(self, name: str) -> DataFrame:
        return self.read(self.current()[1][name])

    def folder(self, name: str) -> str:
        return f"{self.location}/{name}"

    def bucket_of(self, rows: DataFrame, key: list[str], buckets: int, stored: T.StructType | None = None) -> Column:
        """The bucket of a row; rows without a key have one of their own.

        ``stored`` is the schema of the stored table: equal values of other types hash
        differently, so keys are hashed in the types the table stores. Blanks at
        the end do not count, so that padded text is found where it is not padded.
        """
        stored = stored or rows.schema
        parts = []
        for k in key:
            kind = stored[k].dataType
            c = F.col(f"`{k}`")
            c = c if rows.schema[k].dataType == kind else c.try_cast(kind)
            # numbers hash by value, so that a key that becomes wider stays in its bucket
            c = c.cast("long") if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)) else c
            parts.append(F.rtrim(c) if isinstance(kind, T.StringType) else c)
        hashed = F.pmod(F.xxhash64(*parts), F.lit(buckets))
        return F.when(any_null(key), KEYLESS).otherwise(hashed).cast("int")

    def _placed(self, rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
        """Rows with their bucket; rebalancing splits a large bucket into several files."""
        return rows.withColumn(BUCKET, self.bucket_of(rows, key, buckets)).hint("rebalance", F.col(BUCKET))

    def _new(self, name: str) -> tuple[str, str]:
        at = f"{name}__{uuid.uuid4().hex}"
        return at, f"{self.folder(name)}/{at}"

    def write(self, name: str, rows: DataFrame, key: list[str], buckets: int = 1) -> Stored:
        """The rows as a new catalog table that is not yet published."""
        at, path = self._new(name)
        placed = self._placed(rows, key, buckets)
        placed.write.format("parquet").partitionBy(BUCKET).option("path", path).saveAsTable(self._name(at))
        return Stored(at, list(key), buckets)

    def partitions(self, stored: Stored) -> dict[int, str]:
        """The folder of every bucket that has rows, by the files Spark lists for the table."""
        found = (_FOLDER.fullmatch(f) for f in self.spark.table(self._name(stored.at)).inputFiles())
        return {int(m[2]): m[1] for m in found if m}

    def _attach(self, at: str, folders: dict[int, str]) -> None:
        """Partitions that lie elsewhere, added to a table; one it already has is an error."""
        parts = [f"PARTITION ({BUCKET} = {b}) LOCATION {_quoted(f)}" for b, f in sorted(folders.items())]
        for k in range(0, len(parts), _ATTACHED_AT_ONCE):
            self.spark.sql(f"ALTER TABLE {self._name(at)} ADD {' '.join(parts[k : k + _ATTACHED_AT_ONCE])}")

    def rewrite(self, name: str, stored: Stored, rows: DataFrame, hit: list[int]) -> Stored:
        """A next table: the new rows of the buckets that were hit, and the other partitions where they are.

        A new row in a bucket that was not read would stand beside rows nobody looked
        at; attaching that bucket's partition fails then, and nothing is published.
        """
        kept = {b: f for b, f in self.partitions(stored).items() if b not in hit}
        at, path = self._new(name)
        self.spark.sql(f"CREATE TABLE {self._name(at)} LIKE {self._name(stored.at)} LOCATION {_quoted(path)}")
        self._placed(rows, stored.key, stored.buckets).write.mode("append").insertInto(self._name(at))
        self._attach(at, kept)
        return replace(stored, at=at)

    def reshape(self, name: str, stored: Stored, columns: list[tuple[str, str, str | None]]) -> Stored:
        """A next table of other columns (name, type, default) over the same files; nothing is written.

        What a file does not have is read as the default, and narrower numbers as the wider type.
        """
        at, path = self._new(name)
        ddl = ", ".join(f"`{c}` {t}" + (f" DEFAULT {d}" if d is not None else "") for c, t, d in columns)
        self.spark.sql(
            f"CREATE TABLE {self._name(at)} ({ddl}, {BUCKET} INT) USING parquet "
            f"PARTITIONED BY ({BUCKET}) LOCATION {_quoted(path)}"
        )
        self._attach(at, self.partitions(stored))
        return replace(stored, at=at)

    def publish(self, changes: dict[str, Stored], parent: int) -> int:
        """Make new tables current, all by one statement, if nothing was published since ``parent``."""
        version, tables = self.current()
        if version != parent:
            raise Conflict(f"tables were read at version {parent}, but version {version} is current")
        after = {**tables, **changes}
        rows = ", ".join(f"({_quoted(t)}, {_quoted(json.dumps(asdict(s)))}, {parent + 1})" for t, s in after.items())
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {self._name(PUBLISHED)} AS "
            f"SELECT * FROM VALUES {rows} AS t(table_name, stored, version)"
        )
        return parent + 1

    def create(self, name: str, rows: DataFrame, key: list[str], buckets: int = 1) -> int:
        version, _ = self.current()
        return self.publish({name: self.write(name, rows, key, buckets)}, version)

    def drop_superseded(self) -> list[str]:
        """Drop the names of catalog tables that are no longer current; no file is deleted."""
        current = {s.at for s in self.current()[1].values()}
        listed = [t.name for t in self.spark.catalog.listTables(f"`{self.database}`") if not t.isTemporary]
        gone = [t for t in listed if t != PUBLISHED and t not in current]
        for name in gone:
            self.spark.sql(f"DROP TABLE {self._name(name)}")
        return gone
