"""The ledger as a table of Parquet files that is only ever added to."""

from __future__ import annotations

import getpass
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.fixed import LEDGER_TYPES
from evenkeel.operators import ledger as ops
from evenkeel.session import forget, new_path


@dataclass(frozen=True)
class Item:
    """A piece of work: ``run`` does it, the rest says what it is."""

    type: str
    name: str
    checksum: str
    run: Callable[[], None]
    version: str | None = None
    namespace: str | None = None


@dataclass
class RunReport:
    applied: list[Item] = field(default_factory=list)
    skipped: list[Item] = field(default_factory=list)
    failed: Item | None = None
    error: Exception | None = None


class AlreadyDone(ValueError):
    """A run-once item of that version has succeeded before; nothing was recorded."""


class LedgerStore:
    """One writer at a time; readers see whole appends."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """The ledger, empty where none has been written; reading never creates it."""
        try:
            return self.spark.read.schema(ops.LEDGER).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ops.LEDGER)

    def append(self, outcomes: DataFrame, at: datetime | None = None, by: str | None = None) -> None:
        """Add outcomes; a run-once item succeeds once, so with a second success of a version none is added."""
        judged = self._judged(outcomes)
        clash = judged.filter("refused").take(1)
        if clash:
            forget(judged)
            raise AlreadyDone(f"{clash[0].type} {clash[0].version} has already succeeded")
        self._add(judged, at, by)
        forget(judged)

    def append_new(self, outcomes: DataFrame, at: datetime | None = None, by: str | None = None) -> DataFrame:
        """Add the outcomes that may be added; those refused as second successes of a version are returned.

        Of several successes of one version in ``outcomes`` the first by name, namespace and checksum counts.
        """
        judged = self._judged(outcomes)
        self._add(judged, at, by)
        return judged.filter("refused").drop("refused")

    def _judged(self, outcomes: DataFrame) -> DataFrame:
        """The outcomes and whether each is ``refused``, written before anything is added to what they are compared with."""
        once = ops.is_run_once() & F.col("success")
        done = self.read().filter(once).select("type", "version").distinct().withColumn("done__", F.lit(True))
        first = Window.partitionBy("type", "version").orderBy("name", "namespace", "checksum")
        asked = outcomes.filter(once).withColumn("nth__", F.row_number().over(first))
        asked = asked.join(done, ["type", "version"], "left")
        asked = asked.withColumn("refused", F.col("done__").isNotNull() | (F.col("nth__") > 1))
        others = outcomes.filter(~F.coalesce(once, F.lit(False))).withColumn("refused", F.lit(False))
        judged = asked.select(*outcomes.columns, "refused").unionByName(others)
        path = new_path(self.spark, "outcomes")
        judged.write.parquet(path)
        return self.spark.read.schema(judged.schema).parquet(path)

    def _add(self, judged: DataFrame, at: datetime | None, by: str | None) -> None:
        last = self.read().agg(F.max("id")).first()[0] or 0
        at = at or datetime.now(timezone.utc).replace(tzinfo=None)
        new = judged.filter("NOT refused").drop("refused")
        ops.recorded(new, last, at, by or getpass.getuser()).write.mode("append").parquet(self.path)

    def _record(self, item: Item, ms: int, success: bool) -> None:
        if item.type not in LEDGER_TYPES:
            return
        row = [(item.version, item.name, item.type, item.namespace, item.checksum, ms, success)]
        schema = (
            "version string, name string, type string, namespace string, checksum string, "
            "execution_ms bigint, success boolean"
        )
        self.append(self.spark.createDataFrame(row, schema))

    def _manifest(self, items: list[Item]) -> DataFrame:
        rows = [(i.type, i.version, i.name, i.namespace, i.checksum, n) for n, i in enumerate(items)]
        return self.spark.createDataFrame(
            rows, "type string, version string, name string, namespace string, checksum string, n int"
        )

    def _work(self, todo: list[tuple[Item, bool]], report: RunReport) -> RunReport:
        for item, due in todo:
            if not due:
                report.skipped.append(item)
                continue
            started = time.monotonic()
            try:
                item.run()
            except Exception as e:
                self._record(item, int((time.monotonic() - started) * 1000), False)
                report.failed, report.error = item, e
                return report
            self._record(item, int((time.monotonic() - started) * 1000), True)
            report.applied.append(item)
        return report

    def run(self, items: list[Item]) -> RunReport:
        """Run what is pending or changed, in work order; stop at the first failure.

        Declared rows have no ledger: they are compared on every run. Success and
        failure are both recorded. A failure does not count as done, so the next
        run tries it again. The items are jobs, a handful of them.
        """
        state = ops.work_list(ops.status(self._manifest(items), self.read())).collect()
        return self._work([(items[r.n], r.status not in ("applied", "drift")) for r in state], RunReport())

    def adopt(self, items: list[Item]) -> RunReport:
        """Take over a system that is as it is.

        Run-once items count as done, those that are recorded as such already
        stay as they are; the others run whatever their checksum.
        """
        manifest = self._manifest(items)
        self.append(ops.baseline(ops.pending(manifest, self.read())))
        order = ops.work_list(ops.adopt_actions(manifest)).collect()
        return self._work([(items[r.n], r.action != "baseline") for r in order], RunReport())
