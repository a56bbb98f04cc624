"""What the operators share: narrow inputs, written intermediates, joins on hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.session import forget, new_path


#: Rows of one Arrow batch: with Spark's default of 10,000 a task would hold that many long texts several times.
ROWS_PER_BATCH = 500
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_TIDY_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches() -> None:
    """Lower the session's limit of rows in an Arrow batch to ROWS_PER_BATCH, unless it is lower."""
    spark = SparkSession.active()
    rows = int(spark.conf.get(_BATCH_SETTING, "0"))
    if rows <= 0 or rows > ROWS_PER_BATCH:
        spark.conf.set(_BATCH_SETTING, str(ROWS_PER_BATCH))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (NULL read as empty), whatever other columns there are."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


_scratch: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again, so that its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    if _scratch.get() is not None:
        _scratch.get().append(found)
    return found


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Frames ``written`` inside are deleted when it ends, but for those passed through the function it gives."""
    frames: list[DataFrame] = []
    kept: list[DataFrame] = []
    token = _scratch.set(frames)

    def keep(frame: DataFrame) -> DataFrame:
        kept.append(frame)
        return frame

    try:
        yield keep
    finally:
        _scratch.reset(token)
        for frame in frames:
            if not any(frame is k for k in kept):
                forget(frame)


def heavy_bound(spark: SparkSession) -> int:
    """Most keys that ``attach`` calls heavy."""
    return 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, lookup: DataFrame, key: str, count: str = "n") -> DataFrame:
    """``rows`` with the columns of ``lookup`` (one row a key, ``count`` rows held by it).

    A key that holds more than its share, one part in ``heavy_bound`` of all
    rows, would make its task longer than the others. There are fewer such
    keys than ``heavy_bound``, so these are broadcast whatever the size of the
    data; the rest is joined by a shuffle. ``lookup`` should be written: it is
    read three times.
    """
    bound = heavy_bound(rows.sparkSession)
    total = lookup.agg(F.coalesce(F.sum(count), F.lit(0)).alias("t")).head().t
    share = max(1000, total // bound)
    heavy = lookup.filter(F.col(count) > share)
    if not heavy.take(1):
        return rows.join(lookup.drop(count), key)
    light = lookup.filter(F.col(count) <= share).drop(count)
    flagged = rows.join(F.broadcast(heavy.select(key, F.lit(True).alias("__heavy"))), key, "left")
    hot = rows.join(F.broadcast(heavy.drop(count)), key)
    return flagged.filter(F.col("__heavy").isNull()).drop("__heavy").join(light, key).unionByName(hot)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs inside drop their shuffle files as each one ends, not when the driver next collects garbage.

    Meant for chains of written frames: nothing inside reads the shuffles of an earlier job.
    """
    before = spark.conf.get(_TIDY_SETTING, "false")
    spark.conf.set(_TIDY_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY_SETTING, before)


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Batches sorted by ``key``, as one stream of slices for each of its values."""
    slices = (piece for batch in batches if batch.num_rows for piece in _cut(batch, key))
    for value, some in groupby(slices, key=lambda piece: piece[0]):
        yield value, (piece for _, piece in some)


def _cut(batch: pa.RecordBatch, key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    values = batch.column(key).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    for a, b in zip(edges, edges[1:]):
        yield int(values[a]), batch.slice(a, b - a)
