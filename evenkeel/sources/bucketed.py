"""Tables kept by their key, so that joins on it need no shuffle, and their highest values read from file footers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parquet read by the newer reader, which answers min, max and count from footers.
_FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def keep_bucketed(rows: DataFrame, table: str, key: list[str], buckets: int) -> DataFrame:
    """The rows as a table of the catalog, bucketed and sorted by ``key``; one shuffle, when it is written.

    Two tables of as many buckets are joined on the key where they lie, and of a table and
    a frame only the frame is shuffled. One task writes a bucket, so a bucket is one file.
    """
    columns = [F.col(f"`{k}`") for k in key]
    placed = rows.repartition(buckets, *columns)
    placed.write.format("parquet").bucketBy(buckets, *key).sortBy(*key).mode("overwrite").saveAsTable(table)
    return rows.sparkSession.table(table)


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _highest(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).agg(*[F.max(f"`{c}`").alias(c) for c in columns])


def highest_values(spark: SparkSession, path: str, columns: list[str]) -> dict[str, int | None]:
    """The highest value of whole-number columns of Parquet files, from their footers: no row is read."""
    with _settings(spark, _FOOTERS):
        return _highest(spark, path, columns).first().asDict()


def highest_plan(spark: SparkSession, path: str, columns: list[str]) -> str:
    """The plan of ``highest_values``."""
    with _settings(spark, _FOOTERS):
        return _highest(spark, path, columns)._jdf.queryExecution().executedPlan().toString()
