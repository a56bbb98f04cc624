"""Keys held by so many rows that one task should not take them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SHARES = 8
HOT_ROWS_SETTING = "spark.evenkeel.hotRows"


def hot_keys(rows: DataFrame, on: list[str], at_least: int | None = None) -> DataFrame | None:
    """The keys with so many rows that they make a task longer than others, None if there are none.

    That is more than their share, one part in ``SHARES`` times the number of
    shuffle partitions, and at least the session's limit. There are fewer such
    keys than parts, whatever the size of the data, so the frame returned can be
    broadcast; every other key is smaller than a task's share. Rows are counted
    before they are shuffled.
    """
    spark = rows.sparkSession
    if at_least is None:
        at_least = int(spark.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))
    parts = SHARES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head().n
    found = counts.filter(F.col("n") >= max(at_least, total // parts)).drop("n").collect()
    if not found:
        return None
    return spark.createDataFrame(found, rows.select(*on).schema)
