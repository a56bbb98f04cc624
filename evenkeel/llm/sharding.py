"""Contiguous shards of nearly equal size, by global prefix sums of byte sizes.

Rows are range-sorted by id and written with the partition they fell in. The
totals of the partitions are few; their prefix sums give every partition its
offset, and a running sum within the partition gives every row the bytes before
it. The byte range is cut at equal targets, and a row goes to the shard that holds
the middle of its bytes, so that no shard is off its target by more than one row
at either end.

NULL text has size 1 and the CRC of no bytes. NULL ids sort first. Rows that are
repeated each take their own place; an empty table has no rows in any shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import written


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and the row's slot in it, in order of doc_id."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    narrow = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # the hash parts rows of one id; it settles their order, too, as far as they differ
    narrow = narrow.withColumn("__tie", F.xxhash64("doc_id", "size", "text_crc32", F.monotonically_increasing_id()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(
        narrow.repartitionByRange(parts, "doc_id", "size", "text_crc32", "__tie").withColumn(
            "__part", F.spark_partition_id()
        ),
        "shard-ranges",
    )

    # One row a partition: a window over all of them is small whatever the data.
    totals = ranged.groupBy("__part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "__part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("__bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__rows"),
        F.sum("bytes").over(everything).alias("__all"),
    )

    within = Window.partitionBy("__part").orderBy("doc_id", "size", "text_crc32", "__tie")
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("__upto", F.sum("size").over(running))
        .withColumn("__nth", F.row_number().over(within))
        .join(F.broadcast(offsets), "__part")
        .withColumn("__middle", 2 * (F.col("__bytes") + F.col("__upto")) - F.col("size"))
        .withColumn("shard", F.expr(f"CAST(__middle * {shards} DIV (2 * __all) AS INT)"))
        .withColumn("__row", F.col("__rows") + F.col("__nth") - 1)
        .select("doc_id", "size", "text_crc32", "shard", "__row")
    )
    placed = written(placed, "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("__row").alias("__first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("__row") - F.col("__first")).alias("slot")
    )
