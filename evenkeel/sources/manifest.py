"""Items from files: what a path says about the file, and its checksum.

In the folder layout the first folder is the type, and ``schema`` has a folder
per namespace. In the flat layout a prefix of the file name is the type. Files
that fit neither are not items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.fixed import (
    DEFAULT_NAMESPACE,
    FLAT_REPEATABLE_FILE,
    FLAT_SCHEMA_FILE,
    FLAT_VERSIONED_FILE,
    PLAIN_FILE,
    RUN_ONCE,
    TYPE_RANK,
    VERSIONED_FILE,
)
from evenkeel.operators.ledger import checksum

UNVERSIONED = tuple(t for t in TYPE_RANK if t not in (*RUN_ONCE, "schema"))


def _words(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def parse_manifest(files: DataFrame, layout: str = "folder") -> DataFrame:
    """Files (path below the root, content) as items: type, version, name, namespace, checksum, filename."""
    path = F.col("path")
    none = F.lit(None).cast("string")
    if layout == "flat":
        versioned, schema, repeatable = (
            path.rlike(p) & ~F.contains(path, F.lit("/"))
            for p in (FLAT_VERSIONED_FILE, FLAT_SCHEMA_FILE, FLAT_REPEATABLE_FILE)
        )
        type_ = F.when(versioned, "ops").when(schema, "schema").when(repeatable, "logic")
        version = F.when(versioned, F.regexp_extract(path, FLAT_VERSIONED_FILE, 1))
        name = (
            F.when(versioned, _words(F.regexp_extract(path, FLAT_VERSIONED_FILE, 2)))
            .when(schema, F.regexp_extract(path, FLAT_SCHEMA_FILE, 1))
            .when(repeatable, F.regexp_extract(path, FLAT_REPEATABLE_FILE, 1))
        )
        namespace = F.when(schema, DEFAULT_NAMESPACE)
    else:
        parts = F.split(path, "/")
        folder, depth, file = parts[0], F.size(parts), F.element_at(parts, -1)
        versioned = folder.isin(*RUN_ONCE) & (depth == 2) & file.rlike(VERSIONED_FILE)
        schema = (folder == "schema") & (depth == 3) & file.rlike(PLAIN_FILE)
        plain = folder.isin(*UNVERSIONED) & (depth == 2) & file.rlike(PLAIN_FILE)
        type_ = F.when(versioned | schema | plain, folder)
        version = F.when(versioned, F.regexp_extract(file, VERSIONED_FILE, 1))
        name = F.when(versioned, _words(F.regexp_extract(file, VERSIONED_FILE, 2))).otherwise(
            F.regexp_extract(file, PLAIN_FILE, 1)
        )
        namespace = F.when(schema, F.try_element_at(parts, F.lit(2))).otherwise(none)
    return files.select(
        type_.alias("type"),
        version.alias("version"),
        name.alias("name"),
        namespace.alias("namespace"),
        checksum(F.col("content")).alias("checksum"),
        path.alias("filename"),
    ).filter(F.col("type").isNotNull())


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """All ``.sql`` files below a folder: path below it, content as bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = files.option("pathGlobFilter", "*.sql").load(root)
    # The scan reports full paths with a scheme; the root is given without one or with it.
    below = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return found.select(F.substring_index(F.col("path"), below, -1).alias("path"), "content")


def scan_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The items below a folder: by folder if any of the type folders is there, else flat."""
    files = read_files(spark, root)
    foldered = files.filter(F.split("path", "/")[0].isin(*TYPE_RANK) & F.contains("path", F.lit("/")))
    return parse_manifest(files, "flat" if foldered.select("path").isEmpty() else "folder")
