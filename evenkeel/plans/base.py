"""How a registered query is written down."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@dataclass(frozen=True)
class Query:
    """A job over the tables in a folder, and the same in SQL if SQL can say it."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a text that names tables as ``{customer}``."""
    return spark.sql(sql.format_map({t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def in_sql(sql: str) -> str:
    """The same text with plain table names."""
    return sql.format_map({t: t for t in TABLES})


def with_inputs(body: str, **inputs: str) -> str:
    """A statement over named inputs."""
    parts = ",\n".join(f"{name} AS ({in_sql(text)})" for name, text in inputs.items())
    return f"WITH {parts}\n{body}"
