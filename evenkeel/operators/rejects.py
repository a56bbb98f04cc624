"""What was refused, in numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reject_summary(rejects: DataFrame) -> DataFrame:
    """Rejects (kind, detail, seq) per kind: how many different ones, and the first.

    The same detail met again is the same reject. Both steps combine before
    they shuffle. Most frequent kind first, then by name.
    """
    once = rejects.groupBy("detail").agg(F.min_by("kind", "seq").alias("kind"), F.min("seq").alias("seq"))
    return (
        once.groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("detail", "seq").alias("example"), F.min("seq").alias("first_seq"))
        .orderBy(F.desc("n"), "kind")
    )


def summary_line(summary: DataFrame) -> str:
    """``2 CREATE VIEW, 1 CREATE TABLE (first: ...)``; kinds are a handful of names."""
    kinds = summary.collect()
    if not kinds:
        return ""
    first = min(kinds, key=lambda r: r.first_seq)
    return f"{', '.join(f'{r.n} {r.kind}' for r in kinds)} (first: {first.example})"
