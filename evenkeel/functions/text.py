"""Values written the way a plan line shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(c: Column) -> Column:
    """``O'Brien`` -> ``'O''Brien'``, NULL -> ``NULL``."""
    quoted = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(quoted, F.lit("NULL"))


def row_text(cols: list[Column]) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *[literal(c) for c in cols]), F.lit(")"))
