"""COUNT(*), with the dialect's rule that LIMIT and OFFSET apply to its one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_count(df: DataFrame, rows: int, limit: int | None = None, offset: int = 0, name: str = "count(*)") -> DataFrame:
    """The same for a table whose number of rows its manifest has: nothing is scanned."""
    out = df.sparkSession.range(1).select(F.lit(rows).cast("long").alias(name))
    return out.limit(0) if limit == 0 or (limit is not None and offset > 0) else out


def count_rows(df: DataFrame, limit: int | None = None, offset: int = 0, name: str = "count(*)") -> DataFrame:
    out = df.agg(F.count(F.lit(1)).alias(name))
    if limit == 0 or (limit is not None and offset > 0):
        return out.limit(0)
    return out
