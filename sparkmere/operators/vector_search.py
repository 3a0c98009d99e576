"""Exact vector top-k as DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Code, EngineError
from ..functions import vector as V
from .ordering import ordered


def score(cell: Column, query: Sequence[float], metric: str) -> Column:
    """What rows are ordered by, ascending from nearest. L2 of a row beyond FLOAT32 is an error, as its score has no place in the order."""
    if metric == "l2":
        d = V.l2_squared(cell, V.vector_literal(query))
        return F.when(d <= F.lit(V.FLT_MAX), d).otherwise(F.raise_error(F.lit("vector distance is not finite")).cast("double"))
    if not V.has_direction(query):
        raise EngineError(Code.EXEC, "query vector cannot be normalized")
    return -V.cosine_similarity(cell, query)


def candidates(df: DataFrame, cell: Column, metric: str) -> DataFrame:
    """Rows that can be scored: vectors that aren't null and, for cosine, have a direction."""
    return df.where(cell.isNotNull()) if metric == "l2" else df.where(V.normalizable(cell))


def topk(df: DataFrame, vector: str, query: Sequence[float], k: int, metric: str = "l2", row: str = "vector_id", reverse: bool = False, offset: int = 0, only: DataFrame | None = None) -> DataFrame:
    """The k nearest rows of df (farthest with reverse), ties by smaller row id either way, after `offset` of them.

    only: a table of row ids to choose among (a semi-join). One pass; every task keeps k + offset rows.
    """
    if k <= 0:
        raise EngineError(Code.SYNTAX, "vector distance ORDER BY requires LIMIT")
    if only is not None:
        df = df.join(only.select(row).distinct(), row, "left_semi")
    cell = F.col(vector)
    rows = candidates(df, cell, metric).withColumn("__score__", score(cell, query, metric))
    by = F.col("__score__").desc() if reverse else F.col("__score__").asc()
    return ordered(rows, [by, F.col(row).asc()], k, offset).drop("__score__")


class Arena:
    """A set of vectors of one dimension, built row by row: raw ones must be finite, normalized ones also not zero."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.rows: list[tuple[int, list[float]]] = []

    def _checked(self, values: Sequence[float]) -> list[float]:
        out = [float(v) for v in values]
        if len(out) != self.dimensions:
            raise EngineError(Code.TYPE_MISMATCH, "type mismatch")
        if any(v != v or abs(v) == float("inf") for v in out):
            raise EngineError(Code.EXEC, "vector is not finite")
        return out

    def append_raw(self, values: Sequence[float]) -> int:
        self.rows.append((len(self.rows), self._checked(values)))
        return len(self.rows) - 1

    def append_normalized(self, values: Sequence[float]) -> int:
        out = self._checked(values)
        if not V.has_direction(out):
            raise EngineError(Code.EXEC, "vector cannot be normalized")
        n = sum(v * v for v in out) ** 0.5
        self.rows.append((len(self.rows), [v / n for v in out]))
        return len(self.rows) - 1

    def get(self, row: int) -> list[float]:
        return self.rows[row][1]

    def dataframe(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "vector_id long, vec array<float>")
