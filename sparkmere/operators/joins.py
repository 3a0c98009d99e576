"""Equi-joins of two inputs with the dialect's key rules; Catalyst picks broadcast, hash or merge by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..errors import Code, EngineError
from ..types import mismatch


def check_keys(left_type: str, right_type: str, offset: int = -1) -> None:
    if left_type not in ("INT32", "INT64") or right_type not in ("INT32", "INT64"):
        if left_type != right_type:
            raise mismatch(offset)
        raise EngineError(Code.TYPE_MISMATCH, "JOIN keys currently require INT32 or INT64", offset)
    if left_type != right_type:
        raise mismatch(offset)


def equi_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, outer: bool) -> DataFrame:
    """Null keys never match; a left join keeps each unmatched left row once."""
    return left.join(right, left_key == right_key, "left" if outer else "inner")
