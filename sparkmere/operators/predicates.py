"""Predicates with three-valued logic and IEEE rules, as plain Column comparisons that reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Code, EngineError
from ..sql import ast
from ..types import Literal, compared, mismatch

_FLOATS = ("FLOAT32", "FLOAT64")


def compare(cell: Column, op: str, value: object, kind: str) -> Column:
    """cell OP value. NaN compares false by every operator; Spark differs for three of them, which get a guard."""
    literal = F.lit(value).cast("float") if kind == "FLOAT32" else F.lit(value)
    if kind == "INT32":
        literal = F.lit(value).cast("int")
    elif kind == "INT64":
        literal = F.lit(value).cast("bigint")
    out = {"=": cell == literal, "!=": cell != literal, "<": cell < literal, "<=": cell <= literal, ">": cell > literal, ">=": cell >= literal}[op]
    return out & ~F.isnan(cell) if kind in _FLOATS and op in (">", ">=", "!=") else out


def predicate(expression: object, resolve: Callable[[ast.Name], tuple[Column, str]], value_of: Callable[[Literal, str], Literal]) -> Column:
    """The Column of a predicate. resolve: a name's Column and type; value_of: a parameter's literal for a type."""
    if isinstance(expression, ast.Logic):
        left = predicate(expression.left, resolve, value_of)
        right = predicate(expression.right, resolve, value_of)
        return left & right if expression.op == "AND" else left | right
    if isinstance(expression, ast.Not):
        return ~predicate(expression.operand, resolve, value_of)
    if isinstance(expression, ast.IsNull):
        cell, _ = resolve(expression.column)
        return cell.isNotNull() if expression.negated else cell.isNull()
    if isinstance(expression, ast.Compare):
        cell, kind = resolve(expression.column)
        literal = expression.value
        if literal.kind == "NULL":
            return F.lit(None).cast("boolean")  # unknown
        if kind not in ("INT32", "INT64", "BOOL", *_FLOATS):
            raise EngineError(Code.TYPE_MISMATCH, "unsupported expression comparison", expression.offset)
        if kind == "BOOL" and expression.op not in ("=", "!="):
            raise EngineError(Code.TYPE_MISMATCH, "unsupported expression comparison", expression.offset)
        if literal.kind == "PARAM":
            literal = value_of(literal, kind)
        return compare(cell, expression.op, compared(literal, kind), kind)
    raise mismatch()
