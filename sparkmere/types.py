"""The dialect's types, their Spark types, and values of literals."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import types as T

from .errors import Code, EngineError

#: Names and aliases of the column types.
ALIASES = {
    "INT32": "INT32", "INTEGER": "INT32", "INT64": "INT64", "BIGINT": "INT64", "FLOAT32": "FLOAT32", "REAL": "FLOAT32",
    "BOOL": "BOOL", "BOOLEAN": "BOOL", "TEXT": "TEXT", "BLOB": "BLOB", "VECTOR": "VECTOR",
}
INT_RANGE = {"INT32": (-(1 << 31), (1 << 31) - 1), "INT64": (-(1 << 63), (1 << 63) - 1)}
MAX_NAME, MAX_COLUMN_NAME, MAX_COLUMNS, MAX_DIMENSIONS = 31, 23, 64, 4096
_SPARK = {"INT32": T.IntegerType(), "INT64": T.LongType(), "FLOAT32": T.FloatType(), "BOOL": T.BooleanType(), "TEXT": T.StringType(), "BLOB": T.BinaryType()}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    dimensions: int = 0

    def field(self) -> T.StructField:
        kind = T.ArrayType(T.FloatType(), False) if self.type == "VECTOR" else _SPARK[self.type]
        return T.StructField(self.name, kind, True, {"dimensions": self.dimensions} if self.type == "VECTOR" else {})


def of_spark(kind: T.DataType) -> str:
    """The dialect's name of a Spark type; FLOAT64 for doubles of outside tables, OTHER where it has none."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return "VECTOR"
    if isinstance(kind, T.DoubleType):
        return "FLOAT64"
    return next((k for k, v in _SPARK.items() if type(v) is type(kind)), "OTHER")


def columns_of(schema: T.StructType) -> list[Column]:
    return [Column(f.name, of_spark(f.dataType), f.nullable, int((f.metadata or {}).get("dimensions", 0))) for f in schema.fields]


def float32(value: Fraction, negative: bool = False) -> float:
    """The nearest binary32 of an exact rational number, ties to even, rounded once. Beyond the range: OverflowError."""
    if value == 0:
        return -0.0 if negative else 0.0
    sign, v = (-1 if value < 0 else 1), abs(value)
    exponent = v.numerator.bit_length() - v.denominator.bit_length()
    if v < Fraction(2) ** exponent:
        exponent -= 1
    exponent = max(exponent, -126)
    unit = Fraction(2) ** (exponent - 23)
    count = v / unit
    whole = count.numerator // count.denominator
    rest = count - whole
    if rest > Fraction(1, 2) or (rest == Fraction(1, 2) and whole % 2):
        whole += 1
    out = Fraction(whole) * unit
    if out > Fraction((1 << 24) - 1) * Fraction(2) ** 104:
        raise OverflowError
    return sign * float(out) if out else (-0.0 if negative or sign < 0 else 0.0)


def as_float32(value: float) -> float:
    return struct.unpack("<f", struct.pack("<f", value))[0]


@dataclass(frozen=True)
class Literal:
    """kind: INT, FLOAT, BOOL, TEXT, BLOB, VECTOR, NULL or PARAM (value: its number)."""

    kind: str
    value: object
    offset: int = -1
    exact: Fraction | None = None  # of FLOAT


def mismatch(offset: int = -1) -> EngineError:
    return EngineError(Code.TYPE_MISMATCH, "type mismatch", offset)


def stored(literal: Literal, column: Column) -> object:
    """The Python value that a literal gives a column, by the rules of INSERT and UPDATE."""
    kind, value = literal.kind, literal.value
    if kind == "NULL":
        if not column.nullable:
            raise EngineError(Code.NOT_NULLABLE, "cannot insert NULL into non-nullable column", literal.offset)
        return None
    if column.type in INT_RANGE and kind == "INT":
        low, high = INT_RANGE[column.type]
        if low <= value <= high:
            return value
    elif column.type == "FLOAT32" and kind in ("INT", "FLOAT"):
        return float32(Fraction(value)) if kind == "INT" else value
    elif column.type == "BOOL" and (kind == "BOOL" or (kind == "INT" and value in (0, 1))):
        return bool(value)
    elif column.type == kind and kind in ("TEXT", "BLOB"):
        return value
    elif column.type == kind == "VECTOR" and len(value) == column.dimensions:
        return list(value)
    raise mismatch(literal.offset)


def compared(literal: Literal, kind: str) -> object:
    """The value that a literal is compared by with a column of the given type."""
    if kind in INT_RANGE and literal.kind == "INT":
        low, high = INT_RANGE[kind]
        if low <= literal.value <= high:
            return literal.value
    elif kind == "FLOAT32" and literal.kind in ("INT", "FLOAT"):
        return float32(Fraction(literal.value)) if literal.kind == "INT" else literal.value
    elif kind == "FLOAT64" and literal.kind in ("INT", "FLOAT"):
        return float(literal.value) if literal.kind == "INT" or literal.exact is None else literal.exact.numerator / literal.exact.denominator
    elif kind == "BOOL" and literal.kind == "BOOL":
        return literal.value
    raise mismatch(literal.offset)
