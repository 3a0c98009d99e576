"""SELECT statements to DataFrames: names are resolved and rules checked here, nothing runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Code, EngineError
from ..operators import aggregates, joins, ordering, vector_search
from ..operators.predicates import predicate
from ..sql import ast
from ..types import Column as TableColumn
from ..types import Literal, mismatch

ROW = "_row_id"


@dataclass
class Source:
    """A table to read: its rows with their physical order in the columns `rows`, and its columns. count: its number of
    rows, where that is known without a scan; gaps: its row numbers aren't dense."""

    df: DataFrame
    columns: list[TableColumn]
    rows: tuple[str, ...] = (ROW,)
    count: int | None = None
    gaps: bool = False

    def column(self, name: str) -> TableColumn | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


class _Scope:
    """One input under its name: columns get internal names, so inputs and repeated projections cannot clash."""

    def __init__(self, source: Source, table: ast.Table, tag: str):
        self.source, self.name, self.tag = source, table.alias or table.name, tag
        self.df = source.df.select(*[F.col(f"`{c.name}`").alias(f"{tag}{i}") for i, c in enumerate(source.columns)], *[F.col(r).alias(f"{tag}row{i}") for i, r in enumerate(source.rows)])
        self.rows = [F.col(f"{tag}row{i}") for i in range(len(source.rows))]

    def find(self, name: ast.Name) -> tuple[Column, TableColumn] | None:
        if name.table is not None and name.table.lower() != self.name.lower():
            return None
        column = self.source.column(name.name)
        return None if column is None else (F.col(f"{self.tag}{self.source.columns.index(column)}"), column)


def _missing(name: ast.Name) -> EngineError:
    return EngineError(Code.COLUMN_NOT_FOUND, "column not found in schema", name.offset)


def _resolver(scopes: list[_Scope]) -> Callable[[ast.Name], tuple[Column, TableColumn]]:
    def resolve(name: ast.Name) -> tuple[Column, TableColumn]:
        for scope in scopes:
            if found := scope.find(name):
                return found
        raise _missing(name)

    return resolve


@dataclass
class Planned:
    df: DataFrame
    names: list[str]


def plan_select(statement: ast.Select, source_of: Callable[[ast.Table], Source], value_of: Callable[[Literal, str], Literal], in_order: bool = False) -> Planned:
    """The result as a lazy DataFrame.

    in_order: also sort by physical order where the statement has none of its own. Without it, only a LIMIT brings the
    physical order in, as it decides which rows are taken.
    """
    def scope_of(table: ast.Table, tag: str) -> _Scope:
        source = source_of(table)
        if statement.join and source.gaps and (in_order or statement.limit is not None):  # batches hold live rows
            source = replace(source, df=ordering.dense_rows(source.df, ROW, ROW), gaps=False)
        return _Scope(source, table, tag)

    left = scope_of(statement.table, "l")
    scopes = [left]
    if statement.join:
        right = scope_of(statement.join.table, "r")
        scopes.append(right)
    resolve = _resolver(scopes)
    if statement.join and (statement.count or statement.columns is None or any(c.table is None for c in statement.columns)):
        raise EngineError(Code.SYNTAX, "JOIN projections must be explicitly qualified")
    names = [c.name for c in left.source.columns] if statement.columns is None else []
    projected = [(F.col(f"l{i}"), c) for i, c in enumerate(left.source.columns)] if statement.columns is None else [resolve(c) for c in statement.columns]
    names = names or [c.name for _, c in projected]
    cells = lambda name: (lambda found: (found[0], found[1].type))(resolve(name))

    if statement.join:
        a, b = statement.join.left, statement.join.right
        sides = [(scope, name) for name in (a, b) for scope in scopes if name.table and name.table.lower() == scope.name.lower()]
        if len(sides) != 2 or sides[0][0] is sides[1][0]:
            raise _missing(a if not sides or sides[0][1] is not a else b)
        sides.sort(key=lambda s: s[0].tag)
        (left_key, left_column), (right_key, right_column) = (resolve(n) for _, n in sides)
        joins.check_keys(left_column.type, right_column.type, a.offset)
        if statement.where is not None:
            raise EngineError(Code.EXEC, "JOIN WHERE predicates are not implemented yet")
        if statement.order is not None:
            _order_column(statement, resolve)
            raise EngineError(Code.EXEC, "ORDER BY execution is not implemented yet")
        df = joins.equi_join(left.df, right.df, left_key, right_key, statement.join.outer)
        keys = ordering.emission_order(left.rows[0], right.rows[0]) if len(left.rows) == len(right.rows) == 1 else [*[r.asc() for r in left.rows], *[r.asc_nulls_last() for r in right.rows]]
    else:
        df = left.df
        if statement.where is not None:
            df = df.where(predicate(statement.where, cells, value_of))
        keys = [r.asc() for r in left.rows]

    if statement.count:
        if statement.order is not None:
            raise EngineError(Code.SYNTAX, "ORDER BY requires a projected column")
        if statement.where is None and left.source.count is not None:
            return Planned(aggregates.known_count(df, left.source.count, statement.limit, statement.offset), ["count(*)"])
        return Planned(aggregates.count_rows(df, statement.limit, statement.offset), ["count(*)"])

    order = statement.order
    if order is not None and isinstance(order.key, ast.Distance):
        cell, column = resolve(order.key.column)
        if column.type != "VECTOR" or (column.dimensions and column.dimensions != len(order.key.query)):
            raise mismatch(order.key.offset)
        if not statement.limit:
            raise EngineError(Code.SYNTAX, "vector distance ORDER BY requires LIMIT", order.key.offset)
        score = vector_search.score(cell, order.key.query, order.key.metric)
        df = vector_search.candidates(df, cell, order.key.metric).withColumn("score", score)
        by = F.col("score").desc() if order.descending else F.col("score").asc()
        df = ordering.ordered(df, [by, *keys], statement.limit, statement.offset)
    elif order is not None:
        cell, column = _order_column(statement, resolve)
        if column.type in ("TEXT", "BLOB", "VECTOR", "OTHER"):
            raise EngineError(Code.TYPE_MISMATCH, "ORDER BY requires INT32, INT64, FLOAT32 or BOOL", order.key.offset)
        df = ordering.ordered(df, [ordering.key(cell, order.descending), *keys], statement.limit, statement.offset)
    else:
        df = ordering.ordered(df, keys if in_order or statement.limit is not None else [], statement.limit, statement.offset)
    seen: dict[str, int] = {}
    out = []
    for (cell, _), name in zip(projected, names, strict=True):
        seen[name] = seen.get(name, 0) + 1
        out.append(cell.alias(name if seen[name] == 1 else f"{name}:{seen[name]}"))
    return Planned(df.select(*out), names)


def _order_column(statement: ast.Select, resolve) -> tuple[Column, TableColumn]:
    """The ORDER BY column, which must be among the projected ones by name and table."""
    name = statement.order.key
    found = resolve(name)
    if statement.columns is None:
        raise _missing(name)
    for c in statement.columns:
        cell, column = resolve(c)
        if column is found[1] and str(cell) == str(found[0]):
            return found
    raise _missing(name)
