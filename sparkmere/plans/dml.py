"""Changes of tables: new immutable parts for the staged manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Code, EngineError
from ..operators.ordering import dense_rows
from ..operators.predicates import predicate
from ..sources.catalog import ROW, Catalog, table_columns, table_schema
from ..sql import ast
from ..types import INT_RANGE, Literal, mismatch, stored

Value = Callable[[Literal, str], Literal]
#: Dead rows that stand in the manifest, and parts of single INSERTs, before files are written anew.
MARKS, SMALL_PARTS = 4096, 32


def _unique_columns(catalog: Catalog, state: dict, table: str) -> list[str]:
    return [i["column"] for i in catalog.indexes(state, table) if i["unique"]]


def _violation() -> EngineError:
    return EngineError(Code.EXEC, "unique index violation")


def insert(catalog: Catalog, state: dict, statement: ast.Insert, value_of: Value) -> int:
    entry = catalog.entry(state, statement.table, "table")
    columns = table_columns(entry)
    if statement.columns is not None and [c.lower() for c in statement.columns] != [c.name.lower() for c in columns]:
        raise EngineError(Code.VALUE_COUNT, "an INSERT column list must name all columns in schema order")
    rows = []
    for n, row in enumerate(statement.rows):
        if len(row) != len(columns):
            raise EngineError(Code.VALUE_COUNT, "value count does not match column count", row[0].offset)
        values = [stored(value_of(v, c.type) if v.kind == "PARAM" else v, c) for v, c in zip(row, columns, strict=True)]
        rows.append((*values, entry["next"] + n))
    for column in _unique_columns(catalog, state, statement.table):
        at = next(i for i, c in enumerate(columns) if c.name.lower() == column.lower())
        new = [r[at] for r in rows if r[at] is not None]
        if len(set(new)) < len(new) or (new and entry["rows"] and catalog.rows(entry).where(F.col(f"`{columns[at].name}`").isin(new)).limit(1).count()):
            raise _violation()
    df = catalog.spark.createDataFrame(rows, table_schema(entry)).coalesce(1)
    entry["parts"].append(catalog.write_part(entry["name"], df))
    entry["small"] = entry.get("small", 0) + 1
    if entry["small"] >= SMALL_PARTS:
        join_small(catalog, entry)
    entry["rows"] += len(rows)
    entry["next"] += len(rows)
    return len(rows)


def load(catalog: Catalog, state: dict, table: str, df: DataFrame, order: str) -> int:
    """Appends a DataFrame of any size in the order of one of its columns; nothing is collected."""
    entry = catalog.entry(state, table, "table")
    columns = table_columns(entry)
    rows = df.select(*[F.col(f"`{c.name}`").cast(c.field().dataType).alias(c.name) for c in columns], F.col(f"`{order}`").alias("__order__"))
    rows = dense_rows(rows, "__order__", ROW, entry["next"]).drop("__order__")
    part = catalog.write_part(entry["name"], rows)
    new = catalog.rows(entry, [part])
    missing = [F.count(F.when(F.col(f"`{c.name}`").isNull(), 1)) for c in columns if not c.nullable]
    counts = new.agg(F.count(F.lit(1)), *missing).first()
    if any(counts[1:]):
        raise EngineError(Code.NOT_NULLABLE, "cannot insert NULL into non-nullable column")
    for column in _unique_columns(catalog, state, table):
        if duplicates(catalog.rows(entry, [*entry["parts"], part]), column):
            raise _violation()
    entry["parts"].append(part)
    entry["small"] = 0
    entry["rows"] += counts[0]
    entry["next"] += counts[0]
    return counts[0]


def duplicates(df: DataFrame, column: str) -> bool:
    c = F.col(f"`{column}`")
    return bool(df.where(c.isNotNull()).groupBy(c).count().where("count > 1").limit(1).count())


def _cells(entry: dict, table: str):
    columns = table_columns(entry)

    def resolve(name: ast.Name) -> tuple[Column, str]:
        found = next((c for c in columns if c.name.lower() == name.name.lower()), None)
        if found is None or (name.table is not None and name.table.lower() != table.lower()):
            raise EngineError(Code.COLUMN_NOT_FOUND, "column not found in schema", name.offset)
        return F.col(f"`{found.name}`"), found.type

    return resolve


def _touched(catalog: Catalog, entry: dict, hit: Column) -> dict[str, int]:
    """Matched rows of each part that has some: at most one row a file reaches the driver."""
    out: dict[str, int] = {}
    if entry["parts"]:
        for path, n in catalog.rows(entry).where(hit).groupBy("_metadata.file_path").count().collect():
            part = next(p for p in entry["parts"] if f"/{p}/" in path)
            out[part] = out.get(part, 0) + n
    return out


def update(catalog: Catalog, state: dict, statement: ast.Update, value_of: Value) -> int:
    """Rewrites the parts that hold a match; row numbers stay."""
    entry = catalog.entry(state, statement.table, "table")
    target = next((c for c in table_columns(entry) if c.name.lower() == statement.column.lower()), None)
    if target is None:
        raise EngineError(Code.COLUMN_NOT_FOUND, "column not found in schema")
    if target.type == "VECTOR":
        raise mismatch(statement.value.offset)
    literal = value_of(statement.value, target.type) if statement.value.kind == "PARAM" else statement.value
    value = stored(literal, target)
    hit = F.coalesce(predicate(statement.where, _cells(entry, statement.table), value_of), F.lit(False))
    touched = _touched(catalog, entry, hit)
    n = sum(touched.values())
    if not n:
        return 0
    if value is not None and any(c.lower() == target.name.lower() for c in _unique_columns(catalog, state, statement.table)):
        other = catalog.rows(entry).where(~hit & (F.col(f"`{target.name}`") == F.lit(value))).limit(1).count()
        if n > 1 or other:
            raise _violation()
    new = F.lit(bytearray(value) if isinstance(value, bytes) else value).cast(target.field().dataType)
    for i, part in enumerate(entry["parts"]):
        if part in touched:
            rows = catalog.rows(entry, [part])
            entry["parts"][i] = catalog.write_part(entry["name"], rows.withColumn(target.name, F.when(hit, new).otherwise(F.col(f"`{target.name}`"))))
    return n


def delete(catalog: Catalog, state: dict, statement: ast.Delete, value_of: Value) -> int:
    """Marks the rows for which the predicate is true: up to MARKS row numbers stand in the manifest, and no data file is
    written. Beyond that the parts that hold a match are written anew without their dead rows, by a narrow pass. Row numbers
    stay, with gaps."""
    entry = catalog.entry(state, statement.table, "table")
    n = entry["rows"]
    if statement.where is not None:
        hit = F.coalesce(predicate(statement.where, _cells(entry, statement.table), value_of), F.lit(False))
        touched = _touched(catalog, entry, hit)
        n = sum(touched.values())
    if n and n == entry["rows"]:
        entry["parts"], entry["next"], entry["dead"], entry["small"], entry["gaps"] = [], 0, [], 0, False
    elif n:
        if len(entry.get("dead", [])) + n <= MARKS:
            found = catalog.rows(entry, [p for p in entry["parts"] if p in touched]).where(hit).select(ROW).collect()
            entry["dead"] = sorted([*entry.get("dead", []), *(r[0] for r in found)])
        else:
            rewrite(catalog, entry, set(touched), ~hit)
        entry["gaps"] = True
    entry["rows"] -= n
    return n


def rewrite(catalog: Catalog, entry: dict, parts: set[str], keep: Column | None = None) -> None:
    """Writes parts anew without dead rows (and without those that aren't kept); marks that these parts need no longer go."""
    rest = [p for p in entry["parts"] if p not in parts]
    for i, part in enumerate(entry["parts"]):
        if part in parts:
            rows = catalog.rows(entry, [part])
            entry["parts"][i] = catalog.write_part(entry["name"], rows if keep is None else rows.where(keep))
    if entry.get("dead"):
        entry["dead"] = sorted(r[0] for r in catalog.stored_rows(entry, rest).where(F.col(ROW).isin(entry["dead"])).select(ROW).collect()) if rest else []


def vacuum(catalog: Catalog, state: dict) -> int:
    """Writes parts anew that hold dead rows, and joins the small parts of single INSERTs; the number of tables changed."""
    changed = 0
    for entry in state["objects"].values():
        if entry["kind"] != "table":
            continue
        work = False
        if entry.get("dead"):
            rewrite(catalog, entry, set(_touched(catalog, {**entry, "dead": []}, F.col(ROW).isin(entry["dead"]))))
            work = True
        if entry.get("small", 0) > 1:
            join_small(catalog, entry)
            work = True
        changed += work
    return changed


def join_small(catalog: Catalog, entry: dict) -> None:
    """One part of the newest parts that single INSERTs wrote."""
    small = entry["parts"][-entry["small"] :]
    entry["parts"] = [*entry["parts"][: -len(small)], catalog.write_part(entry["name"], catalog.stored_rows(entry, small).coalesce(1))]
    entry["small"] = 0


def create_index(catalog: Catalog, state: dict, statement: ast.CreateIndex) -> None:
    entry = catalog.entry(state, statement.table, "table")
    column = next((c for c in table_columns(entry) if c.name.lower() == statement.column.lower()), None)
    if column is None:
        raise EngineError(Code.COLUMN_NOT_FOUND, "column not found in schema")
    if column.type not in INT_RANGE:
        raise EngineError(Code.TYPE_MISMATCH, "an index requires an INT32 or INT64 column")
    if statement.unique and duplicates(catalog.rows(entry), column.name):
        raise _violation()
    catalog.add(state, statement.name, {"kind": "index", "table": statement.table.lower(), "column": column.name, "unique": statement.unique})
