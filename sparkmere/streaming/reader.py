"""Streams of a database as Structured Streaming sources, and consumers that commit with their cursor."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..database import Database
from ..errors import Code, EngineError
from ..sources.catalog import Catalog
from .log import SCHEMA


def flush(db: Database, stream: str) -> str:
    """Gives readers the records that they haven't got yet, as a folder of the stream's log, and gives the log's path.

    The range of positions is published first, so it never changes; then its folder is written aside and renamed. After a
    crash in between, the next flush writes the folder that is missing before it goes on. A record that a transaction may
    still roll back can't be flushed, so within one this is an error.
    """
    if db.in_transaction:
        raise EngineError(Code.EXEC, "cannot flush inside active transaction")
    store, name = db.catalog.store, stream.lower()

    def publish(s: dict) -> tuple[object, bool]:
        entry = Catalog.entry(s, stream, "stream")
        first, end = max(entry["followed"], entry["first"]), entry["end"]
        if first >= end:
            return None, False
        entry["followed"], entry["flushed"] = end, [first, end]
        return None, True

    def write() -> None:
        entry = Catalog.entry(db.state, stream, "stream")
        first, end = entry.get("flushed") or (0, 0)
        folder = f"{first:020d}-{end:020d}"
        if first < end and not store.exists("_log", name, folder):
            aside = ("_log", f"_{name}-{uuid.uuid4().hex}")
            db.payloads.dataframe(entry, first, end).write.parquet(store.path(*aside))
            store.make("_log", name)
            store.rename_new(aside, ("_log", name, folder))

    write()
    db._change(publish)
    write()
    return store.path("_log", name)


def follow(db: Database, stream: str, max_files: int = 64) -> DataFrame:
    """A streaming DataFrame (position, payload) of the stream's flushed records; flush() feeds it."""
    path = flush(db, stream)
    return db.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(f"{path}/*")


def consume(db: Database, stream: str, cursor: str, work: Callable[[DataFrame, Database], None]) -> int:
    """Gives work all records that a cursor hasn't read, as one DataFrame; the cursor and whatever work changes in the
    database commit together, so a failure leaves both as they were. Number of records."""
    with db.transaction():
        entry = Catalog.entry(db.state, stream, "stream")
        at, end = entry["cursors"].get(cursor.lower()), entry["end"]
        if at is None:
            raise EngineError(Code.TABLE_NOT_FOUND, "cursor not found on stream")
        if at < end:
            work(db.payloads.dataframe(entry, at, end), db)
            Catalog.entry(db.state, stream, "stream")["cursors"][cursor.lower()] = end
    return end - at
