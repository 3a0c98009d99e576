"""A shell over a database: statements and dot commands from a terminal or a script, results as text.

    python -m sparkmere.shell PATH [--create] [--leases] [--read-only]

The exit status is 1 if any statement failed; an open transaction at the end of input is rolled back.
"""

from __future__ import annotations

import argparse
import math
import sys
from collections.abc import Iterable
from typing import TextIO

from .database import READS, Database, Ticket
from .errors import EngineError
from .sources.catalog import table_columns

HELP = ".tables .schema .indexes .queues .streams .info .check .help .quit .exit"


def cell(value: object) -> str:
    """Floats have two decimals, cut off and not rounded."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        if not math.isfinite(value):
            return str(value)
        whole = int(abs(value) * 100)
        return f"{'-' if value < 0 and whole else ''}{whole // 100}.{whole % 100:02d}"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(cell, value)) + "]"
    return str(value)


def table_text(names: list[str], rows: Iterable[tuple]) -> str:
    head = " | ".join(names)
    lines = [" | ".join(map(cell, r)) for r in rows]
    return "\n".join([head, "-" * len(head), *lines, f"({len(lines)} rows)"])


class Shell:
    def __init__(self, db: Database, out: TextIO = sys.stdout):
        self.db, self.out, self.failed = db, out, False

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def command(self, line: str) -> bool:
        """A dot command; False ends the shell."""
        word = line.split()[0]
        if word in (".quit", ".exit"):
            return False
        if word == ".help":
            self.say(HELP)
        elif word in (".tables", ".indexes", ".queues", ".streams"):
            for name in self.db.objects({".tables": "table", ".indexes": "index", ".queues": "queue", ".streams": "stream"}[word]):
                self.say(name)
        elif word == ".schema":
            for o in self.db.state["objects"].values():
                if o["kind"] == "table":
                    columns = ", ".join(f"{c.name} {c.type}{f'(FLOAT32, {c.dimensions})' if c.dimensions else ''}{'' if c.nullable else ' NOT NULL'}" for c in table_columns(o))
                    self.say(f"CREATE TABLE {o['name']} ({columns})")
        elif word == ".info":
            for k, v in self.db.info().items():
                self.say(f"{k}: {v}")
        elif word == ".check":
            faults = self.db.check()
            self.say("OK" if not faults else "\n".join(faults))
        else:
            self.say(f"unknown command {word}")
            self.failed = True
        return True

    def statement(self, sql: str) -> None:
        try:
            s = self.db.prepare(sql)
            if isinstance(s.statement, READS):
                self.say(table_text(s.column_names, s.query()))
                return
            answer = s.execute()
            if isinstance(answer, Ticket):
                self.say(f"{answer.payload.decode(errors='replace')} (position {answer.position}, token {answer.token})")
            elif isinstance(answer, bytes):
                self.say(answer.decode(errors="replace"))
            else:
                self.say("(empty)" if answer is None and sql.split()[0].upper() in ("DEQUEUE", "READ", "CLAIM") else "OK" if answer is None else str(answer))
        except EngineError as e:
            self.failed = True
            where = f" at line {e.line}, column {e.col}" if e.line else ""
            self.say(f"error: {e.message}{where}")

    def run(self, lines: Iterable[str]) -> int:
        buffer = ""
        for line in lines:
            if not buffer and line.strip().startswith("."):
                if not self.command(line.strip()):
                    break
                continue
            buffer += line
            while (end := statement_end(buffer)) is not None:
                sql, buffer = buffer[:end].strip(), buffer[end + 1 :].lstrip()
                if sql:
                    self.statement(sql)
        if buffer.strip():
            self.statement(buffer.strip())
        if self.db.in_transaction:
            self.db.rollback()
        return int(self.failed)


def statement_end(text: str) -> int | None:
    """The place of the first semicolon outside quotes."""
    quoted = False
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif c == ";" and not quoted:
            return i
    return None


def main() -> int:
    args = argparse.ArgumentParser(description="Runs statements of standard input on a database.")
    args.add_argument("path")
    for flag in ("create", "leases", "read-only"):
        args.add_argument(f"--{flag}", action="store_true")
    a = args.parse_args()
    with Database.create(a.path, leases=a.leases) if a.create else Database.open(a.path, read_only=a.read_only) as db:
        return Shell(db).run(sys.stdin)


if __name__ == "__main__":
    sys.exit(main())
