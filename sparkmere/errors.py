"""Errors of the engine: a numeric code within a domain, and where in the statement it was found."""

from __future__ import annotations

from enum import IntEnum


class Code(IntEnum):
    """Codes of the SQL domain."""

    OK = 0
    SYNTAX = 1
    UNEXPECTED = 2
    TABLE_NOT_FOUND = 3
    COLUMN_NOT_FOUND = 4
    DUPLICATE_TABLE = 5
    DUPLICATE_COLUMN = 6
    TYPE_MISMATCH = 7
    NOT_NULLABLE = 8
    VALUE_COUNT = 9
    NO_STORAGE = 10
    EXEC = 11
    EXPR_DEPTH = 12
    SINK = 13


class Domain(IntEnum):
    NONE = 0
    SQL = 1
    STORAGE = 2
    OS = 3


class EngineError(Exception):
    """code and domain say what failed; offset, line and col where (-1 and 0: unknown)."""

    def __init__(self, code: int, message: str, offset: int = -1, line: int = 0, col: int = 0, domain: Domain = Domain.SQL):
        super().__init__(message)
        self.code, self.message, self.offset, self.line, self.col, self.domain = code, message, offset, line, col, domain


class BusyError(EngineError):
    """Another writer holds the database."""

    def __init__(self, message: str = "database is busy: another writer holds it"):
        super().__init__(Code.NO_STORAGE, message, domain=Domain.STORAGE)


class MisuseError(EngineError):
    """A parameter was bound with a type its place does not take, or a handle was used after its end."""

    def __init__(self, message: str):
        super().__init__(Code.EXEC, message, domain=Domain.NONE)


def fail(code: Code, message: str, offset: int = -1, text: str | None = None):
    """Raises, with line and column worked out from the statement."""
    line = col = 0
    if text is not None and offset >= 0:
        line = text.count("\n", 0, offset) + 1
        col = offset - (text.rfind("\n", 0, offset) + 1) + 1
    raise EngineError(code, message, offset, line, col)
