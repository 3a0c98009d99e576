"""Statements as data."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..types import Column, Literal


@dataclass(frozen=True)
class Name:
    """A column, maybe with a table in front."""

    name: str
    table: str | None = None
    offset: int = -1


@dataclass(frozen=True)
class Compare:
    op: str
    column: Name
    value: Literal
    offset: int = -1


@dataclass(frozen=True)
class IsNull:
    column: Name
    negated: bool


@dataclass(frozen=True)
class Not:
    operand: object


@dataclass(frozen=True)
class Logic:
    op: str  # AND, OR
    left: object
    right: object


@dataclass(frozen=True)
class Distance:
    metric: str  # l2, cosine
    column: Name
    query: tuple[float, ...]
    offset: int = -1


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None
    offset: int = -1


@dataclass(frozen=True)
class Join:
    table: Table
    left: Name
    right: Name
    outer: bool


@dataclass(frozen=True)
class Order:
    key: Name | Distance
    descending: bool = False


@dataclass(frozen=True)
class Select:
    table: Table
    columns: tuple[Name, ...] | None  # None: all
    count: bool = False
    join: Join | None = None
    where: object = None
    order: Order | None = None
    limit: int | None = None
    offset: int = 0
    params: int = 0


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[Column, ...]


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[tuple[Literal, ...], ...]
    columns: tuple[str, ...] | None = None
    params: int = 0


@dataclass(frozen=True)
class Update:
    table: str
    column: str
    value: Literal
    where: object
    params: int = 0


@dataclass(frozen=True)
class Delete:
    table: str
    where: object = None
    params: int = 0


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str
    unique: bool


@dataclass(frozen=True)
class Create:
    kind: str  # queue, stream
    name: str


@dataclass(frozen=True)
class Drop:
    kind: str  # table, index, queue, stream
    name: str


@dataclass(frozen=True)
class Put:
    """ENQUEUE INTO and APPEND TO."""

    kind: str  # queue, stream
    name: str
    payload: bytes


@dataclass(frozen=True)
class Dequeue:
    queue: str


@dataclass(frozen=True)
class Lease:
    verb: str  # CLAIM, ACK, NACK, RENEW
    queue: str
    position: int | None = None
    token: int | None = None
    duration: int | None = None


@dataclass(frozen=True)
class CursorStatement:
    verb: str  # create, drop
    cursor: str
    stream: str


@dataclass(frozen=True)
class Read:
    stream: str
    cursor: str


@dataclass(frozen=True)
class Trim:
    stream: str
    before: int


@dataclass(frozen=True)
class Transaction:
    verb: str  # BEGIN, COMMIT, ROLLBACK
    words: tuple[str, ...] = field(default=())
