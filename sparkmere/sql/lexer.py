"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import Code, fail

#: The reserved words.
KEYWORDS = frozenset(
    """SELECT FROM WHERE AND OR NOT IS NULL TRUE FALSE AS JOIN INNER LEFT ON ORDER BY ASC DESC LIMIT OFFSET COUNT
    CREATE TABLE DROP INSERT INTO VALUES UPDATE SET DELETE UNIQUE INDEX QUEUE STREAM CURSOR ENQUEUE DEQUEUE CLAIM ACK NACK
    RENEW FOR AT TOKEN APPEND TO READ TRIM BEFORE BEGIN COMMIT ROLLBACK TRANSACTION WORK L2_DISTANCE COSINE_DISTANCE""".split()
)
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|--[^\n]*)
    |(?P<blob>[xX]'[^']*'?)
    |(?P<number>[0-9]+(?:\.[0-9]+)?)
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<text>'(?:[^']|'')*'?)
    |(?P<op><=>|<->|<>|!=|<=|>=|[=<>(),;.*?+\-\[\]])""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Token:
    kind: str  # name, keyword, int, float, text, blob, op, end
    value: object
    offset: int
    raw: str = ""


def tokens(sql: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            fail(Code.SYNTAX, "unexpected character", at, sql)
        kind, raw = m.lastgroup, m.group()
        if kind == "name":
            out.append(Token("keyword", raw.upper(), at, raw) if raw.upper() in KEYWORDS else Token("name", raw, at, raw))
        elif kind == "number":
            out.append(Token("float" if "." in raw else "int", raw, at, raw))
        elif kind == "text":
            if len(raw) < 2 or not re.fullmatch(r"'(?:[^']|'')*'", raw):
                fail(Code.SYNTAX, "unterminated string literal", at, sql)
            out.append(Token("text", raw[1:-1].replace("''", "'"), at, raw))
        elif kind == "blob":
            if not re.fullmatch(r"[xX]'(?:[0-9a-fA-F]{2})*'", raw):
                fail(Code.SYNTAX, "BLOB literal must contain only an even number of hex digits", at, sql)
            out.append(Token("blob", bytes.fromhex(raw[2:-1]), at, raw))
        elif kind == "op":
            out.append(Token("op", "!=" if raw == "<>" else raw, at, raw))
        at = m.end()
    out.append(Token("end", "", len(sql)))
    return out
