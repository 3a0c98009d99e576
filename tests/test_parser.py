import random
import struct
from fractions import Fraction

import pytest

from sparkmere.errors import Code, EngineError
from sparkmere.sql import ast
from sparkmere.sql.parser import parse
from sparkmere.types import float32


def many(n, form="c{}"):
    return ",".join(form.format(i) for i in range(n))


#: Statements that break one rule of the grammar each, by the message they get.
BROKEN = {
    "expected column name": ["CREATE TABLE t (select INT64)", "SELECT x FROM t ORDER BY DESC", "SELECT x, count(*) FROM t", "CREATE TABLE t (1 INT32)"],
    "duplicate column name": ["CREATE TABLE t (one INT32, two TEXT, ONE BOOL)"],
    "BLOB literal must contain only an even number of hex digits": ["INSERT INTO t VALUES (x'1')", "INSERT INTO t VALUES (1, X'12zz')"],
    "syntax error": [
        "UPDATE t SET x = NULL", "UPDATE t SET x = 1, y = 2 WHERE z = 3", "SELECT x FROM t OFFSET 2", "SELECT x FROM t ORDER y", "SELECT x FROM t ORDER BY y, z DESC",
        "SELECT COUNT() FROM t", "SELECT COUNT(x) FROM t", "SELECT COUNT(*), x FROM t", "SELECT x FROM t a JOIN u b", "SELECT x FROM t WHERE NOT y", "SELECT x FROM t WHERE (y = 1",
    ],
    "expected LIMIT count": ["SELECT x FROM t LIMIT 2.0", "SELECT x FROM t LIMIT -3", "SELECT x FROM t LIMIT ?", "SELECT x FROM t LIMIT 'a'"],
    "integer literal overflow": [f"SELECT x FROM t WHERE x < {10**30}"],
    "JOIN ON currently requires column = column": ["SELECT a.x FROM t a JOIN u b ON a.x <= b.x", "SELECT a.x FROM t a LEFT JOIN u b ON a.x = 5"],
    "unsupported expression comparison": ["SELECT x FROM t WHERE x != y"],
    "a distance is allowed in ORDER BY only": ["SELECT x FROM t WHERE COSINE_DISTANCE(y, [2, 3]) > 0.5"],
    "projection count exceeds maximum of 64": [f"SELECT {many(66)} FROM t"],
    "column count exceeds maximum of 64": [f"CREATE TABLE t ({many(70, 'c{} TEXT')})"],
    "row count exceeds maximum of 256": [f"INSERT INTO t VALUES {many(300, '({})')}"],
    "expression nesting exceeds maximum of 64": ["SELECT x FROM t WHERE " + "NOT (" * 70 + "x = 1" + ")" * 70],
    "table name exceeds maximum of 31 bytes": [f"CREATE TABLE {'n' * 33} (x TEXT)"],
    "column name exceeds maximum of 23 bytes": [f"CREATE TABLE t ({'n' * 25} TEXT)"],
    "expected literal": ["SELECT x FROM t WHERE x >= .25"],
}
CODES = {"duplicate column name": Code.DUPLICATE_COLUMN, "unsupported expression comparison": Code.TYPE_MISMATCH, "expression nesting exceeds maximum of 64": Code.EXPR_DEPTH}


@pytest.mark.parametrize(("message", "sql"), [(message, sql) for message, some in BROKEN.items() for sql in some])
def test_errors(message, sql):
    with pytest.raises(EngineError) as e:
        parse(sql)
    assert (e.value.code, e.value.message) == (CODES.get(message, Code.SYNTAX), message)


def test_error_place():
    with pytest.raises(EngineError) as e:
        parse("SELECT a\nFROM t WHERE a = = 1")
    assert (e.value.line, e.value.col, e.value.offset) == (2, 18, 26)


def test_statements():
    s = parse("select A.x, b.y from t as A left join u b on b.k = A.k limit 3 offset 1;")
    assert s.join.outer and s.limit == 3 and s.offset == 1 and s.columns[0] == ast.Name("x", "A", 7)
    assert parse("SELECT a FROM t WHERE 5 < a").where.op == ">"
    where = parse("SELECT a FROM t WHERE a = 1 OR NOT b = 2 AND c IS NOT NULL").where
    assert where.op == "OR" and where.right.op == "AND" and isinstance(where.right.left, ast.Not)
    assert parse("RENEW FROM q AT 4 TOKEN 2 FOR 100") == ast.Lease("RENEW", "q", 4, 2, 100)
    assert parse("READ FROM s AS r") == ast.Read("s", "r")
    assert parse("BEGIN TRANSACTION").verb == "BEGIN" and parse("COMMIT WORK").verb == "COMMIT"
    assert parse("SELECT a FROM t ORDER BY v <=> [1, -2.5] DESC LIMIT 2").order.key == ast.Distance("cosine", ast.Name("v", None, 25), (1.0, -2.5), 25)
    assert parse("INSERT INTO t VALUES ('it''s', x'00fF')").rows[0][1].value == b"\x00\xff"
    assert parse("SELECT a FROM t WHERE a = ? AND b < ?").params == 2


def nearest(x: Fraction) -> float:
    """By search among neighbouring binary32 values of the double rounding: an independent oracle."""
    guess = struct.unpack("<I", struct.pack("<f", float(abs(x))))[0]
    best = None
    for bits in range(max(0, guess - 2), guess + 3):
        v = struct.unpack("<f", struct.pack("<I", bits))[0]
        if v == float("inf"):
            continue
        key = (abs(Fraction(v) - abs(x)), bits & 1)
        if best is None or key < best[0]:
            best = (key, v)
    return best[1] if x >= 0 else -best[1]


def test_float32_rounds_once():
    rng = random.Random(7)
    for _ in range(3000):
        text = f"{rng.randint(0, 10 ** rng.randint(1, 12))}.{rng.randint(0, 10 ** rng.randint(1, 40))}"
        assert float32(Fraction(text)) == nearest(Fraction(text)), text
    half = Fraction(1) + Fraction(1, 1 << 24)
    assert float32(half) == 1.0 and float32(half + Fraction(1, 1 << 60)) == 1.0 + 2**-23
    assert float32(Fraction(1, 1 << 149)) == 2.0**-149 and float32(Fraction(1, 1 << 151)) == 0.0
    assert struct.pack("<f", float32(Fraction(0), True)) == struct.pack("<f", -0.0)
    with pytest.raises(OverflowError):
        float32(Fraction(10) ** 39)
