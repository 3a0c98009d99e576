"""A recursive-descent parser of the dialect; errors carry code, offset, line and column."""

from __future__ import annotations

from fractions import Fraction

from ..errors import Code, fail
from ..types import ALIASES, INT_RANGE, MAX_COLUMN_NAME, MAX_COLUMNS, MAX_DIMENSIONS, MAX_NAME, Column, Literal, float32
from . import ast
from .lexer import Token, tokens

MAX_ROWS, MAX_PROJECTIONS, MAX_DEPTH, MAX_PARAMS, MAX_DIGITS = 256, 64, 64, 64, 128
COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")
_FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
_PARAM_PLACES = "a parameter is allowed in VALUES, beside a WHERE comparison and as an assigned value only"


class Parser:
    def __init__(self, sql: str):
        self.sql = sql
        self.tokens = tokens(sql)
        self.at = 0
        self.params = 0

    # --- tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def error(self, message: str = "syntax error", code: Code = Code.SYNTAX, token: Token | None = None):
        fail(code, message, (token or self.now).offset, self.sql)

    def take(self) -> Token:
        t = self.now
        self.at += t.kind != "end"
        return t

    def word(self, *words: str) -> bool:
        """Takes the keywords if they are next."""
        ahead = self.tokens[self.at : self.at + len(words)]
        if len(ahead) == len(words) and all(t.kind == "keyword" and t.value == w for t, w in zip(ahead, words, strict=True)):
            self.at += len(words)
            return True
        return False

    def symbol(self, value: str) -> bool:
        if self.now.kind == "op" and self.now.value == value:
            self.at += 1
            return True
        return False

    def need_word(self, *words: str) -> None:
        for w in words:
            if not self.word(w):
                self.error()

    def need(self, value: str) -> None:
        if not self.symbol(value):
            self.error()

    def name(self, what: str = "name", most: int = MAX_NAME) -> str:
        t = self.now
        if t.kind != "name":
            self.error(f"expected {what}")
        if len(t.value) > most:
            self.error(f"{what} exceeds maximum of {most} bytes")
        self.at += 1
        return t.value

    def column_name(self) -> str:
        return self.name("column name", MAX_COLUMN_NAME)

    def column(self) -> ast.Name:
        at = self.now.offset
        first = self.name("column name")
        if self.symbol("."):
            return ast.Name(self.column_name(), first, at)
        return ast.Name(first, None, at)

    def whole(self, what: str) -> int:
        """A non-negative integer literal."""
        t = self.take()
        if t.kind != "int":
            self.error(f"expected {what}", token=t)
        if int(t.value) > INT_RANGE["INT64"][1]:
            self.error("integer literal overflow", token=t)
        return int(t.value)

    # --- literals
    def literal(self, params: bool = True) -> Literal:
        start = self.now
        if self.symbol("?"):
            if not params:
                self.error(_PARAM_PLACES, token=start)
            if self.params == MAX_PARAMS:
                self.error(f"parameter count exceeds maximum of {MAX_PARAMS}", token=start)
            self.params += 1
            return Literal("PARAM", self.params - 1, start.offset)
        if self.now.kind == "op" and self.now.value == "[":
            return Literal("VECTOR", self.vector(), start.offset)
        sign = -1 if self.symbol("-") else 1
        signed = sign < 0 or self.symbol("+")
        t = self.take()
        if t.kind == "int":
            value = sign * int(t.value)
            low, high = INT_RANGE["INT64"]
            if not low <= value <= high:
                self.error("integer literal overflow", token=t)
            return Literal("INT", value, start.offset)
        if t.kind == "float":
            exact = sign * Fraction(t.value)
            if len(t.value) - 1 > MAX_DIGITS:
                self.error(f"float literal exceeds {MAX_DIGITS} digits", token=t)
            try:
                return Literal("FLOAT", float32(exact, sign < 0), start.offset, exact)
            except OverflowError:
                self.error("float literal overflow", token=t)
        if not signed:
            if t.kind == "text":
                return Literal("TEXT", t.value, start.offset)
            if t.kind == "blob":
                return Literal("BLOB", t.value, start.offset)
            if t.kind == "keyword" and t.value in ("TRUE", "FALSE"):
                return Literal("BOOL", t.value == "TRUE", start.offset)
            if t.kind == "keyword" and t.value == "NULL":
                return Literal("NULL", None, start.offset)
        self.error("expected literal", token=t)

    def vector(self) -> tuple[float, ...]:
        self.need("[")
        out = []
        while True:
            v = self.literal(params=False)
            if v.kind not in ("INT", "FLOAT"):
                self.error("expected a number in a vector")
            out.append(float32(Fraction(v.value)) if v.kind == "INT" else v.value)
            if not self.symbol(","):
                break
        self.need("]")
        if len(out) > MAX_DIMENSIONS:
            self.error(f"vector exceeds {MAX_DIMENSIONS} dimensions")
        return tuple(out)

    # --- predicates: OR below AND below NOT and comparisons
    def predicate(self, depth: int = 0):
        left = self.conjunction(depth)
        while self.word("OR"):
            left = ast.Logic("OR", left, self.conjunction(depth))
        return left

    def conjunction(self, depth: int):
        left = self.factor(depth)
        while self.word("AND"):
            left = ast.Logic("AND", left, self.factor(depth))
        return left

    def factor(self, depth: int):
        if depth >= MAX_DEPTH:
            self.error(f"expression nesting exceeds maximum of {MAX_DEPTH}", Code.EXPR_DEPTH)
        if self.word("NOT"):
            return ast.Not(self.factor(depth + 1))
        if self.symbol("("):
            inner = self.predicate(depth + 1)
            self.need(")")
            return inner
        return self.comparison()

    def comparison(self):
        start = self.now
        if start.kind == "keyword" and start.value in ("L2_DISTANCE", "COSINE_DISTANCE"):
            self.error("a distance is allowed in ORDER BY only")
        if start.kind == "name":
            column = self.column()
            if self.word("IS"):
                negated = self.word("NOT")
                self.need_word("NULL")
                return ast.IsNull(column, negated)
            op = self.take()
            if op.kind != "op" or op.value not in COMPARISONS:
                self.error("unsupported expression comparison" if op.kind != "end" else "syntax error", Code.TYPE_MISMATCH if op.kind != "end" else Code.SYNTAX, op)
            if self.now.kind == "name":
                self.error("unsupported expression comparison", Code.TYPE_MISMATCH)
            return ast.Compare(op.value, column, self.literal(), start.offset)
        value = self.literal()
        op = self.take()
        if op.kind != "op" or op.value not in COMPARISONS:
            self.error(token=op)
        return ast.Compare(_FLIPPED.get(op.value, op.value), self.column(), value, start.offset)

    # --- statements
    def statement(self):
        start = self.now
        verbs = {
            "SELECT": self.select, "CREATE": self.create, "DROP": self.drop, "INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete,
            "ENQUEUE": self.enqueue, "DEQUEUE": self.dequeue, "APPEND": self.append, "READ": self.read, "TRIM": self.trim,
            "CLAIM": self.claim, "ACK": self.ticket, "NACK": self.ticket, "RENEW": self.ticket,
            "BEGIN": self.transaction, "COMMIT": self.transaction, "ROLLBACK": self.transaction,
        }
        if start.kind != "keyword" or start.value not in verbs:
            self.error("expected a statement")
        self.verb = self.take().value
        out = verbs[self.verb]()
        self.symbol(";")
        if self.now.kind != "end":
            self.error()
        return out

    def table(self) -> ast.Table:
        at = self.now.offset
        name = self.name("table name")
        if self.word("AS"):
            return ast.Table(name, self.name("alias"), at)
        return ast.Table(name, self.name("alias") if self.now.kind == "name" else None, at)

    def select(self) -> ast.Select:
        columns, count = None, False
        if self.symbol("*"):
            pass
        elif self.word("COUNT"):
            self.need("(")
            self.need("*")
            self.need(")")
            count = True
        else:
            found = [self.column()]
            while self.symbol(","):
                found.append(self.column())
            if len(found) > MAX_PROJECTIONS:
                self.error(f"projection count exceeds maximum of {MAX_PROJECTIONS}")
            columns = tuple(found)
        self.need_word("FROM")
        table = self.table()
        join = None
        if self.word("JOIN") or self.word("INNER", "JOIN"):
            join = self.join(False)
        elif self.word("LEFT", "JOIN"):
            join = self.join(True)
        where = self.predicate() if self.word("WHERE") else None
        order = None
        if self.word("ORDER"):
            self.need_word("BY")
            key = self.order_key()
            order = ast.Order(key, self.word("DESC") or (self.word("ASC") and False))
        limit, offset = None, 0
        if self.word("LIMIT"):
            limit = self.whole("LIMIT count")
            if self.word("OFFSET"):
                offset = self.whole("OFFSET count")
        return ast.Select(table, columns, count, join, where, order, limit, offset, self.params)

    def join(self, outer: bool) -> ast.Join:
        table = self.table()
        self.need_word("ON")
        wrong = "JOIN ON currently requires column = column"
        if self.now.kind != "name":
            self.error(wrong)
        left = self.column()
        op = self.take()
        if op.value != "=" or self.now.kind != "name":
            self.error(wrong, token=op)
        return ast.Join(table, left, self.column(), outer)

    def order_key(self):
        at = self.now.offset
        for word, metric in (("L2_DISTANCE", "l2"), ("COSINE_DISTANCE", "cosine")):
            if self.word(word):
                self.need("(")
                column = self.column()
                self.need(",")
                query = self.vector()
                self.need(")")
                return ast.Distance(metric, column, query, at)
        column = self.column()
        for op, metric in (("<->", "l2"), ("<=>", "cosine")):
            if self.symbol(op):
                return ast.Distance(metric, column, self.vector(), at)
        return column

    def create(self):
        if self.word("TABLE"):
            return self.create_table()
        if self.word("UNIQUE", "INDEX"):
            return self.create_index(True)
        if self.word("INDEX"):
            return self.create_index(False)
        if self.word("QUEUE"):
            return ast.Create("queue", self.name("queue name"))
        if self.word("STREAM"):
            return ast.Create("stream", self.name("stream name"))
        if self.word("CURSOR"):
            return self.cursor("create")
        self.error()

    def create_table(self) -> ast.CreateTable:
        name = self.name("table name")
        self.need("(")
        columns: list[Column] = []
        while True:
            at = self.now
            column = self.column_name()
            if any(c.name.lower() == column.lower() for c in columns):
                self.error("duplicate column name", Code.DUPLICATE_COLUMN, at)
            kind = self.take()
            known = ALIASES.get(str(kind.raw).upper()) if kind.kind in ("name", "keyword") else None
            if known is None:
                self.error("expected a column type", token=kind)
            dimensions = 0
            if known == "VECTOR":
                self.need("(")
                if self.name("FLOAT32").upper() != "FLOAT32":
                    self.error("expected FLOAT32")
                self.need(",")
                dimensions = self.whole("dimensions")
                if not 1 <= dimensions <= MAX_DIMENSIONS:
                    self.error(f"a vector has 1 to {MAX_DIMENSIONS} dimensions")
                self.need(")")
            nullable = True
            if self.word("NOT"):
                self.need_word("NULL")
                nullable = False
            else:
                self.word("NULL")
            columns.append(Column(column, known, nullable, dimensions))
            if not self.symbol(","):
                break
        self.need(")")
        if len(columns) > MAX_COLUMNS:
            self.error(f"column count exceeds maximum of {MAX_COLUMNS}")
        return ast.CreateTable(name, tuple(columns))

    def create_index(self, unique: bool) -> ast.CreateIndex:
        name = self.name("index name")
        self.need_word("ON")
        table = self.name("table name")
        self.need("(")
        column = self.column_name()
        self.need(")")
        return ast.CreateIndex(name, table, column, unique)

    def cursor(self, verb: str) -> ast.CursorStatement:
        cursor = self.name("cursor name", MAX_COLUMN_NAME)
        self.need_word("ON")
        return ast.CursorStatement(verb, cursor, self.name("stream name"))

    def drop(self):
        for word in ("TABLE", "INDEX", "QUEUE", "STREAM"):
            if self.word(word):
                return ast.Drop(word.lower(), self.name(f"{word.lower()} name"))
        if self.word("CURSOR"):
            return self.cursor("drop")
        self.error()

    def insert(self) -> ast.Insert:
        self.need_word("INTO")
        table = self.name("table name")
        columns = None
        if self.symbol("("):
            found = [self.column_name()]
            while self.symbol(","):
                found.append(self.column_name())
            self.need(")")
            columns = tuple(found)
        self.need_word("VALUES")
        rows = []
        while True:
            self.need("(")
            row = [self.literal()]
            while self.symbol(","):
                row.append(self.literal())
            self.need(")")
            rows.append(tuple(row))
            if not self.symbol(","):
                break
        if len(rows) > MAX_ROWS:
            self.error(f"row count exceeds maximum of {MAX_ROWS}")
        return ast.Insert(table, tuple(rows), columns, self.params)

    def update(self) -> ast.Update:
        table = self.name("table name")
        self.need_word("SET")
        column = self.column_name()
        self.need("=")
        value = self.literal()
        self.need_word("WHERE")
        return ast.Update(table, column, value, self.predicate(), self.params)

    def delete(self) -> ast.Delete:
        self.need_word("FROM")
        table = self.name("table name")
        return ast.Delete(table, self.predicate() if self.word("WHERE") else None, self.params)

    def put(self, kind: str) -> ast.Put:
        name = self.name(f"{kind} name")
        self.need_word("VALUES")
        self.need("(")
        value = self.literal(params=False)
        if value.kind not in ("TEXT", "BLOB"):
            fail(Code.TYPE_MISMATCH, "type mismatch", value.offset, self.sql)
        self.need(")")
        return ast.Put(kind, name, value.value.encode() if value.kind == "TEXT" else value.value)

    def enqueue(self) -> ast.Put:
        self.need_word("INTO")
        return self.put("queue")

    def append(self) -> ast.Put:
        self.need_word("TO")
        return self.put("stream")

    def dequeue(self) -> ast.Dequeue:
        self.need_word("FROM")
        return ast.Dequeue(self.name("queue name"))

    def read(self) -> ast.Read:
        self.need_word("FROM")
        stream = self.name("stream name")
        self.need_word("AS")
        return ast.Read(stream, self.name("cursor name", MAX_COLUMN_NAME))

    def trim(self) -> ast.Trim:
        self.need_word("STREAM")
        stream = self.name("stream name")
        self.need_word("BEFORE")
        return ast.Trim(stream, self.whole("position"))

    def claim(self) -> ast.Lease:
        self.need_word("FROM")
        queue = self.name("queue name")
        self.need_word("FOR")
        return ast.Lease("CLAIM", queue, duration=self.whole("milliseconds"))

    def ticket(self) -> ast.Lease:
        verb = self.verb
        self.need_word("FROM")
        queue = self.name("queue name")
        self.need_word("AT")
        position = self.whole("position")
        self.need_word("TOKEN")
        token = self.whole("token")
        duration = None
        if verb == "RENEW":
            self.need_word("FOR")
            duration = self.whole("milliseconds")
        return ast.Lease(verb, queue, position, token, duration)

    def transaction(self) -> ast.Transaction:
        verb = self.verb
        self.word("TRANSACTION") or self.word("WORK")
        return ast.Transaction(verb)


def parse(sql: str):
    return Parser(sql).statement()
