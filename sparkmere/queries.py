"""The engine's own queries over the driver's tables, and the SQL that each must agree with.

Queries are statements of the dialect, run through the parser and planner over outside tables; changes, queues, leases
and streams run on a database in the session's shared folder that is made for the query.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database
from .errors import Code, EngineError
from .functions import vector as V
from .operators.ordering import shared_folder
from .operators.vector_search import topk
from .sources.store import Store

#: Columns that give each outside table a total order.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], "events": ["event_id"], "documents": ["doc_id"],
    "labels": ["doc_id"], "embeddings": ["vec_id"],
}


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors reach; it goes when Python ends."""
    path = f"{shared_folder(spark).rstrip('/')}/sparkmere-{uuid.uuid4().hex}"

    def forget() -> None:
        try:
            Store(spark, path).delete()
        except Exception:  # the session has ended
            pass

    atexit.register(forget)
    return path


class Tables:
    """The driver's tables under the dialect, read-only, without a database of their own."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        """A SELECT of the dialect as a lazy DataFrame. more: other tables, ordered by all their columns."""
        from .plans.select import ROW, Source, plan_select
        from .sql.parser import parse
        from .types import columns_of

        def source(table) -> Source:
            name = table.name.lower()
            df = more[name] if name in more else self.read(name)
            keys = df.columns[:1] if name in more else KEYS[name]
            rows = [f"{ROW}{i}" for i in range(len(keys))]
            return Source(df.select("*", *[F.col(k).alias(r) for k, r in zip(keys, rows, strict=True)]), columns_of(df.schema), tuple(rows))

        return plan_select(parse(text), source, lambda v, _: v).df


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, dialect: str, oracle: str | None = None, rename: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Tables(spark, sf_dir).sql(dialect)
        return df.withColumnRenamed("count(*)", rename) if rename else df

    Q[name], SQL[name] = run, oracle or dialect


_add("scan_project", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem")
_add("scan_star", "SELECT * FROM nation")
_add("alias_qualified", "SELECT u.c_custkey, u.c_acctbal FROM customer AS u WHERE u.c_acctbal > 0.0")
for _key, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    _add(f"filter_i32_{_key}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 25")
_add("filter_i64_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 9000")
_add("filter_float_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45.0 AND l_discount <= 0.05")
_add("filter_literal_left", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE 45.0 < l_quantity")
_add("filter_and", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_retailprice < 1000.0")
_add("filter_or", "SELECT p_partkey FROM part WHERE p_size = 10 OR p_retailprice > 1500.0")
_add("filter_not", "SELECT p_partkey FROM part WHERE NOT p_size > 10")
_add("filter_nested", "SELECT p_partkey FROM part WHERE NOT (p_size > 10 AND (p_retailprice < 1000.0 OR p_size = 30)) OR p_partkey <= 5")
_add("filter_null_literal", "SELECT COUNT(*) FROM part WHERE p_size = NULL", 'SELECT count(*) AS n FROM part WHERE p_size = NULL', rename="n")
_add("count_all", "SELECT COUNT(*) FROM lineitem", "SELECT count(*) AS n FROM lineitem", rename="n")
_add("count_where", "SELECT COUNT(*) FROM lineitem WHERE l_quantity > 30.0", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 30.0", rename="n")
_add("count_limit_one", "SELECT COUNT(*) FROM orders LIMIT 1", "SELECT count(*) AS n FROM orders LIMIT 1", rename="n")
_add("count_limit_zero", "SELECT COUNT(*) FROM orders LIMIT 0", "SELECT count(*) AS n FROM orders LIMIT 0", rename="n")
_add("join_inner_i64", "SELECT o.o_orderkey, c.c_custkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
_add("join_reversed_keys", "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON c.c_custkey = o.o_custkey")
_add("join_left_i64", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
_add("join_inner_i32", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
_add("order_asc_limit_offset", "SELECT p_size, p_partkey FROM part ORDER BY p_size LIMIT 20 OFFSET 5", "SELECT p_size, p_partkey FROM part ORDER BY p_size ASC NULLS LAST, p_partkey LIMIT 20 OFFSET 5")
_add("order_desc_limit_offset", "SELECT p_size, p_partkey FROM part ORDER BY p_size DESC LIMIT 20 OFFSET 5", "SELECT p_size, p_partkey FROM part ORDER BY p_size DESC NULLS FIRST, p_partkey LIMIT 20 OFFSET 5")
_add("limit_physical_order", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000.0 LIMIT 15 OFFSET 3", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000.0 ORDER BY o_orderkey LIMIT 15 OFFSET 3")


def _query(name: str, oracle: str | None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        Q[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return put


@_query("filter_bool_eq", "SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def filter_bool_eq(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.sql("SELECT c_custkey FROM c WHERE owes = FALSE", c=t.read("customer").select("c_custkey", (F.col("c_acctbal") <= 0).alias("owes")))


@_query("filter_bool_ne", "SELECT c_custkey FROM customer WHERE c_acctbal <= 0")
def filter_bool_ne(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.sql("SELECT c_custkey FROM c WHERE owes != FALSE", c=t.read("customer").select("c_custkey", (F.col("c_acctbal") <= 0).alias("owes")))


_LABELED = "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _labeled(t: Tables) -> DataFrame:
    return t.sql(_LABELED)


@_query("filter_is_null", f"SELECT doc_id FROM ({_LABELED}) WHERE quality IS NULL")
def filter_is_null(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.sql("SELECT doc_id FROM d WHERE quality IS NULL", d=_labeled(t))


@_query("filter_is_not_null", f"SELECT doc_id, quality FROM ({_LABELED}) WHERE quality IS NOT NULL")
def filter_is_not_null(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.sql("SELECT doc_id, quality FROM d WHERE quality IS NOT NULL", d=_labeled(t))


@_query("filter_three_valued", f"SELECT doc_id FROM ({_LABELED}) WHERE NOT (quality = 1 OR toxic = 1)")
def filter_three_valued(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.sql("SELECT doc_id FROM d WHERE NOT (quality = 1 OR toxic = 1)", d=_labeled(t))


_NAN = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS x FROM lineitem"


@_query("filter_nan", f"SELECT count(*) AS n FROM ({_NAN}) WHERE (NOT isnan(x) AND x > 30) OR NOT (NOT isnan(x) AND x <> 7)")
def filter_nan(spark, sf_dir):
    t = Tables(spark, sf_dir)
    x = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).when(F.col("l_linenumber") == 5, F.lit(None)).otherwise(F.col("l_quantity")).alias("x")
    return t.sql("SELECT COUNT(*) FROM d WHERE x > 30.0 OR NOT x != 7.0", d=t.read("lineitem").select("l_orderkey", "l_linenumber", x)).withColumnRenamed("count(*)", "n")


@_query("order_nulls_first_desc", f"SELECT doc_id, quality FROM ({_LABELED}) ORDER BY quality DESC NULLS FIRST, doc_id LIMIT 500")
def order_nulls_first_desc(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.sql("SELECT doc_id, quality FROM d ORDER BY quality DESC LIMIT 500", d=_labeled(t))


@_query("order_nulls_last_asc", f"SELECT doc_id, quality FROM ({_LABELED}) ORDER BY quality ASC NULLS LAST, doc_id LIMIT 300")
def order_nulls_last_asc(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.sql("SELECT doc_id, quality FROM d ORDER BY quality LIMIT 300", d=_labeled(t))


@_query(
    "join_left_limit",
    """SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey)
ORDER BY c_custkey // 64, CAST(o_orderkey IS NULL AS INTEGER), o_orderkey // 64 NULLS LAST, c_custkey, o_orderkey NULLS LAST LIMIT 100 OFFSET 10""",
)
def join_left_limit(spark, sf_dir):
    return Tables(spark, sf_dir).sql("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey LIMIT 100 OFFSET 10")


# --- vectors: every query is a fixed vector of 64 dimensions
QUERY = [((i * 37) % 64 - 31.5) / 128 for i in range(64)]
_VECTOR = "[" + ", ".join(repr(x) for x in QUERY) + "]"
_SQL_VECTOR = "[" + ", ".join(f"CAST({x!r} AS FLOAT)" for x in QUERY) + "]"
_L2, _COS = f"list_distance(embedding, {_SQL_VECTOR})", f"list_cosine_distance(embedding, {_SQL_VECTOR})"
_add("vector_l2_topk", f"SELECT vec_id, label FROM embeddings ORDER BY embedding <-> {_VECTOR} LIMIT 10", f"SELECT vec_id, label FROM embeddings ORDER BY {_L2}, vec_id LIMIT 10")
_add("vector_l2_topk_desc", f"SELECT vec_id FROM embeddings ORDER BY embedding <-> {_VECTOR} DESC LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY {_L2} DESC, vec_id LIMIT 10")
_add("vector_l2_topk_offset", f"SELECT vec_id FROM embeddings ORDER BY L2_DISTANCE(embedding, {_VECTOR}) LIMIT 10 OFFSET 7", f"SELECT vec_id FROM embeddings ORDER BY {_L2}, vec_id LIMIT 10 OFFSET 7")
_add("vector_l2_topk_where", f"SELECT vec_id FROM embeddings WHERE label = 1 ORDER BY embedding <-> {_VECTOR} LIMIT 10", f"SELECT vec_id FROM embeddings WHERE label = 1 ORDER BY {_L2}, vec_id LIMIT 10")
_add("vector_cosine_topk", f"SELECT vec_id FROM embeddings ORDER BY embedding <=> {_VECTOR} LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY {_COS}, vec_id LIMIT 10")
_add("vector_cosine_topk_desc", f"SELECT vec_id FROM embeddings ORDER BY COSINE_DISTANCE(embedding, {_VECTOR}) DESC LIMIT 10", f"SELECT vec_id FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")


@_query("vector_candidates", f"SELECT vec_id, label FROM embeddings WHERE label IN (2, 3) ORDER BY {_L2}, vec_id LIMIT 12")
def vector_candidates(spark, sf_dir):
    e = Tables(spark, sf_dir).read("embeddings")
    return topk(e, "embedding", QUERY, 12, row="vec_id", only=e.where(F.col("label").isin(2, 3))).select("vec_id", "label")


@_query("vector_dot", f"SELECT vec_id, round(list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {QUERY}), 5) AS dot FROM embeddings")
def vector_dot(spark, sf_dir):
    return Tables(spark, sf_dir).read("embeddings").select("vec_id", F.round(V.dot(F.col("embedding"), V.vector_literal(QUERY)), 5).alias("dot"))


@_query("vector_normalize", "SELECT vec_id, round(list_inner_product(e, e), 4) AS length, round(e[1] / (embedding[1] / sqrt(list_inner_product(embedding, embedding))), 3) AS ratio FROM (SELECT *, list_transform(embedding, lambda x: CAST(x / sqrt(list_inner_product(embedding, embedding)) AS FLOAT)) AS e FROM embeddings)")
def vector_normalize(spark, sf_dir):
    e = Tables(spark, sf_dir).read("embeddings").withColumn("e", V.normalize(F.col("embedding")))
    ratio = F.col("e")[0] / (F.col("embedding")[0] / F.sqrt(V.norm_squared(F.col("embedding"))))
    return e.select("vec_id", F.round(V.norm_squared(F.col("e")), 4).cast("float").alias("length"), F.round(ratio, 3).alias("ratio"))


# --- changes, on a database of their own
def _part_database(spark: SparkSession, sf_dir: str) -> Database:
    db = Database.create(_folder(spark), spark)
    db.execute("CREATE TABLE part (p_partkey INT64 NOT NULL, p_size INT32, big BOOL)")
    part = Tables(spark, sf_dir).read("part").select("p_partkey", F.when(F.col("p_size") != 13, F.col("p_size")).alias("p_size"), (F.col("p_size") > 30).alias("big"))
    db.load("part", part, "p_partkey")
    return db


_PART = "SELECT p_partkey, CASE WHEN p_size <> 13 THEN p_size END AS p_size, p_size > 30 AS big FROM part"


@_query("insert_then_select", f"SELECT p_partkey, p_size FROM ({_PART}) UNION ALL VALUES (-1::BIGINT, 5::INTEGER), (-2, NULL)")
def insert_then_select(spark, sf_dir):
    with _part_database(spark, sf_dir) as db:
        db.execute("INSERT INTO part VALUES (-1, 5, FALSE), (?, NULL, NULL)", [-2])
        return db.sql("SELECT p_partkey, p_size FROM part")


@_query("update_where", f"SELECT p_partkey, CASE WHEN p_size > 40 OR big = FALSE THEN 99 ELSE p_size END AS p_size FROM ({_PART})")
def update_where(spark, sf_dir):
    with _part_database(spark, sf_dir) as db:
        db.execute("UPDATE part SET p_size = 99 WHERE p_size > 40 OR big = FALSE")
        return db.sql("SELECT p_partkey, p_size FROM part")


@_query("delete_where", f"SELECT p_partkey, p_size FROM ({_PART}) WHERE NOT coalesce(p_size > 10, FALSE)")
def delete_where(spark, sf_dir):
    with _part_database(spark, sf_dir) as db:
        db.execute("DELETE FROM part WHERE p_size > 10")
        return db.sql("SELECT p_partkey, p_size FROM part")


@_query("rollback_restores", f"SELECT count(*) AS n FROM ({_PART})")
def rollback_restores(spark, sf_dir):
    with _part_database(spark, sf_dir) as db:
        db.begin()
        db.execute("DELETE FROM part")
        db.rollback()
        return db.sql("SELECT COUNT(*) FROM part").withColumnRenamed("count(*)", "n")


@_query("unique_index", "SELECT 'o_orderkey' AS col, CASE WHEN count(o_orderkey) = count(DISTINCT o_orderkey) THEN 'made' ELSE 'refused' END AS outcome FROM orders UNION ALL SELECT 'o_custkey', CASE WHEN count(o_custkey) = count(DISTINCT o_custkey) THEN 'made' ELSE 'refused' END FROM orders")
def unique_index(spark, sf_dir):
    """CREATE UNIQUE INDEX over all orders, on a column of different values and on one that repeats."""
    with Database.create(_folder(spark), spark) as db:
        db.execute("CREATE TABLE orders (o_orderkey INT64, o_custkey INT64)")
        db.load("orders", Tables(spark, sf_dir).read("orders").select("o_orderkey", "o_custkey"), "o_orderkey")
        return spark.createDataFrame([(c, _outcome(db, f"CREATE UNIQUE INDEX u_{c} ON orders ({c})")[0]) for c in ("o_orderkey", "o_custkey")], "col string, outcome string")


def _outcome(db: Database, sql: str) -> tuple[str, int]:
    """('made', 0), or ('refused', code)."""
    try:
        db.query(sql) if sql.startswith("SELECT") else db.execute(sql)
    except EngineError as e:
        return "refused", int(e.code)
    return "made", 0


#: Statements that must fail over the table part (p_partkey INT64 NOT NULL, p_size INT32, big BOOL), and their codes.
_REFUSED = [
    ("SELECT weight FROM part", Code.COLUMN_NOT_FOUND), ("SELECT p_size FROM wheels", Code.TABLE_NOT_FOUND), ("SELECT p_size FROM part ORDER BY big", Code.COLUMN_NOT_FOUND),
    ("SELECT p_size FROM part WHERE p_size = p_partkey", Code.TYPE_MISMATCH), ("SELECT p_size FROM part WHERE big", Code.SYNTAX), ("SELECT p_size FROM part WHERE p_size > 1.5", Code.TYPE_MISMATCH),
    ("SELECT COUNT(p_size) FROM part", Code.SYNTAX), ("SELECT a.p_size FROM part a JOIN part b ON a.big = b.big", Code.TYPE_MISMATCH), ("SELECT p_size FROM part a JOIN part b ON a.p_size = b.p_size", Code.SYNTAX),
    ("SELECT a.p_size FROM part a JOIN part b ON a.p_size = b.p_size WHERE a.p_size = 1", Code.EXEC), ("SELECT a.p_size FROM part a JOIN part b ON a.p_size = b.p_size ORDER BY a.p_size", Code.EXEC),
    ("INSERT INTO part VALUES (1, 2)", Code.VALUE_COUNT), ("INSERT INTO part VALUES (NULL, 2, TRUE)", Code.NOT_NULLABLE), ("INSERT INTO part VALUES (1, 3000000000, TRUE)", Code.TYPE_MISMATCH),
    ("UPDATE part SET p_partkey = NULL WHERE p_size = 1", Code.NOT_NULLABLE), ("CREATE TABLE part (a INT32)", Code.DUPLICATE_TABLE), ("CREATE INDEX i ON part (big)", Code.TYPE_MISMATCH),
    ("DROP INDEX nothing", Code.TABLE_NOT_FOUND), ("ROLLBACK", Code.EXEC), ("COMMIT", Code.EXEC), ("SELECT p_size FROM part ORDER BY p_size <-> [1] LIMIT 1", Code.TYPE_MISMATCH),
]


@_query("refusals", "SELECT CAST(n AS INTEGER) AS n, statement, CAST(code AS INTEGER) AS code FROM (VALUES " + ", ".join(f"({n}, $${q}$$, {int(c)})" for n, (q, c) in enumerate(_REFUSED)) + ") AS t(n, statement, code)")
def refusals(spark, sf_dir):
    """What the engine answers to statements that it must refuse."""
    with _part_database(spark, sf_dir) as db:
        return spark.createDataFrame([(n, q, _outcome(db, q)[1]) for n, (q, _) in enumerate(_REFUSED)], "n int, statement string, code int")


@_query("commit_keeps", f"SELECT count(*) AS n FROM ({_PART}) WHERE NOT coalesce(p_size = 20, FALSE)")
def commit_keeps(spark, sf_dir):
    with _part_database(spark, sf_dir) as db:
        with db.transaction():
            db.execute("DELETE FROM part WHERE p_size = 20")
        return db.sql("SELECT COUNT(*) FROM part").withColumnRenamed("count(*)", "n")


@_query("delete_few_join", "SELECT a.p_partkey AS p_partkey, b.p_size AS p_size FROM (SELECT * FROM part WHERE p_partkey NOT IN (2, 3, 70)) a JOIN (SELECT * FROM part WHERE p_partkey NOT IN (2, 3, 70)) b ON a.p_partkey = b.p_partkey WHERE b.p_size <> 13 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size = 13 AND p_partkey NOT IN (2, 3, 70)")
def delete_few_join(spark, sf_dir):
    """A join never sees rows that a DELETE has marked."""
    with _part_database(spark, sf_dir) as db:
        db.execute("DELETE FROM part WHERE p_partkey = 2 OR p_partkey = 3 OR p_partkey = 70")
        return db.sql("SELECT a.p_partkey, b.p_size FROM part a LEFT JOIN part b ON a.p_partkey = b.p_partkey")


@_query("prepared_where", "SELECT p_partkey FROM part WHERE (p_size >= 10 AND p_size < 20 AND p_size <> 13) OR p_partkey = 7")
def prepared_where(spark, sf_dir):
    """One prepared statement, bound and stepped twice; the second binding's rows."""
    with _part_database(spark, sf_dir) as db:
        s = db.prepare("SELECT p_partkey FROM part WHERE p_size >= ? AND p_size < ? OR p_partkey = ?")
        s.bind([1, 5, 3]).query()
        s.bind([10, 20, 7])
        return spark.createDataFrame(list(iter(s.step, None)), "p_partkey long")


@_query("join_null_keys", f"SELECT a.doc_id, r_name FROM (SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM ({_LABELED})) a LEFT JOIN (SELECT CASE WHEN r_regionkey > 1 THEN NULL ELSE CAST(r_regionkey AS BIGINT) END AS k, r_name FROM region) b ON a.quality = b.k")
def join_null_keys(spark, sf_dir):
    """Null keys on both sides never match."""
    t = Tables(spark, sf_dir)
    left = _labeled(t).select("doc_id", F.col("quality").cast("long").alias("quality"))
    right = t.read("region").select("r_regionkey", F.when(F.col("r_regionkey") <= 1, F.col("r_regionkey").cast("long")).alias("k"), "r_name")
    return t.sql("SELECT a.doc_id, b.r_name FROM a LEFT JOIN b ON a.quality = b.k", a=left, b=right)


@_query("vector_null_zero", f"SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 7 <> 0 ORDER BY {_COS}, vec_id LIMIT 25")
def vector_null_zero(spark, sf_dir):
    """By cosine distance, with every fifth vector null and every seventh zero: neither is a candidate."""
    t = Tables(spark, sf_dir)
    zero = F.array(*[F.lit(0.0).cast("float")] * 64)
    e = t.read("embeddings").select("vec_id", F.when(F.col("vec_id") % 5 == 0, None).when(F.col("vec_id") % 7 == 0, zero).otherwise(F.col("embedding")).alias("embedding"))
    return t.sql(f"SELECT vec_id FROM e ORDER BY embedding <=> {_VECTOR} LIMIT 25", e=e)


# --- queues and streams: all events, in order of their ids, are the messages
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).read("events").select("event_id", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("payload"))


def _queue(spark: SparkSession, sf_dir: str, clock: Callable[[], int] | None = None) -> Database:
    db = Database.create(_folder(spark), spark, leases=True, clock_ms=clock)
    db.execute("CREATE QUEUE q")
    db.enqueue_all("q", _events(spark, sf_dir), "event_id")
    return db


def _stream(spark: SparkSession, sf_dir: str) -> Database:
    db = Database.create(_folder(spark), spark)
    db.execute("CREATE STREAM s")
    db.execute("CREATE CURSOR c ON s")
    db.append_all("s", _events(spark, sf_dir), "event_id")
    return db


def _texts(messages: DataFrame) -> DataFrame:
    return messages.select("position", F.col("payload").cast("string").alias("payload"))


_MESSAGES = "(SELECT row_number() OVER (ORDER BY event_id) - 1 AS position, event_id || ':' || event_type AS payload FROM events)"


@_query("queue_fifo", f"SELECT position, payload FROM {_MESSAGES} WHERE position < 25")
def queue_fifo(spark, sf_dir):
    """What 25 DEQUEUEs of the whole queue answer."""
    with _queue(spark, sf_dir) as db:
        with db.transaction():
            got = [(i, db.dequeue("q").decode()) for i in range(25)]
        return spark.createDataFrame(got, "position long, payload string")


@_query("queue_rest", f"SELECT position, payload FROM {_MESSAGES} WHERE position >= 150")
def queue_rest(spark, sf_dir):
    with _queue(spark, sf_dir) as db:
        with db.transaction():
            for _ in range(150):
                db.dequeue("q")
        return _texts(db.messages("q"))


@_query("queue_depth", f"SELECT count(*) AS depth FROM {_MESSAGES} WHERE position >= 40")
def queue_depth(spark, sf_dir):
    with _queue(spark, sf_dir) as db:
        with db.transaction():
            for _ in range(40):
                db.dequeue("q")
        return spark.createDataFrame([(db.depth("q"),)], "depth long")


@_query("lease_claimable", f"SELECT position, CASE WHEN position >= 12 THEN 1 WHEN position % 3 = 1 THEN 3 ELSE 2 END AS token FROM {_MESSAGES} WHERE position < 20 AND (position >= 12 OR position % 3 <> 2)")
def lease_claimable(spark, sf_dir):
    """Of a queue of all events twelve messages are claimed at 1000 for 500: of three one is left to lapse, one handed
    back, one renewed past 1600. At 1600 the next 16 claims pass over the renewed ones."""
    clock = [1000]
    with _queue(spark, sf_dir, lambda: clock[0]) as db:
        with db.transaction():
            for t in [db.claim("q", 500) for _ in range(12)]:
                if t.position % 3 == 1:
                    db.nack("q", t.position, t.token)
                if t.position % 3 == 2:
                    db.renew("q", t.position, t.token, 2000)
            clock[0] = 1600
            got = [(t.position, t.token) for t in (db.claim("q", 5000) for _ in range(16))]
        return spark.createDataFrame(got, "position long, token int")


@_query("lease_ack", f"SELECT position, payload FROM {_MESSAGES} WHERE position >= 5")
def lease_ack(spark, sf_dir):
    """Of ten claimed messages those at 0 to 4 and 7 are answered, out of order: the head passes the first five, 7 stays
    behind it; what the queue holds."""
    with _queue(spark, sf_dir, lambda: 1000) as db:
        with db.transaction():
            tickets = [db.claim("q", 500) for _ in range(10)]
            for i in (7, 3, 0, 4, 1, 2):
                db.ack("q", tickets[i].position, tickets[i].token)
        return _texts(db.messages("q"))


@_query("consume_is_atomic", f"SELECT 'first' AS try, CAST(0 AS BIGINT) AS depth UNION ALL SELECT 'second', count(*) FROM {_MESSAGES}")
def consume_is_atomic(spark, sf_dir):
    """A consumer that moves a stream into a queue: it fails once after it has written, and leaves no trace; then it commits
    messages and cursor together."""
    from .streaming.reader import consume

    with _stream(spark, sf_dir) as db:
        db.execute("CREATE QUEUE q")

        def move(df: DataFrame, to: Database, fail: bool) -> None:
            to.enqueue_all("q", df, "position")
            if fail:
                raise RuntimeError("after writing")

        got = []
        for name, fail in (("first", True), ("second", False)):
            try:
                consume(db, "s", "c", lambda df, to, fail=fail: move(df, to, fail))
            except RuntimeError:
                pass
            got.append((name, db.depth("q")))
        return spark.createDataFrame(got, "try string, depth long")


@_query("stream_read_cursor", f"SELECT position, payload FROM {_MESSAGES} WHERE position BETWEEN 30 AND 49")
def stream_read_cursor(spark, sf_dir):
    """What the 31st to 50th READ of the whole stream answer."""
    with _stream(spark, sf_dir) as db:
        with db.transaction():
            got = [(i, db.read_stream("s", "c").decode()) for i in range(50)][30:]
        return spark.createDataFrame(got, "position long, payload string")


@_query("stream_consume", f"SELECT position, payload FROM {_MESSAGES}")
def stream_consume(spark, sf_dir):
    """A consumer that takes all unread records as one DataFrame and commits them with its cursor."""
    from .streaming.reader import consume

    with _stream(spark, sf_dir) as db:
        taken: list[DataFrame] = []
        consume(db, "s", "c", lambda df, _: taken.append(df))
        return _texts(taken[0])


@_query("stream_trim", f"SELECT position, payload FROM {_MESSAGES} WHERE position >= 70")
def stream_trim(spark, sf_dir):
    with _stream(spark, sf_dir) as db:
        db.execute("DROP CURSOR c ON s")
        db.execute("TRIM STREAM s BEFORE 70")
        return _texts(db.messages("s"))


@_query("stream_follow", f"SELECT position, payload FROM {_MESSAGES} UNION ALL SELECT (SELECT count(*) FROM events) AS position, 'last' AS payload")
def stream_follow(spark, sf_dir):
    """A stream through Structured Streaming: flushed twice, read to the end by one streaming query."""
    from .streaming.reader import flush, follow

    with _stream(spark, sf_dir) as db:
        flush(db, "s")
        db.append("s", "last")
        out = _folder(spark)
        writer = follow(db, "s").writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        writer.awaitTermination()
        return _texts(spark.read.schema("position long, payload binary").parquet(f"{out}/data"))
