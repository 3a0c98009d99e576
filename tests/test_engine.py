import random
import shutil

import pytest

from sparkmere import BusyError, Code, Database, EngineError, MisuseError
from sparkmere.shell import Shell, table_text


#: Readings of invented gauges: every fifth has no level, and levels repeat.
GAUGES = [(100 + 7 * i, None if i % 5 == 3 else (i * 11) % 17 - 6, i % 3 != 1, (i * 5) % 23 / 4 - 2) for i in range(18)]
SITES = [(n, 10**10 + n) for n in (-6, 3, 3, 5, 9, 40)]
CELLS = ("gauge", "level", "live", "drift")


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("db") / "main"
    d = Database.create(str(path), spark)
    d.execute("CREATE TABLE gauges (gauge INT64 NOT NULL, level INT32, live BOOL NOT NULL, drift FLOAT32)")
    d.execute("CREATE TABLE sites (level INTEGER, code BIGINT)")
    show = lambda v: "NULL" if v is None else str(v).upper()
    assert d.execute("INSERT INTO gauges VALUES " + ", ".join(f"({', '.join(map(show, r))})" for r in GAUGES)) == f"INSERT {len(GAUGES)}"
    d.execute("INSERT INTO sites VALUES " + ", ".join(map(str, SITES)))
    yield d
    d.close()


def chosen(test):
    return [r for r in GAUGES if test(dict(zip(CELLS, r, strict=True)))]


def by_level(descending):
    """Nulls last when ascending, first when descending; ties in the order of the rows."""
    known = sorted((r for r in GAUGES if r[1] is not None), key=lambda r: -r[1] if descending else r[1])
    unknown = [r for r in GAUGES if r[1] is None]
    return unknown + known if descending else known + unknown


KEPT = {
    "level > 4": lambda r: r["level"] is not None and r["level"] > 4,
    "-1 >= level": lambda r: r["level"] is not None and r["level"] <= -1,
    "gauge != 121": lambda r: r["gauge"] != 121,
    "live = FALSE": lambda r: not r["live"],
    "drift < 0.5": lambda r: r["drift"] < 0.5,
    "level IS NOT NULL": lambda r: r["level"] is not None,
    "level = NULL OR live = TRUE": lambda r: r["live"],
    "NOT (level < 2 OR drift > 1)": lambda r: r["level"] is not None and r["level"] >= 2 and r["drift"] <= 1,
    "NOT (live = TRUE AND level > 0)": lambda r: not r["live"] or (r["level"] is not None and r["level"] <= 0),
    "gauge = 999": lambda r: False,
}


@pytest.mark.parametrize("where", KEPT)
def test_where(db, where):
    rows = chosen(KEPT[where])
    assert db.query(f"SELECT * FROM gauges WHERE {where}") == rows
    assert db.query(f"SELECT g.Drift, g.GAUGE FROM Gauges AS g WHERE {where} LIMIT 4 OFFSET 2") == [(r[3], r[0]) for r in rows[2:6]]
    assert db.query(f"SELECT COUNT(*) FROM gauges WHERE {where}") == [(len(rows),)]


def test_order_limit_and_count(db):
    for word, descending in (("", False), (" ASC", False), (" DESC", True)):
        rows = [r[:2] for r in by_level(descending)]
        assert db.query(f"SELECT gauge, level FROM gauges ORDER BY level{word}") == rows
        assert db.query(f"SELECT gauge, level FROM gauges ORDER BY level{word} LIMIT 5 OFFSET 3") == rows[3:8]
    assert db.query("SELECT live, gauge FROM gauges ORDER BY live") == sorted(((r[2], r[0]) for r in GAUGES), key=lambda r: r[0])
    assert db.query("SELECT gauge, level, gauge FROM gauges LIMIT 3 OFFSET 16") == [(r[0], r[1], r[0]) for r in GAUGES[16:]]
    for tail, rows in (("", [(18,)]), (" LIMIT 5", [(18,)]), (" LIMIT 0", []), (" LIMIT 3 OFFSET 2", [])):
        assert db.query(f"SELECT COUNT(*) FROM gauges{tail}") == rows
    assert "Scan parquet" not in db.sql("SELECT COUNT(*) FROM gauges")._jdf.queryExecution().toString()


def test_joins(db):
    met = [(r, s) for r in GAUGES for s in SITES if r[1] == s[0]]
    inner = [(r[0], s[1]) for r, s in met]
    for on in ("g.level = s.level", "s.level = g.level"):
        assert db.query(f"SELECT g.gauge, s.code FROM gauges g INNER JOIN sites s ON {on}") == inner
    outer = inner + [(r[0], None) for r in GAUGES if r not in [m[0] for m in met]]
    assert db.query("SELECT g.gauge, s.code FROM gauges g LEFT JOIN sites s ON g.level = s.level") == outer
    n = len(inner)
    assert db.query(f"SELECT g.gauge, s.code FROM gauges g LEFT JOIN sites s ON g.level = s.level LIMIT 3 OFFSET {n - 1}") == outer[n - 1 : n + 2]


REFUSED = {
    Code.COLUMN_NOT_FOUND: ["SELECT depth FROM gauges", "SELECT gauges.gauge FROM gauges g", "SELECT gauge FROM gauges WHERE s.level = 1", "SELECT gauge FROM gauges ORDER BY drift", "UPDATE gauges SET depth = 1 WHERE gauge = 100"],
    Code.TABLE_NOT_FOUND: ["SELECT gauge FROM basins", "SELECT g.gauge FROM gauges g JOIN basins b ON g.level = b.level", "DROP TABLE basins", "READ FROM gauges AS c"],
    Code.TYPE_MISMATCH: [
        "SELECT gauge FROM gauges WHERE level < 2.25",
        "SELECT gauge FROM gauges WHERE level = 2147483648",
        "SELECT gauge FROM gauges WHERE live > FALSE",
        "SELECT g.gauge FROM gauges g JOIN sites s ON g.level = s.code",
        "SELECT g.gauge FROM gauges g JOIN gauges h ON g.live = h.live",
        "INSERT INTO gauges VALUES (1, 2, TRUE, 'low')",
        "INSERT INTO gauges VALUES (1, -2147483649, TRUE, 0.5)",
    ],
    Code.SYNTAX: ["SELECT * FROM gauges g JOIN sites s ON g.level = s.level", "SELECT code FROM gauges g JOIN sites s ON g.level = s.level"],
    Code.EXEC: ["SELECT g.gauge FROM gauges g JOIN sites s ON g.level = s.level WHERE g.gauge = 100", "SELECT g.gauge FROM gauges g JOIN sites s ON g.level = s.level ORDER BY g.gauge", "ROLLBACK", "COMMIT"],
    Code.DUPLICATE_TABLE: ["CREATE TABLE Sites (a INT64)", "CREATE QUEUE gauges"],
    Code.NOT_NULLABLE: ["INSERT INTO gauges VALUES (1, 2, NULL, 0.5)", "UPDATE gauges SET live = NULL WHERE gauge = 100"],
    Code.VALUE_COUNT: ["INSERT INTO sites VALUES (1, 2), (3)", "INSERT INTO sites VALUES (1, 2, 3)"],
}


@pytest.mark.parametrize(("code", "sql"), [(code, sql) for code, some in REFUSED.items() for sql in some])
def test_refusals_change_nothing(db, code, sql):
    before = db.generation
    with pytest.raises(EngineError) as e:
        db.query(sql) if sql.startswith("SELECT") else db.execute(sql)
    assert (e.value.code, db.generation) == (code, before)


def test_join_emission_order(spark, tmp_path):
    with Database.create(str(tmp_path / "j"), spark) as d:
        d.execute("CREATE TABLE l (k INT32, v INT64)")
        d.execute("CREATE TABLE r (k INT32, v INT64)")
        left, right = [(i % 5, i) for i in range(100)], [(i % 3, i) for i in range(80)]
        for name, rows in (("l", left), ("r", right)):
            d.execute(f"INSERT INTO {name} VALUES " + ",".join(f"({k},{v})" for k, v in rows))
        expected = []
        for a in range(0, 100, 64):
            part = left[a : a + 64]
            for b in range(0, 80, 64):
                expected += [(x[1], y[1]) for x in part for y in right[b : b + 64] if x[0] == y[0]]
            expected += [(x[1], None) for x in part if not any(x[0] == y[0] for y in right)]
        assert d.query("SELECT l.v, r.v FROM l LEFT JOIN r ON l.k = r.k") == expected
        assert d.query("SELECT l.v, r.v FROM l LEFT JOIN r ON l.k = r.k LIMIT 50 OFFSET 1000") == expected[1000:1050]


def model(e, row):
    """Three-valued logic in Python, with the rule that NaN compares false."""
    kind = e[0]
    if kind == "not":
        v = model(e[1], row)
        return None if v is None else not v
    if kind in ("and", "or"):
        a, b = model(e[1], row), model(e[2], row)
        if kind == "and":
            return False if a is False or b is False else None if a is None or b is None else True
        return True if a is True or b is True else None if a is None or b is None else False
    if kind == "null":
        return row[e[1]] is None
    cell = row[e[1]]
    if cell is None or e[3] is None:
        return None
    if cell != cell:
        return False
    return {"=": cell == e[3], "!=": cell != e[3], "<": cell < e[3], "<=": cell <= e[3], ">": cell > e[3], ">=": cell >= e[3]}[e[2]]


def grow(rng, depth):
    if depth and rng.random() < 0.7:
        kind = rng.choice(("and", "or", "not"))
        return ("not", grow(rng, depth - 1)) if kind == "not" else (kind, grow(rng, depth - 1), grow(rng, depth - 1))
    if rng.random() < 0.2:
        return ("null", rng.choice("abf"))
    column = rng.choice("abf")
    value = None if rng.random() < 0.1 else rng.choice((True, False)) if column == "b" else rng.choice((-1, 0, 1, 2))
    return ("cmp", column, rng.choice(("=", "!=") if column == "b" else ("=", "!=", "<", "<=", ">", ">=")), value)


def text(e):
    if e[0] == "not":
        return f"NOT ({text(e[1])})"
    if e[0] in ("and", "or"):
        return f"({text(e[1])} {e[0].upper()} {text(e[2])})"
    if e[0] == "null":
        return f"{e[1]} IS NULL"
    return f"{e[1]} {e[2]} {'NULL' if e[3] is None else str(e[3]).upper()}"


def test_random_predicates_against_a_model(spark, tmp_path):
    rng = random.Random(11)
    values = [(a, b, f) for a in (None, -1, 0, 1) for b in (None, True, False) for f in (None, float("nan"), float("inf"), -0.0, 1.0)]
    rows = [{"id": i, "a": a, "b": b, "f": f} for i, (a, b, f) in enumerate(values)]
    with Database.create(str(tmp_path / "m"), spark) as d:
        d.execute("CREATE TABLE t (id INT64, a INT32, b BOOL, f FLOAT32)")
        df = spark.createDataFrame([(r["id"], r["a"], r["b"], r["f"]) for r in rows], "id long, a int, b boolean, f float")
        assert d.load("t", df, "id") == len(rows)
        for _ in range(25):
            e = grow(rng, 3)
            assert [r[0] for r in d.query(f"SELECT id FROM t WHERE {text(e)}")] == [r["id"] for r in rows if model(e, r) is True], text(e)


def test_update_delete_and_physical_order(spark, tmp_path):
    with Database.create(str(tmp_path / "u"), spark) as d:
        d.execute("CREATE TABLE t (id INT64 NOT NULL, v INT32, msg TEXT, raw BLOB)")
        d.execute("INSERT INTO t VALUES (1, 1, 'a', X'00ff'), (2, NULL, '', X''), (3, 3, NULL, NULL)")
        d.execute("INSERT INTO t VALUES (4, 4, 'd', X'01'), (5, 5, 'e', X'02')")
        assert d.execute("UPDATE t SET v = 9 WHERE id = 4 OR id = 1") == "UPDATE 2"
        assert d.execute("UPDATE t SET msg = ? WHERE id = 3", ["it's"]) == "UPDATE 1"
        assert d.query("SELECT * FROM t") == [(1, 9, "a", b"\x00\xff"), (2, None, "", b""), (3, 3, "it's", None), (4, 9, "d", b"\x01"), (5, 5, "e", b"\x02")]
        before = d.generation
        assert d.execute("UPDATE t SET v = 1 WHERE id = 99") == "UPDATE 0" and d.execute("DELETE FROM t WHERE v = 77") == "DELETE 0"
        assert d.generation == before
        assert d.execute("DELETE FROM t WHERE v > 4 AND id < 5") == "DELETE 2"  # an unknown predicate keeps its row
        assert d.query("SELECT id FROM t") == [(2,), (3,), (5,)]
        d.execute("INSERT INTO t VALUES (6, 6, 'f', NULL)")
        assert d.query("SELECT id FROM t") == [(2,), (3,), (5,), (6,)]
        assert d.catalog.rows(d.state["objects"]["t"]).agg({"_row_id": "max"}).first()[0] == 5
        assert d.execute("DELETE FROM t") == "DELETE 4" and d.query("SELECT COUNT(*) FROM t") == [(0,)]
        assert d.check() == []


def test_unique_index(spark, tmp_path):
    with Database.create(str(tmp_path / "i"), spark) as d:
        d.execute("CREATE TABLE t (id INT64, v FLOAT32)")
        d.execute("INSERT INTO t VALUES (1, 1.0), (2, 2.0), (NULL, 3.0), (NULL, 4.0)")
        d.execute("CREATE UNIQUE INDEX ti ON t (id)")
        for sql in ("INSERT INTO t VALUES (2, 0.0)", "INSERT INTO t VALUES (7, 0.0), (7, 0.0)", "UPDATE t SET id = 2 WHERE id = 1", "UPDATE t SET id = 8 WHERE v > 2.5", "CREATE INDEX tv ON t (v)", "CREATE TABLE ti (x INT32)"):
            with pytest.raises(EngineError):
                d.execute(sql)
        d.execute("INSERT INTO t VALUES (NULL, 5.0)")
        assert d.execute("UPDATE t SET id = 2 WHERE id = 2") == "UPDATE 1"
        with pytest.raises(EngineError):
            d.load("t", spark.createDataFrame([(1, 0.0)], "id long, v float"), "id")
        d.execute("DROP INDEX ti")
        d.execute("INSERT INTO t VALUES (2, 0.0)")
        with pytest.raises(EngineError):
            d.execute("CREATE UNIQUE INDEX ti ON t (id)")
        d.execute("CREATE INDEX tp ON t (id)")
        d.execute("DROP TABLE t")
        assert d.info()["indexes"] == 0


def test_vectors(spark, tmp_path):
    """Against distances worked out in Python; a zero vector has no direction, and a null none of either."""
    rng = random.Random(31)
    points = [[rng.choice((-2.0, -0.5, 0.0, 1.0, 3.0)) for _ in range(4)] for _ in range(30)]
    points[4], points[9], points[17] = None, [0.0] * 4, points[2]
    query = [1.0, -0.5, 2.0, 0.25]
    far = {"l2": lambda v: sum((a - b) ** 2 for a, b in zip(v, query, strict=True)), "cosine": lambda v: 1 - sum(a * b for a, b in zip(v, query, strict=True)) / (sum(a * a for a in v) * sum(a * a for a in query)) ** 0.5}
    with Database.create(str(tmp_path / "v"), spark) as d:
        d.execute("CREATE TABLE spots (spot INT64 NOT NULL, place VECTOR(FLOAT32, 4))")
        d.execute("INSERT INTO spots VALUES " + ", ".join(f"({i}, {'NULL' if p is None else p})" for i, p in enumerate(points)))
        ids = lambda tail: [r[0] for r in d.query(f"SELECT spot FROM spots {tail}")]
        for metric, forms in (("l2", (f"place <-> {query}", f"L2_DISTANCE(place, {query})")), ("cosine", (f"place <=> {query}", f"COSINE_DISTANCE(place, {query})"))):
            near = [i for i, p in enumerate(points) if p is not None and (metric == "l2" or any(p))]
            for form in forms:
                for word, sign in (("", 1), (" DESC", -1)):
                    order = sorted(near, key=lambda i: (round(sign * far[metric](points[i]), 5), i))  # noqa: B023
                    assert ids(f"ORDER BY {form}{word} LIMIT 40") == order
                    assert ids(f"WHERE spot > 10 ORDER BY {form}{word} LIMIT 4 OFFSET 2") == [i for i in order if i > 10][2:6]
        for tail in (f"ORDER BY place <-> {query}", "ORDER BY place <-> [1, 2, 3] LIMIT 2", "ORDER BY place <=> [0, 0, 0, 0] LIMIT 2", f"ORDER BY spot <=> {query} LIMIT 2", f"WHERE place != {query}"):
            with pytest.raises(EngineError):
                ids(tail)
        assert ids("WHERE place IS NULL") == [4]


def test_deletes_mark_rows_and_vacuum_reclaims(spark, tmp_path):
    path = tmp_path / "d"
    files = lambda: {str(p) for p in (path / "t").rglob("*.parquet")}
    with Database.create(str(path), spark) as d:
        d.execute("CREATE TABLE t (id INT64 NOT NULL, k INT32)")
        d.execute("CREATE TABLE u (k INT32)")
        d.load("t", spark.range(300).selectExpr("id", "cast(id % 7 as int) k"), "id")
        d.execute("INSERT INTO u VALUES (3)")
        before = files()
        assert d.execute("DELETE FROM t WHERE id = 64") == "DELETE 1" and files() == before
        assert d.execute("DELETE FROM t WHERE id < 3") == "DELETE 3" and files() == before
        left = [i for i in range(3, 300) if i != 64]
        assert [r[0] for r in d.query("SELECT id FROM t")] == left and d.query("SELECT COUNT(*) FROM t") == [(len(left),)]
        # a join counts its batches in live rows
        batches = [left[a : a + 64] for a in range(0, len(left), 64)]
        expected = [x for b in batches for x in [*[(i, 3) for i in b if i % 7 == 3], *[(i, None) for i in b if i % 7 != 3]]]
        assert d.query("SELECT t.id, u.k FROM t LEFT JOIN u ON t.k = u.k LIMIT 200 OFFSET 20") == expected[20:220]
        with d.transaction():
            d.execute("DELETE FROM t WHERE id = 5")
            d.rollback()
        assert d.execute("UPDATE t SET k = 9 WHERE id = 64") == "UPDATE 0" and d.check() == []
        assert d.vacuum()["tables"] == 1 and not files() & before
        assert d.state["objects"]["t"]["dead"] == [] and [r[0] for r in d.query("SELECT id FROM t")] == left and d.check() == []
        assert d.vacuum()["tables"] == 0
        for i in range(40):  # one part an INSERT, joined as they come
            d.execute(f"INSERT INTO u VALUES ({i})")
        assert len(d.state["objects"]["u"]["parts"]) < 33 and [r[0] for r in d.query("SELECT k FROM u")] == [3, *range(40)]
        d.vacuum()
        assert len(d.state["objects"]["u"]["parts"]) <= 2 and len(d.query("SELECT k FROM u")) == 41
        d.execute("DROP TABLE t")
        d.vacuum()
        assert not files()


def test_many_deletes_write_their_parts_anew(spark, tmp_path, monkeypatch):
    from sparkmere.plans import dml

    monkeypatch.setattr(dml, "MARKS", 10)
    with Database.create(str(tmp_path / "d"), spark) as d:
        d.execute("CREATE TABLE t (id INT64, v INT32)")
        for a in (0, 100):
            d.load("t", spark.range(a, a + 100).selectExpr("id", "cast(id as int) v"), "id")
        parts = list(d.state["objects"]["t"]["parts"])
        d.execute("DELETE FROM t WHERE id = 3 OR id = 150")
        d.execute("DELETE FROM t WHERE id > 120")
        assert d.state["objects"]["t"]["parts"][0] == parts[0] and d.state["objects"]["t"]["dead"] == [3]
        assert [r[0] for r in d.query("SELECT id FROM t")] == [i for i in range(121) if i != 3] and d.check() == []
        assert d.execute("DELETE FROM t WHERE id >= 0") == "DELETE 120" and d.query("SELECT id FROM t") == []


def test_topk_ties_and_candidates(spark):
    from sparkmere.operators.vector_search import Arena, topk

    arena = Arena(2)
    for v in ([1, 0], [1, 0], [0, 1], [0.5, 0.5], [-1, 0]):
        arena.append_raw(v)
    df = arena.dataframe(spark)
    ids = lambda **k: [r[0] for r in topk(df, "vec", [1.0, 0.0], 3, **k).select("vector_id").collect()]
    assert ids() == [0, 1, 3] and ids(metric="cosine") == [0, 1, 3]
    assert ids(reverse=True) == [4, 2, 3]
    assert ids(only=df.where("vector_id > 0")) == [1, 3, 2]
    with pytest.raises(EngineError):
        arena.append_normalized([0.0, 0.0])
    with pytest.raises(EngineError):
        arena.append_raw([float("nan"), 0.0])


def test_transactions_and_readers(spark, tmp_path):
    path = str(tmp_path / "t")
    with Database.create(path, spark) as d:
        d.execute("CREATE TABLE t (id INT32)")
        d.execute("CREATE QUEUE q")
        d.execute("CREATE STREAM s")
        reader = Database.open(path, spark, read_only=True)
        with pytest.raises(BusyError):
            Database.open(path, spark)
        with pytest.raises(RuntimeError), d.transaction():
            d.execute("INSERT INTO t VALUES (1)")
            d.enqueue("q", "x")
            d.append("s", "y")
            raise RuntimeError
        assert d.query("SELECT * FROM t") == [] and d.depth("q") == 0
        with d.transaction():
            d.execute("INSERT INTO t VALUES (1)")
            d.enqueue("q", "x")
            d.append("s", "y")
            with pytest.raises(EngineError):
                d.execute("INSERT INTO t VALUES (TRUE)")
            with pytest.raises(EngineError):
                d.execute("BEGIN")
        assert d.query("SELECT * FROM t") == [(1,)] and d.peek("q") == b"x"
        assert reader.query("SELECT * FROM t") == []
        reader.refresh()
        assert reader.query("SELECT * FROM t") == [(1,)]
        with pytest.raises(EngineError):
            reader.execute("BEGIN")
        d.execute("BEGIN")
        d.execute("DELETE FROM t")
    again = Database.open(path, spark)  # closing rolled back
    assert again.query("SELECT * FROM t") == [(1,)]
    again.close()
    with pytest.raises(MisuseError):
        again.query("SELECT * FROM t")


def test_a_crash_before_the_rename_leaves_the_old_generation(spark, tmp_path):
    path = str(tmp_path / "c")
    d = Database.create(path, spark)
    d.execute("CREATE TABLE t (id INT32)")
    d.execute("INSERT INTO t VALUES (1)")
    d.catalog.store.rename_new = lambda *_: (_ for _ in ()).throw(KeyboardInterrupt)  # dies with data and manifest written
    with pytest.raises(KeyboardInterrupt):
        d.execute("INSERT INTO t VALUES (2)")
    shutil.copytree(path, path + "2")
    (tmp_path / "c2" / "_lock").unlink()
    with Database.open(path + "2", spark) as e:
        assert e.query("SELECT * FROM t") == [(1,)] and e.check() == []
        e.execute("INSERT INTO t VALUES (3)")
        assert e.query("SELECT * FROM t") == [(1,), (3,)]
    d.close()


def test_prepared_statements(spark, tmp_path):
    with Database.create(str(tmp_path / "p"), spark) as d:
        d.execute("CREATE TABLE t (id INT64, v INT32, f FLOAT32, s TEXT, raw BLOB, e VECTOR(FLOAT32, 2))")
        s = d.prepare("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)")
        assert s.parameter_count == 6
        with pytest.raises(MisuseError):
            s.bind_int32(0, 1)  # the column is INT64
        with pytest.raises(EngineError):
            s.execute()  # nothing is bound
        for i in range(2):
            s.bind([i, i * 2, 0.1, "x", b"\x01", [1.0, 2.0]])
            assert s.execute() == "INSERT 1"
        s.clear_bindings()
        with pytest.raises(EngineError):
            s.execute()
        q = d.prepare("SELECT id FROM t WHERE v >= ? AND f = ?")
        with pytest.raises(MisuseError):
            q.bind_null(0)
        with pytest.raises(MisuseError):
            q.bind_text(0, "x")
        q.bind_int32(0, 2)
        q.bind_float(1, 0.1)
        assert q.query() == [(1,)] and q.query() == [(1,)]
        q.bind_int32(0, 0)
        assert q.step() == (0,) and q.step() == (1,) and q.step() is None
        q.reset()
        assert q.step() == (0,) and q.column_names == ["id"] and q.column_types == ["INT64"]
        seen = []
        q.batches(lambda b: seen.append(b.num_rows))
        assert sum(seen) == 2
        with pytest.raises(EngineError) as e:
            q.batches(lambda b: 1 / 0)
        assert e.value.code == Code.SINK
        assert d.execute("UPDATE t SET s = ? WHERE id = ?", [None, 1]) == "UPDATE 1"
        assert d.query("SELECT id, f, e FROM t WHERE f = 0.1") == [(0, pytest.approx(0.1), [1.0, 2.0]), (1, pytest.approx(0.1), [1.0, 2.0])]


def test_scans_prune_and_push_down(spark, tmp_path, capsys):
    with Database.create(str(tmp_path / "x"), spark) as d:
        d.execute("CREATE TABLE t (a INT32, b INT64, f FLOAT32, unused TEXT)")
        d.execute("INSERT INTO t VALUES (1, 2, 3.0, 'x')")
        d.sql("SELECT a FROM t WHERE b > 1 AND f > 1.0").explain("formatted")
        plan = capsys.readouterr().out
        assert "unused" not in plan.split("ReadSchema")[1].splitlines()[0]
        assert "GreaterThan(b,1)" in plan and "GreaterThan(f,1.0)" in plan
        d.sql("SELECT a FROM t ORDER BY a LIMIT 3").explain()
        assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_shell(db):
    import io

    out = io.StringIO()
    failed = Shell(db, out).run(["SELECT gauge, drift FROM gauges\n", "WHERE gauge > 210; SELECT depth FROM gauges;\n", ".tables\n", ".check\n"])
    said, rows = out.getvalue(), [(r[0], r[3]) for r in GAUGES if r[0] > 210]
    assert failed == 1 and "gauge | drift\n-------------\n" + "".join(f"{a} | {b:.2f}\n" for a, b in rows) + f"({len(rows)} rows)" in said
    assert "error: column not found in schema" in said and "gauges\nsites" in said and "OK" in said
    assert table_text(["a"], [(None,), (True,), (-0.999,), (0.129,)]).splitlines()[2:] == ["NULL", "TRUE", "-0.99", "0.12", "(4 rows)"]
