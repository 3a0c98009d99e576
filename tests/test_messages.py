import random

import pytest

from sparkmere import Database, EngineError
from sparkmere.streaming.reader import consume, flush, follow


@pytest.fixture
def clock():
    return [1000]


@pytest.fixture
def db(spark, tmp_path, clock):
    d = Database.create(str(tmp_path / "db"), spark, leases=True, clock_ms=lambda: clock[0])
    yield d
    d.close()


def test_fifo_over_parts(db):
    db.execute("CREATE QUEUE q")
    words = [f"m{i}" * (1 + i % 5) for i in range(300)]
    with db.transaction():
        for w in words:
            db.enqueue("q", w)
    assert db.depth("q") == 300 and db.peek("q") == b"m0"
    db.execute("ENQUEUE INTO q VALUES (X'00ff')")
    with db.transaction():
        assert [db.dequeue("q") for _ in range(300)] == [w.encode() for w in words]
    assert db.execute("DEQUEUE FROM q") == b"\x00\xff" and db.execute("DEQUEUE FROM q") is None
    assert db.enqueue("q", "next") == 301  # positions are never used again


def test_leases(db, clock):
    db.execute("CREATE QUEUE jobs")
    for w in ("alpha", "beta", "gamma"):
        db.enqueue("jobs", w)
    t = db.execute("CLAIM FROM jobs FOR 100")
    assert (t.payload, t.position, t.token) == (b"alpha", 0, 1)
    db.execute("NACK FROM jobs AT 0 TOKEN 1")
    with pytest.raises(EngineError):
        db.execute("ACK FROM jobs AT 0 TOKEN 1")
    t = db.claim("jobs", 100)
    assert t.token == 3 and db.claim("jobs", 100).payload == b"beta"
    assert db.dequeue("jobs") is None  # the head is claimed
    clock[0] = 1100
    with db.transaction():
        db.renew("jobs", 0, 3, 100)  # a deadline that has passed is no refusal
    assert db.claim("jobs", 100).payload == b"beta"
    db.ack("jobs", 0, 3)
    assert db.depth("jobs") == 2
    clock[0] = 500  # the clock doesn't run backwards
    db.claim("jobs", 10)
    assert db.state["objects"]["jobs"]["leases"]["2"][1] == 1110
    with pytest.raises(EngineError):
        db.claim("jobs", 0)


def test_leases_need_the_capability(spark, tmp_path):
    with Database.create(str(tmp_path / "n"), spark) as d:
        d.execute("CREATE QUEUE q")
        d.enqueue("q", "x")
        with pytest.raises(EngineError, match="QUEUE_LEASES"):
            d.execute("CLAIM FROM q FOR 5")


def test_leases_against_a_model(db, clock):
    """Random claims, answers and time against a plain list of states."""
    rng = random.Random(5)
    db.execute("CREATE QUEUE q")
    model: list[list[int]] = []
    head, floor = 0, 0
    db.begin()
    for _ in range(600):
        act = rng.choice(("put", "claim", "claim", "ack", "nack", "renew", "time"))
        held = [i for i, m in enumerate(model) if m[0] == 1 and i >= head]
        if act == "put" and len(model) < 40:
            db.enqueue("q", str(len(model)))
            model.append([0, 0, 0])
        elif act == "time":
            clock[0] += rng.randint(-20, 60)
        elif act == "claim":
            now = max(clock[0], floor)
            ready = [i for i in range(head, len(model)) if model[i][0] == 0 or (model[i][0] == 1 and model[i][1] <= now)]
            t = db.claim("q", 50)
            assert (t and t.position) == (ready[0] if ready else None)
            if ready:
                floor = now
                model[ready[0]] = [1, now + 50, model[ready[0]][2] + 1]
                assert t.token == model[ready[0]][2]
        elif held:
            i = rng.choice(held)
            token = model[i][2]
            if rng.random() < 0.2:
                with pytest.raises(EngineError):
                    db.ack("q", i, token + 1)
            elif act == "ack":
                db.ack("q", i, token)
                model[i] = [2, 0, token]
            elif act == "nack":
                db.nack("q", i, token)
                model[i] = [0, 0, token + 1]
            else:
                floor = max(clock[0], floor)
                db.renew("q", i, token, 50)
                model[i] = [1, floor + 50, token]
        while head < len(model) and model[head][0] == 2:
            head += 1
        assert db.state["objects"]["q"]["head"] == head
    db.commit()


def test_streams(db):
    db.execute("CREATE STREAM s")
    for i in range(5):
        db.execute(f"APPEND TO s VALUES ('r{i}')")
    db.execute("CREATE CURSOR a ON s")
    db.execute("CREATE CURSOR b ON s")
    assert [db.execute("READ FROM s AS a") for _ in range(6)] == [b"r0", b"r1", b"r2", b"r3", b"r4", None]
    assert db.read_stream("s", "b") == b"r0"
    with pytest.raises(EngineError):
        db.execute("TRIM STREAM s BEFORE 2")  # past the slowest cursor
    with pytest.raises(EngineError):
        db.execute("READ FROM s AS nobody")
    db.execute("TRIM STREAM s BEFORE 1")
    before = db.generation
    db.execute("TRIM STREAM s BEFORE 1")
    assert db.generation == before
    db.execute("DROP CURSOR b ON s")
    with pytest.raises(EngineError):
        db.execute("TRIM STREAM s BEFORE 6")
    db.execute("TRIM STREAM s BEFORE 5")
    assert db.append("s", "r5") == 5
    for i in range(7):
        db.execute(f"CREATE CURSOR c{i} ON s")
    with pytest.raises(EngineError):
        db.execute("CREATE CURSOR ninth ON s")
    with pytest.raises(EngineError):
        db.execute("CREATE TABLE s (x INT32)")  # one namespace
    db.begin()
    assert db.read_stream("s", "a") == b"r5"
    db.rollback()
    assert db.read_stream("s", "a") == b"r5"
    db.execute("DROP STREAM s")


def test_bulk_consume_and_follow(db, spark, tmp_path):
    db.execute("CREATE STREAM s")
    db.execute("CREATE CURSOR c ON s")
    assert db.append_all("s", spark.range(200).selectExpr("id", "cast(id as string) as payload"), "id") == 200
    assert db.read_stream("s", "c") == b"0"
    db.execute("CREATE TABLE seen (n INT64)")
    assert consume(db, "s", "c", lambda df, d: d.execute("INSERT INTO seen VALUES (?)", [df.count()])) == 199
    with pytest.raises(ZeroDivisionError):
        db.append("s", "x")
        consume(db, "s", "c", lambda df, d: (d.execute("INSERT INTO seen VALUES (0)"), 1 / 0))
    assert db.query("SELECT * FROM seen") == [(199,)] and db.read_stream("s", "c") == b"x"
    flush(db, "s")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        follow(db, "s").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run()
    db.append("s", "late")
    run()
    got = [(r[0], bytes(r[1])) for r in spark.read.parquet(out).orderBy("position").collect()]
    assert len(got) == 202 and got[-1] == (201, b"late") and [p for p, _ in got] == list(range(202))


def test_bulk_queue(db, spark):
    db.execute("CREATE QUEUE q")
    db.enqueue("q", "first")
    db.enqueue_all("q", spark.range(20).selectExpr("id", "concat('m', id) as payload"), "id")
    db.enqueue("q", "last")
    with db.transaction():
        assert [db.dequeue("q").decode() for _ in range(22)] == ["first", *[f"m{i}" for i in range(20)], "last"]


def test_claims_look_at_few_leases(db, clock, monkeypatch):
    """Of a deep queue with thousands of claims out, what a claim looks at is what claims and answers put in its way."""
    from sparkmere.streaming import queue as queues

    db.execute("CREATE QUEUE deep")
    looked, lease = [0], queues._lease
    monkeypatch.setattr(queues, "_lease", lambda q, p: looked.__setitem__(0, looked[0] + 1) or lease(q, p))
    q, payloads = db.state["objects"]["deep"], type("P", (), {"read": lambda *_: b"", "append": lambda *_: None, "forget": lambda *_: None})()
    for _ in range(30_000):
        queues.enqueue(q, payloads, b"")
    most = 0
    for i in range(29_700):
        looked[0] = 0
        assert queues.claim(q, payloads, 10**9, 1000)[1] == i
        most = max(most, looked[0])
    for i in (29_000, 17, 400):
        queues.nack(q, i, 1)
    for expected in (17, 400, 29_000, 29_700):
        looked[0] = 0
        assert queues.claim(q, payloads, 50, 1000)[1:] == (expected, 1 if expected == 29_700 else 3)
        most = max(most, looked[0])
    assert [queues.claim(q, payloads, 50, 1050)[1] for _ in range(5)] == [17, 400, 29_000, 29_700, 29_701]
    assert most <= 62


def test_flush_gives_each_record_once(spark, tmp_path):
    """Not within a transaction, not what was rolled back, and whole after a crash between publishing and writing."""
    from sparkmere.streaming import reader

    path = str(tmp_path / "f")
    with Database.create(path, spark) as d:
        d.execute("CREATE STREAM s")
        d.append("s", "0")
        d.begin()
        d.append("s", "lost")
        with pytest.raises(EngineError):
            reader.flush(d, "s")
        d.rollback()
        d.append("s", "1")
        rename, d.catalog.store.rename_new = d.catalog.store.rename_new, lambda source, target: (_ for _ in ()).throw(KeyboardInterrupt) if source[0] == "_log" else rename(source, target)
        with pytest.raises(KeyboardInterrupt):
            reader.flush(d, "s")
        d.append("s", "2")
    with Database.open(path, spark) as d:
        folder = reader.flush(d, "s")
        reader.flush(d, "s")
        got = sorted((r[0], bytes(r[1])) for r in spark.read.schema("position long, payload binary").parquet(f"{folder}/*").collect())
        assert got == [(0, b"0"), (1, b"1"), (2, b"2")]
