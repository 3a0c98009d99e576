import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with copies, near copies, shared passages, awkward characters, and empty, null and long ones."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abdegilmnorstuéß") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, item = prose(60), prose(25)
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "!!! ??? ..."), (4, prose(3)), (5, prose(9))]
    base = [prose(rng.randint(20, 200)) for _ in range(25)]
    for i, t in enumerate(base):
        out.append((10 + i, t))
    for i in range(12):  # copies and near copies
        w = base[i].split(" ")
        if i % 3:
            for _ in range(i % 3):
                w[rng.randrange(len(w))] = "CHANGED"
        out.append((100 + i, " ".join(w)))
        out.append((200 + i, base[i].upper() if i % 2 else base[i]))
    for i in range(8):
        out.append((300 + i, f"{prose(15)} {passage}\n{prose(15)}" + (f" {item}" if i % 2 else "")))
    out.append((400, "\n".join([prose(12)] * 30)))  # one line over and over
    out.append((401, "=" * 700 + prose(20) + "=" * 500))
    out.append((402, prose(6000)))
    out.append((403, "x" * 6000 + passage))
    out.append((404, "日本語のテキスト " * 40 + "\x1f\x85 é " + passage[:150]))
    return out, passage, item


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same as a table with columns whose names operators use themselves."""
    rows = [(i, t, "x", "s", len(t or ""), 7, "mine", True, b"m") for i, t in texts[0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, N_WORDS int, lang_pred string, found boolean, mark binary"
    return spark.createDataFrame(rows, schema).repartition(3)
