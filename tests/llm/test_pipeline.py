import math

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmere.llm import langid, queries, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, ("en", "fr", None)[i % 3], "s", len(t or "")) for i, t in [*texts[0], (500, "my password: abcdefgh1234 and " + " ".join(texts[0][7][1].split()[::-1])), (602, "Широкая электрификация южных губерний")]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, texts[2]), (2, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages(spark, texts, folder, tmp_path):
    """Each stage against a plain version of it, over what its predecessor kept."""
    docs = queries.table(spark, folder, "documents")
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs_before = docs
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "best-fit packing":
            break
        assert docs.columns == COLUMNS
        if name == "language ID":
            expected = in_known_language(docs_before, held)
            assert 0 < len(expected) < sum(any(c.isalpha() for c in t or "") for t in held.values())
        elif name == "n-gram Jaccard join":
            classes = brute.near(list(held.items()))
            expected = {i: t for i, t in held.items() if classes[i][0] == i}
        elif name == "benchmark decontamination":
            hits = brute.contaminated(list(held.items()), [(1, texts[2])])
            expected = {i: t for i, t in held.items() if not hits[i][1]}
        else:
            expected = {i: secret_free(t) for i, t in held.items()}
            assert expected != held
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert got == expected, name
        assert docs.where("n_chars != char_length(text)").count() == 0 and len(got) < len(held) or name == "secret scans"
        held = got
    assert {r[0] for r in docs.select("doc_id").collect()} == set(held)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n > 2048 or n != end").count() == 0


def in_known_language(docs, held):
    """By sets of n-grams' places: nothing but letters, and shares of what the landmarks hold."""
    known, shares = set(langid.train(docs).places.tolist()), {}
    for i, t in held.items():
        row = np.zeros(langid.PLACES, bool)
        if langid.presence(t or "", row):
            mine = set(np.flatnonzero(row).tolist())
            shares[i] = len(mine & known) / len(mine)
    labelled = sorted(shares[r["doc_id"]] for r in docs.where("lang is not null").collect() if r["doc_id"] in shares)
    return {i: held[i] for i, share in shares.items() if share >= corpus_pipeline.KNOWN * labelled[math.ceil(len(labelled) / 1000) - 1]}


def test_stages_keep_columns_of_any_name(spark, folder):
    """Columns named like those that operators add, rows that repeat an id with an equal or another text, and no rows."""
    docs = queries.table(spark, folder, "documents")
    extra = docs.select("*", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in ("lang_pred", "LANG_SHARE", "lang_score", "n_words", "hit_spans", "items", "rep", "component", "rows", "mark", "a.b", "secret_spans")])
    row = extra.where("doc_id = 12")
    more = extra.unionByName(row).unionByName(row.withColumn("text", F.lit(" ".join(f"other{i}" for i in range(30)))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, folder)
        assert out.columns == more.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in more.columns[5:]), name
        if name == "n-gram Jaccard join":
            assert sum(r["doc_id"] == 12 for r in rows) == 2
        assert stage(spark, more.limit(0), folder).count() == 0


def secret_free(text):
    out, done = "", 0
    for s, _, e in secrets.Scanner().spans(text):
        if s >= done:
            out += text[done:s] + "[SECRET]"
        done = max(done, e)
    return out + text[done:]


def test_run_is_its_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 20


def test_without_labels_letters_decide(spark, folder):
    docs = queries.table(spark, folder, "documents").withColumn("lang", F.lit(None).cast("string"))
    assert langid.train(docs) is None
    kept = {r[0] for r in corpus_pipeline.keep_known_language(spark, docs, folder).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
