"""A pipeline over documents made of the operators: STAGES lists its steps, run() applies them to the table.

Every stage but the last returns the columns that it got, whatever their names: an input column named like one that an
operator adds is set aside while the operator runs. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmere.llm import decontaminate, langid, lsh_forest, packing, secrets
from sparkmere.llm.common import probable_members, written
from sparkmere.llm.queries import bound_batches, table, tokenizer_path

#: Language ID rejects texts whose share of known n-grams is below this part of the share that all but one in a thousand
#: labelled documents reach.
KNOWN = 2 / 3


def annotated(docs: DataFrame, adds: list[str], operator: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list]:
    """operator(docs), in which columns named like those it adds are set aside, and the columns that bring docs back."""
    taken = {n.lower() for n in adds}
    names = {c: f"__own{i}__" if c.lower() in taken else c for i, c in enumerate(docs.columns)}
    found = operator(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return found, [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier has learnt. It rejects texts that are null or without a letter, and those
    of whose n-grams its landmarks know too few: below KNOWN of what labelled documents reach. Without any label to learn
    from, the letters alone decide. Repeated rows are judged each; null ids and labels stay with their row."""
    bound_batches(spark)
    model = langid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found, back = annotated(docs, ["lang_pred", "lang_score", "lang_share"], lambda d: langid.predict(d, model))
    found = written(found)
    told = found.where(F.col("lang_pred") != langid.UNKNOWN)
    usual = told.where(F.col("lang").isNotNull()).agg(F.percentile_approx("lang_share", F.lit(0.001), F.lit(100_000))).first()[0]
    return told.where(F.col("lang_share") >= KNOWN * (usual or 0.0)).select(*back)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-gram Jaccard similarity of 0.8 or more the one with the smallest id. Of rows
    that repeat id and text one stays; an id with several texts is one document and stays or goes with all. Documents without
    id stay, as do texts without a word. Only the texts that may go are shuffled."""
    classes = lsh_forest.near_duplicates(docs)
    gone = written(classes.where("doc_id != class_id").select("doc_id").distinct())
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    names = {c: f"__c{i}__" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)}
    may, clear = probable_members(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), gone.unionByName(repeated), ["doc_id"])
    stay = may.where("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*may.columns)
    kept = clear.unionByName(may.where("doc_id is null")).unionByName(stay)
    return kept.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts stay, repeated rows are judged each."""
    found, back = annotated(docs, ["n_words", "hit_spans", "items"], lambda d: decontaminate.decontaminate(d, table(spark, sf_dir, "benchmark")))
    return found.where(F.size("hit_spans") == 0).select(*back)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark for each secret; n_chars follows the text. Null and empty texts stay as they are."""
    return secrets.redact(docs, chars="n_chars" if "n_chars" in docs.columns else None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of 2048 tokens. A null text is empty; repeated rows and
    null ids are packed each. Other columns aren't carried."""
    found = packing.pieces(docs, tokenizer_path("word_bpe_49k.json"))
    return packing.pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", keep_known_language),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]
#: The tokenizer's ids and the trained classifier are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
