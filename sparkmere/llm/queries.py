"""Queries of the operators over the whole tables. ORACLES has SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, kdtree, langid, lsh_forest, packing, secrets, sharding, substring_bytes, substring_words
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "table", "tokenizer_path"]


#: Rows that travel to a Python worker at a time. Spark's default of 10,000 is meant for short rows; of texts it would be
#: tens of megabytes in each of several buffers of every task.
ROWS_PER_BATCH = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's batch size for texts, unless the application has set one below it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies; every executor has the package at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"] != "entropy")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return docs.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def op4_kd_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return kdtree.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_bytes.deduplicated(table(spark, sf_dir, "documents"), with_bytes=False)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packing.pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_prefix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return chat.read_back(*chat.prefix_trees(rows.unionByName(more)))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return docs.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op10_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_words.deduplicated(table(spark, sf_dir, "documents"), with_text=False)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_lsh_forest": op2_lsh_forest,
    "op3_secret_scan": op3_secret_scan,
    "op4_kd_trees": op4_kd_trees,
    "op5_suffix_array": op5_suffix_array,
    "op6_feistel_shards": op6_feistel_shards,
    "op7_best_fit": op7_best_fit,
    "op8_prefix_trees": op8_prefix_trees,
    "op9_winnowing": op9_winnowing,
    "op10_difference_cover": op10_difference_cover,
}
