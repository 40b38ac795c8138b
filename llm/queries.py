"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bisector, bpe, dialogue, exact, fingerprints, harmonic, language, near, packing, quality, secrets, sharding, substrings
from llm.tables import bucket, documents

THRESHOLD = 0.3  # of op8's prediction


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove(documents(spark, folder))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edits(documents(spark, folder)).select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder), tokenizer())


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(documents(spark, folder)).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secrets.listing(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.listing(F.col("spans")).alias("spans"),
    )


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, folder), tokenizer()))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near.classes(documents(spark, folder))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.verdicts(documents(spark, folder))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = quality.classify(documents(spark, folder), labels, lambda i: bucket(i, 5) != 0)
    return scores.select(
        "doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = language.learn(docs.where(bucket(F.col("doc_id"), 4) != 2))
    found = language.identify(docs, model)
    return found.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(documents(spark, folder))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    repair = dialogue.Repair(dialogue.damage(rows))
    found = repair.summary().join(repair.digests().withColumnRenamed("conv_id", "_digested"), F.col("conv_id").eqNullSafe(F.col("_digested")), "left")
    every = rows.select(F.col("conv_id").cast("bigint").alias("_conv")).distinct()
    out = every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.col("_conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found = bisector.cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return harmonic.pack(documents(spark, folder), byte_tokenizer())


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_fingerprints, op3_bpe, op4_secrets, op5_packing, op6_near_dedup,
        op7_exact_dedup, op8_quality, op9_language, op10_sharding, op11_conversation_repair, op12_clusters, op13_harmonic_packing,
    )
}
