"""From raw documents to packed token sequences, in five stages.

A stage takes the documents its predecessor kept and returns them, all columns, without what it
rejects or with what it changes; the last returns the packed pieces.  Each result is written as Parquet in the shared
folder and read again, so a lost executor costs at most one stage.
Rows without an id pass the filters like others and end before packing, which names pieces by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import exact, language, near, packing, secrets
from llm.queries import tokenizer
from llm.tables import documents
from pagescan.storage import Workspace


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a language go."""
    return language.with_language(docs, language.learn(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one document of equal texts stays."""
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each component stays."""
    return near.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: secrets are cut out of the texts; all documents stay."""
    docs = secrets.redact(docs)
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: every document's pieces and their places."""
    return packing.pack(packing.pieces(docs, tokenizer()))


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

# Signatures, statistical tests and a tokenizer decide here, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = documents(spark, sf_dir), Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return docs
