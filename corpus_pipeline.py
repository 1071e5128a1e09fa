"""The corpus pipeline: documents in, token sequences out.

Each stage reads all that its predecessor kept, written as Parquet and read again. The stages but
the last return the columns of ``documents``. ``run`` applies all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import language, leaks, packing, personal, simhash
from shelfwise.llm.common import fold, prepare, shared_folder, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SEQUENCE_TOKENS = 4096


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents it rejects go. Models learn from two thirds of the stage's documents."""
    prepare(spark)
    model = language.trained_and_calibrated(docs.where(fold(F.col("doc_id"), 3) != 1), F.col("doc_id"))
    return language.identify(docs, model).where("accepted").select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group the document with the smallest id stays; a document without
    an id stays. Rows that share the id that stays count as one document."""
    groups = simhash.near_duplicates(docs, width=3, bits=2)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: rows that hold a test item go, with or without an id; a clean row
    that shares the id of one stays."""
    key = f"row_{uuid.uuid4().hex}"
    # Written, so that the keys are the same when rows are removed.
    rows = staged(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col(key).alias("doc_id"), "text")
    found = leaks.leaked(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(found, key, "left_anti").select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span found is replaced by its kind; no document goes."""
    return personal.redacted(docs, personal.default_model())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of the documents' tokens into sequences."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed_documents(docs, vocabulary, 1, SEQUENCE_TOKENS)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identified),
    ("SimHash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("PII", redacted),
    ("best-fit packing", packed),
]

# Learned models, alignment and packing are not SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    folder = f"{shared_folder(spark)}/shelfwise-pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
