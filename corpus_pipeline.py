"""The corpus pipeline: documents in, packed batches out, one written table between any two stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. SQL cannot express the stages, so run() is tested against brute force.

Every stage takes nulls in any column, empty and very long texts, repeated rows, and tables without
rows. The written folders stay where spark.checkpoint.dir is, so that a lost executor costs no stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm.common import bucket_of, shared_dir, table
from tickwise.llm.decontam import decontaminate
from tickwise.llm.near_dup import near_duplicates
from tickwise.llm.packing import pack
from tickwise.llm.quality import quality_scores
from tickwise.llm.secrets import redact_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null or empty text has the score of a text without words; repeated rows stay or go together.
    """
    learned = table(spark, sf_dir, "labels").where(bucket_of("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    return quality_scores(docs, learned, threshold=0.3).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more.

    Null and blank texts are copies of nothing. Of rows that repeat a doc_id and its text one stays, of
    rows without doc_id one for each text; a kept doc_id of several texts keeps them all.
    """
    kept = near_duplicates(docs, words=5, percent=80).where("kept").select("doc_id").distinct()
    # Rows that repeat a kept doc_id are copies of one document as well.
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window of ten words; null and empty texts have none and stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10, remove="documents").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and n_chars set anew; null texts stay null, with null n_chars."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in buckets and batches, by the tokens of a public tokenizer; a text without tokens has one row without a batch."""
    import public_tokenizers

    return pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder as Parquet and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
