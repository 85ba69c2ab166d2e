"""One query for each training-data operator, over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm import token_store
from tickwise.llm.common import bucket_of, table
from tickwise.llm.decontam import hit_words, mark_contamination
from tickwise.llm.embed_dedup import embedding_duplicates
from tickwise.llm.langid import language_ids
from tickwise.llm.merkle import lowered, manifest
from tickwise.llm.near_dup import near_duplicates
from tickwise.llm.packing import pack
from tickwise.llm.phrases import collocations
from tickwise.llm.pii import KINDS, find_pii
from tickwise.llm.quality import quality_scores
from tickwise.llm.secrets import find_secrets
from tickwise.llm.sql import DECONTAM_SQL, URL_RULES, merkle_sql, phrases_sql, url_sql
from tickwise.llm.toxicity import toxicity_scores
from tickwise.llm.url_filter import judge_urls


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = table(spark, sf_dir, "labels").where(bucket_of("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    return quality_scores(docs, learned, threshold=0.3).select("doc_id", F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = table(spark, sf_dir, "labels").where(bucket_of("doc_id", 3) != 1).select("doc_id", F.col("toxic").alias("label"))
    return toxicity_scores(docs, learned, threshold=0.7).select("doc_id", F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def _span_digests(found: DataFrame, base: Column, spans: Column, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, the number of base spans of each kind, a hash of these, and all spans as text."""
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in kinds], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _span_digests(found, F.filter("secrets", lambda s: s["kind"] != "value"), F.col("secrets"), ("assign", "access", "hex"))


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), n=10)
    return marked.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = token_store.new_store(spark)
    manifest = token_store.write_tokens(table(spark, sf_dir, "documents"), root, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return token_store.read_tokens(manifest, root)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = docs.where(bucket_of("doc_id", 3) != 1).select("doc_id", "text", "lang")
    return language_ids(docs.select("doc_id", "text"), learned).select("doc_id", F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    forged = F.when(bucket_of("doc_id", 3) == 0, lowered(F.col("text")))
    return manifest(table(spark, sf_dir, "documents"), forged=forged).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _span_digests(found, F.filter("pii", lambda s: s["base"]), F.col("pii"), KINDS)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), support=100, most=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_toxicity, op3_secrets, op4_embed_dedup, op5_decontam, op6_packing, op7_token_store, op8_url_filter, op9_language, op10_near_dup, op11_merkle, op12_pii, op13_phrases)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontam": DECONTAM_SQL, "op8_url_filter": url_sql(), "op11_merkle": merkle_sql(), "op13_phrases": phrases_sql()}
