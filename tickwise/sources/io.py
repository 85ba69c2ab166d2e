"""Readers and writers (IO1-IO8). Schemas are fixed; JSON texts that do not fit go to a side table with their problems (see intake)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.sources.batches import append_batch, read_batches
from tickwise.sources.intake import parse_labels, parse_scores

NOTE = "struct<event_id string, duration string, dotted boolean, triplet boolean, drums array<string>>"
SCORE = f"schema_version int, score_id string, revision int, title string, tempo_bpm int, meter struct<beats int, beat_unit int>, bars array<struct<bar_id string, provenance struct<source string, reviewed boolean, warnings array<string>, model string>, notes array<{NOTE}>>>"
MANIFEST = "split string, song string, source_song string, source_kind string, source_file string, bar_number int, image_path string, label_path string, source_label_path string"
RECONCILIATION = "reason string, song string, source_kind string, source_file string, bar_number int, source_label_path string, matched_pdf string, detected_crops string, source_labels string, packaged_song_bars int"
EXCLUSION = f"{MANIFEST}, reasons string"
CONSENT = "guardianConsent boolean, cloudHelp boolean, recordedAt string, recordedBy string"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO1: one JSON file a bar -> (labels with path and raw text, rejected with path, raw text and problem)."""
    return parse_labels(_documents(spark, path))


def read_csv(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """IO2: a headed CSV of fixed columns (MANIFEST, RECONCILIATION or EXCLUSION)."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, escape='"')


def write_csv(df: DataFrame, path: str, schema: str = MANIFEST) -> None:
    names = [c.split(" ")[0] for c in schema.split(", ")]
    df.select(*names).write.csv(path, header=True, escape='"', mode="overwrite")


def read_scores(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """IO3: score documents -> (scores, rejected with path, code, place and problem)."""
    return parse_scores(_documents(spark, path), version=version)


def hash_files(spark: SparkSession, path: str, most_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """IO4: path, length and SHA-256 of each file. Files up to most_bytes are hashed as one value, larger ones as a stream of 1 MB pieces."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= most_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))

    def streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for name in batch.column(0).to_pylist():
                fs, inner = pafs.FileSystem.from_uri(name)
                digest = hashlib.sha256()
                with fs.open_input_stream(inner) as source:
                    while piece := source.read(1 << 20):
                        digest.update(piece)
                hashes.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, type=pa.string())], names=["path", "length", "sha256"])

    large = files.where(F.col("length") > most_bytes).select("path", "length")
    return small.unionByName(large.mapInArrow(streamed, "path string, length long, sha256 string"))


_TIMES = ("started_at", "ended_at", "at", "created_at", "completed_at", "reset_at")


def read_practice(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """IO5: parquet tables of a practice store: ISO text -> timestamp, 0/1 -> boolean, consent JSON -> two booleans."""
    out = {}
    for name in ("students", "sessions", "attempts", "assignments", "resets"):
        df = spark.read.parquet(f"{path}/{name}")
        df = df.withColumns({c: F.try_to_timestamp(c) for c in _TIMES if c in df.columns and dict(df.dtypes)[c] == "string"})
        df = df.withColumns({c: F.col(c).cast("boolean") for c in ("clean", "completed") if c in df.columns})
        if "consent" in df.columns:
            df = df.withColumn("c", F.from_json("consent", CONSENT)).withColumns({"guardian_consent": F.coalesce("c.guardianConsent", F.lit(False)), "cloud_help": F.coalesce("c.cloudHelp", F.lit(False))}).drop("c", "consent")
        out[name] = df
    return out


def append_results(df: DataFrame, path: str, batch: str) -> None:
    """IO6: JSON lines, appended as a named batch: one that is written again (a retried job) is there once."""
    append_batch(df, path, batch, "json")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO6: the rows of all batches."""
    return read_batches(spark, path, "json", schema).drop("batch")


def write_report(df: DataFrame, path: str) -> None:
    """IO7: each row as one nested JSON document."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_subset(df: DataFrame, path: str) -> None:
    """IO8: parquet, a folder for each split; rows of a split are spread over tasks, so a large split is several files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
