"""Language identification by nearest centroid.

A text is a vector of hashed byte trigrams of its lower-cased letters: 1 + log of the count, times
the inverse document frequency over all learning rows, of unit length. Each language has several
centroids from spherical k-means over a bounded sample of its texts; the largest cosine names the
language, and a cosine below what nearly all learning texts reach is reported as a rejection.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.common import checked_broadcast, map_batches, one_text_each, texts_of, with_fields

DIM = 4096
_NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def letters_of(text: str) -> str:
    """A text's lower-cased letters, words set apart by one space each."""
    letters = _NOT_LETTERS.sub(" ", text.lower()).strip()
    joined = letters.replace(" ", "")
    if joined and not joined.isalpha():
        # The pattern takes "²", "½" and "Ⅷ" for letters, but they are numbers; few texts have any.
        for c in set(joined):
            if not c.isalpha():
                letters = letters.replace(c, " ")
        letters = " ".join(letters.split())
    return letters


def counts_of(text: str) -> np.ndarray | None:
    """Trigram counts of a text's letters, words set apart by spaces; None without a letter."""
    letters = letters_of(text)
    if not letters:
        return None
    b = np.frombuffer(f" {letters} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def vector_of(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf).astype(np.float32)


def _document_frequency(rows: DataFrame) -> np.ndarray:
    """IDF by bucket over all the rows, from per-task sums."""

    def run(batches):
        total, n = np.zeros(DIM, dtype=np.int64), 0
        for batch in batches:
            for text in texts_of(batch):
                c = counts_of(text)
                if c is not None:
                    total += c > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1, dtype=np.int32)), pa.array(np.append(total, n))], names=["bucket", "n"])

    table = np.zeros(DIM + 1)
    for bucket, n in rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        table[bucket] = n
    return np.log((1 + table[DIM]) / (1 + table[:DIM])) + 1


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each further one the row least like those before."""
    centres = [_unit(x.mean(axis=0))]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[np.argmin((x @ np.array(centres).T).max(axis=1))])
    centres = np.array(centres)
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        centres = np.array([_unit(x[near == i].sum(axis=0)) if (near == i).any() else centres[i] for i in range(len(centres))])
    return centres


class Centroids:
    """Centroids, the language of each, and the cosine below which a language is rejected."""

    def __init__(self, idf: np.ndarray, centres: np.ndarray, languages: list[str], least: np.ndarray) -> None:
        self.idf, self.centres, self.languages, self.least = idf, centres, languages, least

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = []
        for begin in range(0, len(texts), 256):
            found = [counts_of(t) for t in texts[begin : begin + 256]]
            rows = [i for i, c in enumerate(found) if c is not None]
            part: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(found)
            if rows and self.languages:
                sims = vector_of(np.array([found[i] for i in rows]), self.idf) @ self.centres.T
                for i, best, s in zip(rows, sims.argmax(axis=1), sims.max(axis=1), strict=True):
                    part[i] = (self.languages[best], float(min(1.0, max(0.0, s))), bool(s < self.least[best]))
            out += part
        return out


def fit_languages(rows: DataFrame, *, per_language: int = 1000, clusters: int = 4, reject_share: float = 0.005) -> Centroids:
    """rows(doc_id, text, lang): document frequencies over all of them; centroids of at most per_language texts of each, by a hash of doc_id.

    Of rows that repeat a doc_id one text counts for the centroids; rows with null doc_id or lang are not learned from.
    """
    rows = rows.where("lang is not null and doc_id is not null")
    idf = _document_frequency(rows)
    shared = rows.sparkSession.sparkContext.broadcast(idf)
    # The per_language smallest hashes of each language: ids below twice the share that holds so many are ranked, no others.
    ids = rows.select("doc_id", "lang").withColumn("h", F.xxhash64("doc_id"))
    share = F.lit(2.0 * per_language) / F.greatest(F.col("n"), F.lit(1))
    least = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long"))
    bounds = checked_broadcast(ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).select("lang", least.alias("most")))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    near = ids.join(bounds, "lang").where("h <= most").select("doc_id", "lang", "h").distinct()
    picked = checked_broadcast(near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_language).select("doc_id", "lang"))
    sample = one_text_each(rows.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"]), ["doc_id", "lang"])

    def to_vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [counts_of(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([None if c is None else vector_of(c, shared.value).tobytes() for c in found], type=pa.binary())], names=["doc_id", "lang", "vector"])

    vectors = map_batches(sample, to_vectors, "doc_id long, lang string, vector binary").where("vector is not null")

    def cluster(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id"])
        x = np.frombuffer(b"".join(pdf.vector), dtype=np.float32).reshape(-1, DIM)
        centres = _cluster(x, clusters)
        best = (x @ centres.T).max(axis=1)
        return pd.DataFrame({"lang": pdf.lang.iloc[0], "at": range(len(centres)), "centre": [c.astype(np.float32).tobytes() for c in centres], "least": float(np.quantile(best, reject_share))})

    got = sorted(vectors.groupBy("lang").applyInPandas(cluster, "lang string, at int, centre binary, least double").collect(), key=lambda r: (r.lang, r["at"]))
    centres = np.array([np.frombuffer(r.centre, dtype=np.float32) for r in got]).reshape(-1, DIM)
    return Centroids(idf, centres, [r.lang for r in got], np.array([r.least for r in got]))


def language_ids(docs: DataFrame, learn_from: DataFrame, *, per_language: int = 1000, clusters: int = 4) -> DataFrame:
    """docs(doc_id, text, ...) -> the same columns, without clashes, plus lang_pred string, score double, rejected boolean.

    learn_from(doc_id, text, lang) are the learning rows; null lang or doc_id is ignored, and of rows that
    repeat a doc_id one text makes centroids. lang_pred is the
    language of the nearest centroid, `und` where the text is null or has no letter or nothing was
    learned; score is the cosine (0 for `und`); rejected says that the cosine is below that of nearly
    all learning texts of that language. Every input row gives one row; ties go to the language that
    sorts first. Input columns with these names are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score", "rejected")])
    shared = docs.sparkSession.sparkContext.broadcast(fit_languages(learn_from, per_language=per_language, clusters=clusters))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.predict(texts_of(batch))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64()), pa.array([f[2] for f in found], type=pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return map_batches(docs, run, with_fields(docs, "lang_pred string, score double, rejected boolean"))
