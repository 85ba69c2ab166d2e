"""Packing: optimal length buckets and token-budget batches.

Texts are cut into pieces of at most max_len tokens. Dynamic programming over the global histogram of
piece lengths (max_len rows at most) chooses the bucket lengths that minimise padding. Inside a bucket,
pieces form batches whose padded size fits the token budget. Places inside a bucket come from counts of
many small shares and their running sums, so that no task sorts a whole bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.common import cut, map_batches, texts_of
from tickwise.llm.token_store import encoder


def optimal_buckets(histogram: dict[int, int], buckets: int) -> list[int]:
    """Bucket lengths, ascending, that minimise the padding of all pieces; the last is the longest length.

    cost[k][j]: least padding of the j shortest lengths in k buckets. Ties take the shorter bucket.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if n > 0 and c > 0), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    many, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    m, k = len(lengths), min(buckets, len(lengths))
    cost = np.full(m + 1, np.iinfo(np.int64).max // 4, dtype=np.int64)
    cost[0] = 0
    back = np.zeros((k, m + 1), dtype=np.int64)
    for b in range(k):
        new = np.full(m + 1, np.iinfo(np.int64).max // 4, dtype=np.int64)
        for j in range(b + 1, m + 1):
            i = np.arange(b, j)
            padded = cost[i] + lengths[j - 1] * (many[j] - many[i]) - (total[j] - total[i])
            best = int(np.argmin(padded))
            new[j], back[b, j] = padded[best], i[best]
        cost = new
    out, j = [], m
    for b in range(k - 1, -1, -1):
        out.append(int(lengths[j - 1]))
        j = int(back[b, j])
    return out[::-1]


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, t): the tokens of each whole text by a file of the tokenizers library, none for null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder(tokenizer).count(texts_of(batch)), type=pa.int64())], names=["doc_id", "t"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, t long")


def pack(docs: DataFrame, *, tokenizer: str | None = None, tokens: F.Column | None = None, max_len: int = 2048, buckets: int = 16, budget: int = 65_536, share: int = 50_000) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, piece, n_tokens, bucket_len, padding, batch, slot).

    Tokens are those of the tokenizer's file, or a column of counts. A document of t tokens gives
    ceil(t / max_len) pieces, all but the last full. batch is unique over
    all buckets; at most budget // bucket_len pieces share one, and slot is the place inside it; all
    batches of a bucket but the last are full. A document without tokens (null and blank texts) gives one
    row with n_tokens 0 and null bucket_len, padding, batch and slot. Rows that repeat, and those with
    null doc_id, are packed as often as they occur. Other columns are ignored, whatever their names.
    """
    if budget < max_len:
        raise ValueError("the budget must hold one piece of max_len tokens")
    if (tokenizer is None) == (tokens is None):
        raise ValueError("give a tokenizer's file or a column of counts")
    sized = count_tokens(docs, tokenizer) if tokens is None else docs.select("doc_id", tokens.cast("long").alias("t"))
    # Texts are read once; rows get numbers, so that repeats of a doc_id do not share a place.
    counted = cut(sized.withColumn("row", F.monotonically_increasing_id()))
    pieces = counted.select("doc_id", "row", "t", F.explode(F.expr(f"sequence(0L, greatest(ceil(t / {max_len}), 1L) - 1)")).alias("piece")).select("doc_id", "row", "piece", F.least(F.lit(max_len).cast("long"), F.col("t") - F.col("piece") * max_len).alias("n_tokens"))
    histogram = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # max_len + 1 rows at most
    bounds = optimal_buckets(histogram, buckets)
    shares = max(1, -(-sum(histogram.values()) // share))
    at = F.lit(None).cast("int")
    for i, bound in reversed(list(enumerate(bounds))):
        at = F.when(F.col("n_tokens") <= bound, F.lit(i)).otherwise(at)
    placed = pieces.withColumn("b", F.when(F.col("n_tokens") > 0, at)).withColumn("s", F.pmod(F.xxhash64("row", "piece"), F.lit(shares)))
    packed = placed.where("b is not null")
    before = packed.groupBy("b", "s").agg(F.count(F.lit(1)).alias("n")).select("b", "s", (F.sum("n").over(Window.partitionBy("b").orderBy("s")) - F.col("n")).alias("before"))
    # The share's running offset by an equi-join on (bucket, share): both sides are dealt alike for the window.
    ranked = packed.join(before, ["b", "s"]).withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("b", "s").orderBy("doc_id", "piece", "row")) - 1)
    lengths = F.array(*[F.lit(x).cast("long") for x in bounds]) if bounds else F.array(F.lit(None).cast("long"))
    bucket_len = F.element_at(lengths, F.col("b") + 1)
    room = F.floor(F.lit(budget) / bucket_len).cast("long")
    full = ranked.select("doc_id", "piece", "n_tokens", bucket_len.alias("bucket_len"), (bucket_len - F.col("n_tokens")).alias("padding"), (F.col("b").cast("long") * F.lit(1 << 40) + F.floor(F.col("place") / room)).cast("long").alias("batch"), (F.col("place") % room).cast("long").alias("slot"))
    empty = placed.where("b is null").select("doc_id", "piece", "n_tokens", *[F.lit(None).cast("long").alias(c) for c in ("bucket_len", "padding", "batch", "slot")])
    return full.unionByName(empty)
