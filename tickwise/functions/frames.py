"""Frame helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df, whose columns are found once, however often later steps use them.

    The optimizer writes a column's expression anew into each filter and projection over it, so that a
    costly one runs several times and a chain of them grows without bound; it does not do so behind a
    generator. No shuffle.
    """
    return df.select(F.inline(F.array(F.struct("*"))))


def in_ranges(rows: DataFrame, ranges: DataFrame, keys: list[str], at: str, lo: str, hi: str, width: int = 16) -> DataFrame:
    """rows joined to the ranges of their keys that hold rows' place `at` (lo to hi, both included).

    Both sides meet by keys and bucket of `width` places, a range in each bucket that it reaches: the pairs
    compared are those of the result and of a bucket at each end, whatever the number of rows and ranges of
    a key, and a key with many rows is dealt over many partitions. Nulls, and ranges that end before they begin, meet nothing.
    """
    dealt = ranges.where(F.col(lo) <= F.col(hi)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    placed = rows.withColumn("_bucket", F.floor(F.col(at) / width))
    return placed.join(dealt, [*keys, "_bucket"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_bucket")
