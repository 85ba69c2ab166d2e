"""Tables kept under a path in buckets of one key: rows are replaced or deleted by writing the touched buckets anew.

Only touched buckets are read and written; Spark swaps them in when the whole job has ended (dynamic
partition overwrite), so a job that fails or is run again leaves the table as it was, or as it should be. A bucket always
holds one row of nulls, so that one whose rows are all deleted is still written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, mode: str) -> None:
    df.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(path)


def _with_blanks(df: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    blanks = numbers.select("bucket", *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != "bucket"])
    return df.where(F.col(key).isNotNull()).unionByName(blanks)


def create(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A new table of df's rows that have a key, in buckets of it."""
    numbers = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    _write(_with_blanks(df.withColumn("bucket", _bucket(key, buckets)), numbers, key), path, "static")


def read(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col(key).isNotNull()).drop("bucket")


def _touched(spark: SparkSession, path: str, ids: DataFrame, key: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(the touched buckets' rows, their numbers); at most `buckets` numbers reach the driver."""
    found = [r.bucket for r in ids.where(F.col(key).isNotNull()).select(_bucket(key, buckets).alias("bucket")).distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(found)), spark.createDataFrame([(b,) for b in found], "bucket int")


def delete(spark: SparkSession, path: str, ids: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """Delete the rows of these keys; deleting them again changes nothing."""
    rows, numbers = _touched(spark, path, ids, key, buckets)
    _write(_with_blanks(rows.join(ids.select(key).distinct(), key, "left_anti"), numbers, key), path, "dynamic")


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, unique: list[str], newest: str, buckets: int = BUCKETS) -> None:
    """Put rows in: of those with equal `unique` columns (key is one of them) the one with the greatest `newest` stays, ties by the other columns."""
    rows, numbers = _touched(spark, path, new, key, buckets)
    both = rows.where(F.col(key).isNotNull()).unionByName(new.where(F.col(key).isNotNull()).withColumn("bucket", _bucket(key, buckets)))
    rest = [c for c in new.columns if c not in unique]
    kept = both.groupBy("bucket", *unique).agg(F.max_by(F.struct(*rest), F.struct(newest, *[c for c in rest if c != newest])).alias("r")).select("bucket", *unique, "r.*")
    _write(_with_blanks(kept, numbers, key), path, "dynamic")
