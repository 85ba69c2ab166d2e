"""Tables that grow by named batches: a batch that is written again replaces itself."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_batch(df: DataFrame, path: str, batch: str, file_format: str = "parquet") -> None:
    """Write df as the batch of that name under path. A retry, whole or after a failure, leaves one copy of its rows.

    The folder of a batch names it, so the log of batches is the table itself; nothing is read or locked.
    """
    if not re.fullmatch("[A-Za-z0-9_-]+", batch):
        raise ValueError(f"a batch is named by letters, digits, _ and -, not {batch!r}")
    df.write.mode("overwrite").format(file_format).save(f"{path}/batch={batch}")


def read_batches(spark: SparkSession, path: str, file_format: str = "parquet", schema: str | None = None) -> DataFrame:
    """All batches under path, with the column batch (text)."""
    reader = spark.read.format(file_format).option("basePath", path)
    df = (reader.schema(schema) if schema else reader).load(f"{path}/batch=*")
    return df.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "/batch=([^/]+)/", 1))
