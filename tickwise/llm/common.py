"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests), a new local folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tickwise-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a table of the shared folder and read it, so that a lost executor costs no recomputation.

    Unlike a checkpoint, whose frame keeps the estimates of its plan (those of a chain of joins multiply
    until planning takes minutes), a table has the size of its files. The folder belongs to the job, as
    that of checkpoints does; whoever clears spark.checkpoint.dir removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, cut, with a broadcast hint only if it has no more rows than given (of a few numbers each); a larger one is shuffled."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_text_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row (keys, text) for each key, however often it repeats: the text of least hash."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text").alias("h"), "text")).alias("text"))


def bucket_of(key: str, buckets: int) -> Column:
    """crc32 of the key as text, mod buckets: the fold of a row."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % buckets


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """The frame's schema with further fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.RecordBatch], dict | None], schema: pa.Schema, ddl: str, sort: list[str] | None = None) -> DataFrame:
    """Deal rows by key, sort inside each partition and call fn once for each group.

    One Python call serves many groups of a batch, so millions of small groups stay cheap;
    a group that runs over a batch's end is carried into the next. Groups must be bounded.
    fn gets the group's rows and returns columns (name -> list or array) or None.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: dict[str, list] = {name: [] for name in schema.names}
        size = 0

        def edges(batch: pa.RecordBatch) -> np.ndarray:
            change = np.zeros(batch.num_rows, dtype=bool)
            for key in keys:
                x = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
                change[1:] |= x[1:] != x[:-1]
            return np.flatnonzero(change)

        def flush():
            nonlocal found, size
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if isinstance(v[0], np.ndarray) else [y for x in v for y in x], type=f.type) for f, v in zip(schema, found.values(), strict=True)], schema=schema)
            found, size = {name: [] for name in schema.names}, 0
            return out

        def take(group: pa.RecordBatch) -> None:
            nonlocal size
            got = fn(group)
            if got is not None and len(got[schema.names[0]]):
                size += len(got[schema.names[0]])
                for name in schema.names:
                    found[name].append(got[name])

        for batch in batches:
            if not batch.num_rows:
                continue
            joined = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch
            cuts = edges(joined)
            if not len(cuts):
                held = [joined]
                continue
            begin = 0
            for end in cuts:
                take(joined.slice(begin, end - begin))
                begin = end
            held = [joined.slice(begin)]
            if size > 50_000:
                yield flush()
        if held:
            take(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        if size:
            yield flush()

    dealt = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *(sort or []))
    return dealt.mapInArrow(run, ddl)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x if x is not None else "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
