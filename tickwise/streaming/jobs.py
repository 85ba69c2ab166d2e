"""Streaming jobs (ST1-ST5). Each works on a batch or a stream unless its text says otherwise.

usage(ts, key, request_id, model, input_tokens, output_tokens, error boolean).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tickwise.sources.batches import append_batch, read_batches

# Keyed state with an end needs a store that can forget.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_store(spark: SparkSession) -> None:
    """Streams of this session keep their state in RocksDB, unless another store is set."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, _STORE)


def monthly_spend(usage: DataFrame, prices: dict[str, tuple[float, float]], limit: float, watermark: str = "1 day") -> DataFrame:
    """ST1: by calendar month: cost, requests, tokens, and whether the limit is reached; an unknown model has the highest prices.

    prices: model -> US dollars for a million input and output tokens. On a stream, use update mode.
    """
    top = tuple(max(p[i] for p in prices.values()) for i in (0, 1))
    pair = [F.lit(top[i]) for i in (0, 1)]
    for model, p in prices.items():
        pair = [F.when(F.col("model") == model, p[i]).otherwise(pair[i]) for i in (0, 1)]
    rows = usage.withWatermark("ts", watermark) if usage.isStreaming else usage
    # Whole millionths of a dollar: sums do not depend on the order of rows.
    micros = F.round(F.col("input_tokens") * pair[0] + F.col("output_tokens") * pair[1]).cast("long")
    month = F.date_trunc("month", "ts")
    return rows.where(~F.col("error")).groupBy(month.alias("month")).agg(F.sum(micros).alias("spent_micros"), F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")).withColumn("over_limit", F.col("spent_micros") >= int(limit * 1e6))


def admit(times: list[int], asked: list[int], n: int, span: int = 60_000_000) -> tuple[list[bool], list[int], list[int]]:
    """ST2 for one key: times admitted so far and requests in order, in microseconds -> (allowed, wait seconds, times kept).

    A request is allowed where fewer than n were allowed in the span before it; refused ones do not count.
    """
    kept, allowed, waits = list(times), [], []
    for at in asked:
        kept = [t for t in kept if at - t < span]
        ok = len(kept) < n
        allowed.append(ok)
        waits.append(0 if ok else -(-(span - (at - kept[0])) // 1_000_000))
        if ok:
            kept.append(at)
    return allowed, waits, kept


def _micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


class _Limiter(StatefulProcessor):
    """Admission of one key's requests: the times admitted in the last span and the newest time seen, until the key is idle.

    Times are microseconds. The engine's clock is the arrival of rows, so no row is late to it; a timer at the
    last arrival and `idle` frees the state of a key that nothing comes for.
    """

    def __init__(self, n: int, delay: int, idle: int) -> None:
        self.n, self.delay, self.idle = n, delay, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("admitted", "newest long, arrived long, times array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        arrived = max(_micros(frame.arrived))
        newest, times = None, []
        if self.state.exists():
            before = self.state.get()
            if arrived - int(before[1]) < self.idle:
                newest, times = int(before[0]), [int(t) for t in before[2]]
        at = pd.Series(_micros(frame.ts), index=frame.index)
        late = pd.Series(False, index=frame.index) if newest is None else at < newest - self.delay
        on_time = frame[~late]
        ok, wait, kept = admit(times, at[~late].tolist(), self.n)
        self.state.update((int(max(at.max(), newest if newest is not None else at.max())), arrived, kept))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((arrived + self.idle) // 1000 + 1)
        out = pd.concat([on_time.assign(allowed=ok, wait_seconds=wait, late=False), frame[late].assign(allowed=False, wait_seconds=0, late=True)])
        yield out[["key", "ts", "request_id", "allowed", "wait_seconds", "late"]].astype({"allowed": bool, "late": bool, "wait_seconds": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit(requests: DataFrame, n: int, *, delay: str = "1 minute", idle: str = "1 hour") -> DataFrame:
    """ST2: requests(key, ts, request_id) -> allowed and wait_seconds. Admission depends on those before, so a key is read in order.

    Batch: partitions are dealt and sorted by key and time, and read as a stream with the state of one
    key, so a hot key costs one pass and no memory. Stream: rows of a trigger are taken in order of time; a
    row older than `delay` before the newest one that an earlier trigger saw of its key is refused and
    reported (late). A key for which nothing arrives for `idle` of processing time begins anew and its state is
    freed; that must be longer than the span and whatever the stream may lag behind. A batch has no late rows.
    """
    key = requests.schema["key"].dataType.simpleString()
    rid = requests.schema["request_id"].dataType.simpleString()
    schema = f"key {key}, ts timestamp, request_id {rid}, allowed boolean, wait_seconds long"
    cols = requests.select("key", "ts", "request_id")
    if requests.isStreaming:
        _with_store(requests.sparkSession)
        micros = lambda span: int(pd.Timedelta(span) / pd.Timedelta("1us"))
        arriving = cols.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", idle)
        return arriving.groupBy("key").transformWithStateInPandas(_Limiter(n, micros(delay), micros(idle)), T.StructType.fromDDL(f"{schema}, late boolean"), "Append", "EventTime")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, []
        for frame in frames:
            parts = []
            for k, part in frame.groupby("key", sort=False):
                if k != last:
                    last, kept = k, []
                ok, wait, kept = admit(kept, _micros(part.ts), n)
                parts.append(part.assign(allowed=ok, wait_seconds=wait))
            if parts:
                yield pd.concat(parts)

    return cols.repartition("key").sortWithinPartitions("key", "ts", "request_id").mapInPandas(run, schema)


def health(usage: DataFrame) -> DataFrame:
    """ST3: unknown, ok or problem by key, from the latest outcome; an error at the same time as a success is ok."""
    last = usage.groupBy("key").agg(F.max(F.when(F.col("error"), F.col("ts"))).alias("bad"), F.max(F.when(~F.col("error"), F.col("ts"))).alias("good"))
    return last.select("key", F.when(F.col("bad").isNull() & F.col("good").isNull(), "unknown").when(F.col("bad").isNotNull() & (F.col("good").isNull() | (F.col("bad") > F.col("good"))), "problem").otherwise("ok").alias("health"))


def stream_progress(attempts: DataFrame, sessions: DataFrame, watermark: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """ST4: attempts (a stream or a batch) joined to the table of sessions -> (best clean tempo and attempts by range, late attempts).

    Late: before the session began, or after it ended. On a stream, the first is for update mode, the second for append mode.
    """
    rows = attempts.withWatermark("at", watermark) if attempts.isStreaming else attempts
    both = rows.join(sessions.select("session_id", "student_id", "score_id", "from_bar", "to_bar", "started_at", "ended_at"), "session_id")
    late = (F.col("at") < F.col("started_at")) | F.coalesce(F.col("at") > F.col("ended_at"), F.lit(False))
    best = both.where(~late).groupBy("student_id", "score_id", "from_bar", "to_bar").agg(F.count(F.lit(1)).alias("attempts"), F.max(F.when(F.col("clean"), F.col("bpm"))).alias("best_clean_bpm"))
    return best, both.where(late).select("session_id", "at", "bpm", "clean")


def start_progress(attempts: DataFrame, sessions: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> tuple[StreamingQuery, StreamingQuery]:
    """ST4: keep a live table under path from a stream of attempts and one of sessions (a session may come again, with its end).

    Each trigger's rows are a batch of their own, named by its number: one that is run again replaces itself.
    """

    def keep(df: DataFrame, name: str) -> StreamingQuery:
        return df.writeStream.foreachBatch(lambda batch, number: append_batch(batch, f"{path}/{name}", str(number))).option("checkpointLocation", f"{checkpoint}/{name}").trigger(**(trigger or {"availableNow": True})).start()

    return keep(attempts, "attempts"), keep(sessions, "sessions")


def live_progress(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """ST4: (progress, late attempts) as of now. Of a session the newest batch counts, so an end that comes later makes the attempts after it late."""
    sessions = read_batches(spark, f"{path}/sessions")
    cols = [c for c in sessions.columns if c not in ("session_id", "batch")]
    newest = sessions.groupBy("session_id").agg(F.max_by(F.struct(*cols), F.struct(F.col("batch").cast("long").alias("batch"), F.col("ended_at").isNotNull().alias("ended"), "ended_at", F.xxhash64(*cols).alias("tie"))).alias("s")).select("session_id", "s.*")
    return stream_progress(read_batches(spark, f"{path}/attempts").drop("batch"), newest)


class _First(StatefulProcessor):
    """The first scored result of an item; whether it has been given is kept for good."""

    def __init__(self, cols: list[str]) -> None:
        self.cols = cols

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = handle.getValueState("given", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if self.given.exists():
            return
        first = pd.concat(frames).sort_values(["at", *[c for c in self.cols if c not in ("item_id", "at")]], na_position="first").head(1)
        self.given.update((first["at"].iloc[0].to_pydatetime(),))
        yield first[self.cols]

    def close(self) -> None:
        pass


def stream_results(results: DataFrame) -> DataFrame:
    """ST5: results(item_id, at, exact, ...) -> the first scored result of each item: the earliest, ties by the other columns.

    On a stream an item is given once, whenever it is repeated and however often the query is restarted
    from its checkpoint: what has been given stays in the state, a row an item of the run. The earliest is
    that of the trigger in which the item is scored first; rows that come later change nothing.
    """
    scored = results.where("exact is not null")
    cols = [c for c in scored.columns if c != "item_id"]
    if results.isStreaming:
        _with_store(results.sparkSession)
        order = ["item_id", *cols]
        return scored.select(*order).groupBy("item_id").transformWithStateInPandas(_First(order), scored.select(*order).schema, "Append", "None")
    return scored.groupBy("item_id").agg(F.min_by(F.struct(*cols), F.struct("at", *[c for c in cols if c != "at"])).alias("r")).select("item_id", "r.*")


def watch_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """ST5: the first scored results of the JSON lines that appear under path (as append_results writes them), as a stream."""
    return stream_results(spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(path))
