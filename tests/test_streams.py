"""Streams over several triggers: state that ends, late rows, restarts, repeats and replayed batches."""

import time
from datetime import datetime, timedelta

import pytest

from tickwise.sources import io
from tickwise.sources.batches import append_batch, read_batches
from tickwise.streaming import jobs as st

DAY = datetime(2024, 1, 1)
ASKS = "key string, ts timestamp, request_id int"


def asks(spark, *rows):
    return spark.createDataFrame([(k, DAY + timedelta(seconds=s), i) for k, s, i in rows], ASKS)


def run(df, path, mode="append"):
    """Everything that is new, written as files under path; the checkpoint is beside them. The last rows of state."""
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    states = q.lastProgress.stateOperators if q.lastProgress else []
    return states[0].numRowsTotal if states else 0


def test_rate_limit_over_triggers(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    limited = lambda idle: st.rate_limit(spark.readStream.schema(ASKS).parquet(source), 2, idle=idle)
    key = lambda: {r.request_id: (r.allowed, r.wait_seconds, r.late) for r in spark.read.parquet(f"{out}/out").collect()}
    asks(spark, ("a", 0, 1), ("a", 20, 2), ("a", 30, 3), ("b", 100, 4)).coalesce(1).write.mode("append").parquet(source)
    run(limited("1 hour"), out)
    assert key() == {1: (True, 0, False), 2: (True, 0, False), 3: (False, 30, False), 4: (True, 0, False)}
    # The next trigger goes on from the state: 60 is free again, 70 is not; b's 30 is more than a minute behind its newest.
    asks(spark, ("a", 60, 5), ("a", 70, 6), ("b", 30, 7), ("b", 50, 8)).coalesce(1).write.mode("append").parquet(source)
    run(limited("1 hour"), out)
    got = key()
    assert (got[5], got[6], got[7], got[8]) == ((True, 0, False), (False, 10, False), (False, 0, True), (True, 0, False))


def test_rate_limit_forgets_idle_keys(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    limited = lambda: st.rate_limit(spark.readStream.schema(ASKS).parquet(source), 1, idle="2 seconds")
    asks(spark, ("idle", 1000, 1), ("busy", 0, 2)).coalesce(1).write.mode("append").parquet(source)
    asks(spark, *[(f"k{i}", 0, 100 + i) for i in range(9)]).coalesce(1).write.mode("append").parquet(source)
    held = run(limited(), out)
    time.sleep(3)
    # An older row of the idle key is not late: its newest time is forgotten. The other key's state is freed.
    asks(spark, ("idle", 0, 3)).coalesce(1).write.mode("append").parquet(source)
    run(limited(), out)
    time.sleep(3)
    asks(spark, ("new", 0, 4)).coalesce(1).write.mode("append").parquet(source)
    rows = run(limited(), out)
    assert rows < held
    assert {r.request_id: (r.allowed, r.late) for r in spark.read.parquet(f"{out}/out").where("request_id < 5").collect()} == {1: (True, False), 2: (True, False), 3: (True, False), 4: (True, False)}


RESULT = "item_id string, at timestamp, exact boolean, n int"


def test_results_resume_where_they_stopped(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = lambda *r: spark.createDataFrame([(i, DAY + timedelta(days=d), x, n) for i, d, x, n in r], RESULT)
    first = rows(("a", 0, None, 0), ("a", 1, True, 1), ("a", 1, False, 2), ("b", 2, None, 3))
    second = rows(("a", 400, True, 4), ("b", 3, False, 5), ("c", 500, True, 6))
    io.append_results(first, source, "one")
    run(st.watch_results(spark, source, RESULT), out)
    io.append_results(second, source, "two")
    run(st.watch_results(spark, source, RESULT), out)
    io.append_results(rows(("a", 900, True, 7), ("c", 1, True, 8)), source, "three")
    run(st.watch_results(spark, source, RESULT), out)
    run(st.watch_results(spark, source, RESULT), out)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{out}/out").select("item_id", "at", "exact", "n").collect())
    assert got == sorted(tuple(r) for r in st.stream_results(first.unionByName(second)).select("item_id", "at", "exact", "n").collect())
    assert [x[3] for x in got] == [2, 5, 6]


def test_live_progress(spark, tmp_path):
    path = f"{tmp_path}/table"
    session = lambda ended: spark.createDataFrame([(1, "k", "s", 1, 2, DAY, ended)], "session_id int, student_id string, score_id string, from_bar int, to_bar int, started_at timestamp, ended_at timestamp")
    tries = lambda *m: spark.createDataFrame([(1, DAY + timedelta(minutes=x), 60 + x, True) for x in m], "session_id int, at timestamp, bpm int, clean boolean")

    def step(attempts, sessions):
        attempts.coalesce(1).write.mode("append").parquet(f"{tmp_path}/a")
        sessions.coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
        live = lambda df, name: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}")
        for q in st.start_progress(live(attempts, "a"), live(sessions, "s"), path, f"{tmp_path}/check"):
            assert q.awaitTermination(60)
        best, late = st.live_progress(spark, path)
        return [(r.attempts, r.best_clean_bpm) for r in best.collect()], sorted(r.bpm for r in late.collect())

    assert step(tries(1, 9), session(None)) == ([(2, 69)], [])
    # The end of the session comes later: the attempt after it turns late.
    assert step(tries(2, -1), session(DAY + timedelta(minutes=5))) == ([(2, 62)], [59, 69])
    # A batch that is run again, as after a failure, changes nothing.
    before = sorted(map(str, read_batches(spark, f"{path}/attempts").collect()))
    batch = spark.read.parquet(f"{path}/attempts/batch=1")
    again = spark.createDataFrame(batch.collect(), batch.schema)
    append_batch(again, f"{path}/attempts", "1")
    assert sorted(map(str, read_batches(spark, f"{path}/attempts").collect())) == before


def test_batches_are_named(spark, tmp_path):
    with pytest.raises(ValueError):
        append_batch(spark.range(1), f"{tmp_path}/t", "../x")
