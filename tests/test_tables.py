"""Range joins by buckets, tables kept in buckets, and the reconciliation report, against plain readings."""

import random

from pyspark.sql import functions as F

from tickwise.functions.frames import in_ranges, settled
from tickwise.operators import manifest as mf
from tickwise.sources import tables


def test_in_ranges_equals_all_pairs(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.6 else f"s{r.randrange(4)}", r.choice([None, *range(1, 90)])) for _ in range(300)]
    asked = [(i, r.choice(["hot", "s0", "s1", "none", None]), r.choice([None, *range(-3, 95)]), r.choice([None, *range(-3, 400)])) for i in range(60)]
    left, right = spark.createDataFrame(rows, "score_id string, bar_number int"), spark.createDataFrame(asked, "q int, score_id string, lo int, hi int")
    want = sorted((q, s, b) for s, b in rows for q, k, lo, hi in asked if b is not None and s == k and lo is not None and hi is not None and lo <= b <= hi)
    for width in (1, 16, 1000):
        got = in_ranges(left, right, ["score_id"], "bar_number", "lo", "hi", width)
        assert sorted((x.q, x.score_id, x.bar_number) for x in got.collect()) == want


def test_pairs_compared_follow_the_result(spark):
    bars = spark.range(2000).select(F.lit("s").alias("score_id"), F.col("id").alias("bar_number"))
    asked = spark.range(2000).select(F.col("id").alias("q"), F.lit("s").alias("score_id"), F.col("id").alias("lo"), (F.col("id") + 3).alias("hi"))
    met = in_ranges(bars.withColumn("_n", F.lit(1)), asked, ["score_id"], "bar_number", "lo", "hi")
    assert met.count() == sum(min(1999, i + 3) - i + 1 for i in range(2000))
    # What the join compares before the places are: at most 2 buckets of 16 bars a request, not 2,000 bars.
    width = 16
    pairs = bars.withColumn("b", F.floor(F.col("bar_number") / width)).join(asked.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)))), ["score_id", "b"]).count()
    assert pairs <= 2000 * 2 * width


def test_settled_keeps_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "a int, b string")
    assert sorted(map(str, settled(df).collect())) == sorted(map(str, df.collect())) and settled(df).schema == df.schema


def test_kept_tables(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(f"k{i % 7}", i, i * 10) for i in range(40)]
    make = lambda r: spark.createDataFrame(r, "k string, id int, v int")
    now = lambda: sorted(tuple(r) for r in tables.read(spark, path, "k").collect())
    tables.create(make([*rows, (None, 99, 0)]), path, "k", 3)
    assert now() == sorted(rows)
    # All keys of a bucket go at once, and again, and one that never was.
    for _ in range(2):
        tables.delete(spark, path, make([(f"k{i}", 0, 0) for i in range(5)] + [("other", 0, 0), (None, 0, 0)]), "k", 3)
        assert now() == sorted(r for r in rows if r[0] in ("k5", "k6"))
    new = [("k5", 5, 1), ("k5", 12, 999), ("k9", 1, 1), ("k9", 1, 2), (None, 1, 1)]
    for _ in range(2):
        tables.upsert(spark, path, make(new), "k", ["k", "id"], "v", 3)
        want = {(k, i): v for k, i, v in rows if k in ("k5", "k6")}
        for k, i, v in new:
            if k is not None:
                want[k, i] = max(v, want.get((k, i), v))
        assert now() == sorted((k, i, v) for (k, i), v in want.items())
    tables.delete(spark, path, tables.read(spark, path, "k"), "k", 3)
    assert now() == []
    tables.upsert(spark, path, make(rows[:2]), "k", ["k", "id"], "v", 3)
    assert now() == sorted(rows[:2])


def test_reconciliation_report(spark):
    raw = spark.createDataFrame([("a", b) for b in range(1, 6)] + [("b", 1), ("c", 1)], "song string, bar int")
    packaged = spark.createDataFrame([("a", 1, "train"), ("a", 2, "train"), ("d", 1, "test")], "song string, bar int, split string")
    audits = spark.createDataFrame([("a", 4, 5, False), ("b", 1, 1, True), ("b", 2, 1, False)], "song string, crops int, labels int, matches boolean")
    got = {(r.kind, r["name"]): (r.bars, r.songs, r.packaged_bars, r.reason, r.crop_audit) for r in mf.reconciliation_report(mf.reconcile(raw, packaged.select("song", "bar"), audits), packaged, audits).collect()}
    assert got == {
        ("reason", "packaged_dataset_incomplete_crop_mismatch"): (3, 1, None, None, None),
        ("reason", "ambiguous_pdf_match"): (1, 1, None, None, None),
        ("reason", "no_matching_pdf"): (1, 1, None, None, None),
        ("song", "a"): (3, 1, 2, "packaged_dataset_incomplete_crop_mismatch", "4 crops / 5 labels"),
        ("song", "b"): (1, 1, 0, "ambiguous_pdf_match", "no unique match"),
        ("song", "c"): (1, 1, 0, "no_matching_pdf", "no unique match"),
        ("split", "train"): (2, 1, None, None, None),
        ("split", "test"): (1, 1, None, None, None),
    }
