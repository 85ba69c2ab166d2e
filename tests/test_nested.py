"""Bars that come nested: the same results as from a row an event, and nothing but the rows they are made of is shuffled."""

import pytest
from pyspark.sql import functions as F

from tickwise.operators import analytics as an
from tickwise.operators import exercises as ex
from tickwise.operators import scores as sc
from tickwise.plans import adapters as ad


@pytest.fixture(scope="module")
def made(spark):
    """Forty bars of three scores, some of them alike, and what the scores and requests of them are."""
    rows = [(s, n, i, 24 * i, 24, "8", False, False, d) for s in (1, 2, 3) for n in range(1, 41 if s == 1 else 12) for i in range(8) for d in [["kick"] * (i % 4 == 0) + ["snare"] * (i % (2 + n % 5) == 1) + ["tom_hi"] * ((i * n) % 11 == s)]]
    events = spark.createDataFrame(rows, "score_id long, bar_number int, event_idx int, onset_ticks int, duration_ticks int, written_duration string, dotted boolean, triplet boolean, drums array<string>").withColumn("is_rest", F.size("drums") == 0)
    scores = spark.createDataFrame([(1, 100), (2, 90)], "score_id long, tempo_bpm int")
    return events.cache(), sc.bar_events(events).cache(), scores


def _same(a, b):
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))



def test_near_repeats_are_those_of_all_pairs(made):
    events, nested, _ = made
    sets = {}
    for r in sc.bar_rows(events).select("score_id", "bar_number", "keys").orderBy("bar_number").collect():
        if r["keys"]:
            sets.setdefault((r.score_id, tuple(r["keys"])), r.bar_number)
    want = set()
    for (s, x), a in sets.items():
        for (o, y), b in sets.items():
            like = int(100 * len({*x} & {*y}) / len({*x} | {*y}) + 0.5) / 100
            if s == o and a < b and like >= 0.6:
                want.add((s, a, b, like))
    got = {tuple(r) for r in an.near_repeats(nested, 0.6).collect()}
    assert got == want and len(want) > 50
    assert {tuple(r) for r in an.near_repeats(events, 0.6).collect()} == want


def test_nested_bars_give_the_same_answers(made, spark):
    events, nested, scores = made
    kinds = ("explain-bar", "count-bar", "practice-plan", "find-complex", "find-repeats", "overview")
    asked = spark.createDataFrame([(f"{s}/{k}/{lo}", s, k, lo, hi) for s in (1, 2, 3, 4) for k in kinds for lo, hi in ((2, 3), (9, 14), (60, 61), (1, 90))], "request_id string, score_id long, question string, from_bar int, to_bar int")
    _same(an.offline_answers(events, scores, asked), an.offline_answers(nested, scores, asked))
    _same(an.overview(events, scores), an.overview(nested, scores))
    _same(an.inspect_bars(events, asked), an.inspect_bars(nested, asked))
    _same(an.exact_repeats(events), an.exact_repeats(nested))


def test_one_shuffle_brings_bars_together(spark, tmp_path):
    li = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"
    spark.createDataFrame([(k, 5, (k * 7 + n) % 9, n) for k in range(300) for n in range(1, 1 + k % 5)], li).write.parquet(str(tmp_path / "lineitem.parquet"))
    nested = ad.nested_events(spark, str(tmp_path))
    plan = lambda df: (df.write.format("noop").mode("overwrite"), df._jdf.queryExecution().executedPlan().toString())[1].count("Exchange hashpartitioning")
    assert plan(nested) == 1 and plan(sc.bar_rows(nested)) == 1 and plan(an.exact_repeats(nested)) == 1
    # Each side of the pairs is made of that one shuffle, without one of tokens.
    assert plan(an.near_repeats(nested)) <= 2
    _same(nested.select("score_id", "bar_number", F.inline("ev")), ad.events(spark, str(tmp_path)))


def test_corpus_near_patterns_meet_in_blocks(made):
    """Blocks of all sizes give what one block does, and no more rows than patterns leave a pair of blocks."""
    events, nested, _ = made
    sets = {r.pattern: set(r["keys"]) for r in an._patterns(events).select("pattern", "keys").distinct().collect()}
    like = {p: sorted((-int(100 * len(a & b) / len(a | b) + 0.5), q) for q, b in sets.items() if q != p) for p, a in sets.items()}
    want = {p: (sum(-s >= 60 for s, _ in x), x[0][1], -x[0][0] / 100) for p, x in like.items() if -x[0][0] >= 60}
    assert len(want) > 20
    for block in (7, 1000):
        assert {r.pattern: (r.n_near, r.nearest, r.similarity) for r in an.corpus_near_patterns(nested, 0.6, block).collect()} == want


def test_the_next_bar_to_check_is_the_one_ahead(spark):
    """Bars 1 and 50 are equally far from 44 where one number of fifty is missing, whatever the order of rows."""
    for numbers in (range(1, 51), range(50, 0, -1)):
        bars = spark.createDataFrame([(1, n, n not in (1, 50)) for n in numbers if n != 20], "score_id long, bar_number int, reviewed boolean").coalesce(1)
        assert [r.next_bar for r in sc.next_unreviewed(bars, spark.createDataFrame([(1, 44)], "score_id long, from_bar int")).collect()] == [50]


def test_fills_of_one_kind_meet_requests_by_their_first_ones(spark):
    """Fills that score alike for every request are told apart by id only, so three of each kind meet the requests; the result is that of all."""
    fills = [(f"f{i:03}", "fill", ("beginner", "intermediate")[i % 2], [["rock", "jazz"], ["jazz", "rock"], ["funk"]][i % 3], ("8th", "quarter")[i % 2], 60, 90 + i % 3, 120) for i in range(200)]
    catalogue = spark.createDataFrame(fills, "id string, kind string, level string, styles array<string>, subdivision string, tempo_min int, tempo_target int, tempo_max int")
    asked = [(i, 70 + 20 * i, "8th", ("beginner", "intermediate", "advanced")[i], ("rock", "funk")[i % 2]) for i in range(3)]
    got = ex.recommend_fills(spark.createDataFrame(asked, "request_id int, tempo_bpm int, subdivision string, level string, style string"), catalogue)
    near = {"beginner": ("beginner",), "intermediate": ("beginner", "intermediate"), "advanced": ("intermediate",)}
    want = set()
    for request, tempo, _, level, style in asked:
        best = sorted((-(100 * (style in f[3]) + max(0, 50 - abs(f[6] - tempo))), f[0]) for f in fills if f[2] in near[level])[:3]
        want |= {(request, i, -s, k) for k, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got.collect()} == want
    kept = got._jdf.queryExecution().optimizedPlan().toString()
    assert "place#" in kept and kept.index("Join") < kept.index("place#")
