"""Score analytics on the ten-bar song with hand-counted answers."""

import pytest
from pyspark.sql import functions as F

from tickwise.operators import analytics as an
from tickwise.operators import exercises as ex
from tickwise.operators import playback as pb
from tickwise.operators import scores as sc

HH = "hi_hat_closed"


def n(duration, *drums, dotted=False, triplet=False):
    return (duration, dotted, triplet, list(drums))


GROOVE = [n("8", "kick", HH), n("8", HH), n("8", "snare", HH), n("8", HH), n("8", "kick", HH), n("8", HH), n("8", "snare", HH), n("8", HH)]
VARIANT = [*GROOVE[:5], n("8", "kick", HH), *GROOVE[6:]]
BUSY = [n("16", *(d for d in (extra, HH) if d)) for extra in ("kick", "", "", "kick", "snare", "", "kick", "", "", "kick", "", "", "snare", "", "kick", "kick")]
FILL = [n("16", d) for d in ["snare"] * 4 + ["tom_hi"] * 4 + ["tom_mid"] * 4 + ["floor_tom_1", "floor_tom_1", "kick", "floor_tom_1"]]
CRASH = [n("8", "kick", "crash"), *GROOVE[1:]]
TRIPLETS = [n("8", "snare", triplet=True), n("8", "snare", triplet=True), n("8", "kick", triplet=True), n("q"), n("q", "snare", dotted=True), n("8", "kick")]
SONG = [GROOVE, GROOVE, GROOVE, GROOVE, VARIANT, GROOVE, BUSY, FILL, CRASH, TRIPLETS]
SCORE = "score_id string, revision int, title string, tempo_bpm int, meter struct<beats int, beat_unit int>, bars array<struct<bar_id string, provenance struct<source string, reviewed boolean, warnings array<string>, model string>, notes array<struct<event_id string, duration string, dotted boolean, triplet boolean, drums array<string>>>>>"


def document(score_id="s", bars=SONG, tempo=100, **kw):
    rows = []
    for i, bar in enumerate(bars):
        notes = [(f"e{i}-{j}", d, dot, tri, drums) for j, (d, dot, tri, drums) in enumerate(bar)]
        rows.append((f"b{i + 1}", ("local_omr", i != 9, ["w"] if i == 9 else [], None), notes))
    return {"score_id": score_id, "revision": 1, "title": "t", "tempo_bpm": tempo, "meter": (4, 4), "bars": rows} | kw


@pytest.fixture(scope="module")
def song(spark):
    scores = spark.createDataFrame([tuple(document().values())], SCORE)
    events = sc.score_events(scores).persist()
    bars = scores.select("score_id", F.posexplode("bars").alias("i", "b")).select("score_id", (F.col("i") + 1).alias("bar_number"), "b.bar_id", F.col("b.provenance.reviewed").alias("reviewed"), F.size("b.provenance.warnings").alias("warning_count"))
    return scores, events, bars


def test_events_and_validation(spark, song):
    scores, events, _ = song
    ten = events.where("bar_number = 10").orderBy("event_idx").collect()
    assert [r.onset_ticks for r in ten] == [0, 16, 32, 48, 96, 168] and [r.duration_ticks for r in ten] == [16, 16, 16, 48, 72, 24]
    assert sc.validate_events(events).count() == 0 and sc.validate_scores(scores).count() == 0
    assert {r.state for r in sc.bar_fill(events).collect()} == {"full"}
    broken = document("x y", [[n("8", HH, HH), n("32", "cowbell", dotted=True), n("5")], [n("8", "kick", triplet=True)], [n("w"), n("q")]], tempo=5)
    problems = {r.problem for r in sc.validate_scores(spark.createDataFrame([tuple(broken.values())], SCORE)).collect()}
    assert {"score id is not 1-64 letters, digits, - or _", "tempo is not 20-300", "a drum repeats", "unknown drum", "unknown duration", "a dotted 32nd is not supported"} <= problems
    timing = document("ok", [[n("8", "kick", triplet=True)], [n("w"), n("q")]])
    assert {r.problem for r in sc.validate_scores(spark.createDataFrame([tuple(timing.values())], SCORE)).collect()} == {"a triplet note is outside a group of three", "notes overfill the bar"}
    moved = events.withColumn("onset_ticks", F.col("onset_ticks") + F.when(F.col("bar_number") == 3, 1).otherwise(0)).where("bar_number <> 5")
    assert {r.problem for r in sc.validate_events(moved).collect()} == {"onset does not follow the events before", "bar numbers do not run on"}


def test_overview(song):
    scores, events, _ = song
    o = an.overview(events, scores).first()
    assert (o.total_bars, o.duration_seconds, o.chords, o.rests, o.triplet_groups, o.drum_hits) == (10, 24.0, 37, 1, 1, 130)
    assert (o.smallest_note, o.smallest_bars, o.empty_bars, o.incomplete_bars) == ("16th", "7,8", "", "")
    assert o.drums_used.startswith("hi_hat_closed:71,kick:24,snare:23")


def test_inspect_counting_and_comparison(spark, song):
    _, events, _ = song
    rows = {r.bar_number: r for r in an.inspect_bars(events).collect()}
    assert rows[4].counting == "1 & 2 & 3 & 4 &" and rows[10].counting == "1 trip let (2) 3 4&"
    assert (rows[5].added, rows[5].removed, rows[1].added) == ("kick on 3&", "", None)
    asked = spark.createDataFrame([("r", "s", 9, 12)], "request_id string, score_id string, from_bar int, to_bar int")
    assert [(r.bar_number, r.missing) for r in an.inspect_bars(events, asked).orderBy("bar_number").collect()] == [(9, False), (10, False), (11, True), (12, True)]
    pairs = spark.createDataFrame([("s", 5, 7), ("s", 7, 5), ("s", 1, 2)], "score_id string, bar_a int, bar_b int")
    got = {(r.bar_a, r.bar_b): r for r in an.compare_passages(events, pairs).collect()}
    a, b = got[5, 7], got[7, 5]
    assert a.similarity == b.similarity and a.added == b.removed and a.removed == b.added and a.density_delta == -b.density_delta and a.subdivision_changed
    assert got[1, 2].similarity == 1 and got[1, 2].added == ""
    assert [r.line for r in sc.describe_bars(events).where("bar_number = 10").collect()] == ["Bar 10: 5 notes - snare, kick"]


def test_repeats(song):
    _, events, _ = song
    assert [r.bars for r in an.exact_repeats(events).collect()] == ["1,2,3,4,6"]
    near = {(r.bar_a, r.bar_b): r.similarity for r in an.near_repeats(events).collect()}
    assert near[1, 5] == 0.92 and not any(8 in k for k in near)
    assert an.near_repeats(events, 0.95).count() == 0
    shared = an.corpus_patterns(events.unionByName(events.withColumn("score_id", F.lit("t")))).collect()
    assert {(r.n_bars, r.n_scores) for r in shared} == {(10, 2), (2, 2)}


def test_fills_complexity_and_plan(spark, song):
    scores, events, bars = song
    (fill,) = an.fill_candidates(events).collect()
    assert fill.bar_number == 8 and fill.score >= 0.8
    assert "toms" in fill.reasons and "crash on beat 1 of bar 9" in fill.reasons and "no hi-hat" in fill.reasons
    ranked = an.complexity(events, scores)
    rows = ranked.orderBy("rank").collect()
    assert [r.bar_number for r in rows[:3]] == [7, 8, 10] and "including triplets" in rows[2].reasons
    score = {r.bar_number: r.score for r in rows}
    assert score[1] == score[2] < score[10]
    top = max(an.complex_passages(ranked).collect(), key=lambda r: r.score)
    assert (top.from_bar, top.to_bar, top.score) == (7, 8, score[7])
    asked = spark.createDataFrame([("r", "s", 7, 8), ("q", "s", 30, 31)], "request_id string, score_id string, from_bar int, to_bar int")
    plan = an.practice_plan(events, scores, asked).orderBy("step").collect()
    assert [r.bpm for r in plan] == [None, 60, 80, 80, 100] and {r.request_id for r in plan} == {"r"}
    assert "1 e & a" in plan[0].instruction
    kinds = {r.kind for r in an.insights(events, scores, bars).collect()}
    assert kinds == {"overview", "complex", "repeats", "near", "fills", "review"}
    questions = spark.createDataFrame([(q, "s", q, 4, 5) for q in ("explain-bar", "count-bar", "practice-plan", "find-complex", "find-repeats", "overview")] + [("gone", "s", "explain-bar", 40, 41)], "request_id string, score_id string, question string, from_bar int, to_bar int")
    said = {r.request_id: r for r in an.offline_answers(events, scores, questions).collect()}
    assert said["gone"].abstained and not said["explain-bar"].abstained
    assert said["explain-bar"].answer == "Bar 4 has 8 hits, the shortest note is a 8th. Bar 5 adds kick on 3&."
    assert said["find-repeats"].cited == "1-6,9-9" and "% the same as bar" in said["find-repeats"].answer and ": " in said["find-complex"].answer and "mostly uses" in said["overview"].answer and said["find-complex"].cited.startswith("7-8") and "about 24 seconds" in said["overview"].answer


def test_review_slices_and_citations(spark, song):
    scores, events, bars = song
    r = sc.review_summary(bars).first()
    assert (r.unreviewed, r.total, r.warnings, r.bars) == (1, 10, 1, "10")
    at = spark.createDataFrame([("s", 3), ("s", 10)], "score_id string, from_bar int")
    assert {(r.from_bar, r.next_bar) for r in sc.next_unreviewed(bars, at).collect()} == {(3, 10), (10, 10)}
    asked = spark.createDataFrame([("r", "s", 12, 9)], "request_id string, score_id string, from_bar int, to_bar int")
    part = sc.slice_bars(events, asked).select("bar_number", "truncated").distinct().orderBy("bar_number").collect()
    assert [tuple(x) for x in part] == [(9, True), (10, True)]
    cited = spark.createDataFrame([(1, "s", 1, "b3", "b2"), (2, "s", 0, "b1", "b1"), (3, "s", 1, "b1", "zz"), (4, "t", 1, "b1", "b1")], "citation_id int, score_id string, revision int, from_bar_id string, to_bar_id string")
    got = {r.citation_id: (r.status, r.from_bar, r.to_bar) for r in an.resolve_citations(cited, scores, bars).collect()}
    assert got == {1: ("ok", 2, 3), 2: ("score has changed", None, None), 3: ("bars are gone", None, None), 4: ("unknown score", None, None)}
    assert sc.score_hash(events).first().content_hash == sc.score_hash(events.repartition(3)).first().content_hash


REQUEST = "request_id string, score_id string, from_bar int, to_bar int, tempo_bpm int, count_in_beats int, loop boolean, metronome boolean"


def test_playback(spark, song):
    _, events, _ = song
    q = spark.createDataFrame([("r", "s", 10, 10, 120, 0, True, True), ("c", "s", 10, 10, 120, 4, False, False)], REQUEST)
    hits = pb.playback_hits(events, q)
    times = [round(r.time, 6) for r in hits.where("request_id = 'r'").orderBy("time").collect()]
    assert times == [0, 0.166667, 0.333333, 1.0, 1.75]
    assert min(r.time for r in hits.where("request_id = 'c'").collect()) == 2.0
    assert pb.playback_clicks(q).groupBy("request_id", "count_in").count().count() == 2
    windows = spark.createDataFrame([("r", 1.9, 4.1, True), ("c", 0.0, 2.1, False)], "request_id string, from_s double, to_s double, loop boolean")
    between = sorted((r.request_id, round(r.time, 3), r["pass"]) for r in pb.events_between(hits, q, windows).collect())
    assert between == [("c", 2.0, 0), ("r", 2.0, 1), ("r", 2.167, 1), ("r", 2.333, 1), ("r", 3.0, 1), ("r", 3.75, 1), ("r", 4.0, 2)]
    probes = spark.createDataFrame([("r", 0.17), ("r", 2.5), ("c", 1.0), ("c", 3.9), ("c", 4.0)], "request_id string, probe_s double")
    got = {(r.request_id, r.probe_s): (r.bar_number, r.event_idx, r["pass"]) for r in pb.position_at(events, q, probes).collect()}
    assert got == {("r", 0.17): (10, 1, 0), ("r", 2.5): (10, 3, 1), ("c", 3.9): (10, 5, 0)}
    midi = pb.midi_events(events.where("bar_number = 1")).orderBy("time", "kind", "note").collect()
    assert [(r.time, r.kind, r.note) for r in midi[:4]] == [(0, 1, 36), (0, 1, 42), (239, 0, 36), (239, 0, 42)]
    assert sum(r.delta for r in midi) == midi[-1].time


def note(position, duration, *drums):
    return {"position": position, "duration": duration, "drums": list(drums)}


def bars_of(spark, cases):
    """item -> its bar, for lists of predicted notes."""
    rows = [(i, n["position"], n["duration"], n["drums"]) for i, notes in enumerate(cases) for n in notes]
    return {r.item_id: r for r in pb.bars_from_predictions(spark.createDataFrame(rows, "item_id int, position int, duration string, drums array<string>")).collect()}


def test_bars_from_predictions(spark):
    cases = [
        ([note(0, "quarter", "kick"), note(16, "half", "snare")], ["q kick", "q", "h snare"], []),
        ([note(0, "half", "kick"), note(8, "quarter", "snare")], ["q kick", "q snare", "h"], ["shortened"]),
        ([note(24, "half", "crash")], ["h", "q", "q crash"], ["shortened"]),
        ([note(0, "dotted_quarter", "kick"), note(12, "eighth", "snare")], ["q. kick", "8 snare", "h"], []),
        ([note(0, "triplet_eighth", "kick"), note(5, "triplet_eighth", HH)], ["8t kick", "8t", f"8t {HH}", "h", "q"], []),
        ([note(8, "triplet_sixteenth", "snare"), note(9, "triplet_sixteenth", "snare"), note(11, "triplet_sixteenth", "snare")], ["q", "16t snare", "16t snare", "16t snare", "h", "8"], []),
        ([note(0, "triplet_eighth", "kick"), note(1, "triplet_eighth", "snare"), note(2, "sixteenth", HH)], ["8t kick snare", f"8t {HH}", "8t", "h", "q"], ["merged_into_chord", "merged_into_triplet"]),
        ([note(0, "dotted_quarter", "kick"), note(13, "triplet_eighth", "snare")], ["q. kick", "32", "8 snare", "q", "8", "16", "32"], ["triplet_unplaced"]),
    ]
    got = bars_of(spark, [notes for notes, _, _ in cases])
    for i, (_, written, codes) in enumerate(cases):
        text = [" ".join([x["duration"] + "." * x["dotted"] + "t" * x["triplet"], *x["drums"]]) for x in got[i].notes]
        # Rests are filled longest first; the goldens list them in the order of the bar.
        assert sorted(text) == sorted(written) and [w["code"] for w in got[i].warnings] == codes, (text, got[i].warnings)


def test_every_bar_is_full(spark):
    import itertools

    from tickwise.functions.notation import DURATION_TICKS, MODEL_SHAPES

    pairs = [[note(a, d, "kick"), note(b, e, "snare")] for a, b, d, e in itertools.product((0, 3, 7, 13), (14, 20, 31), MODEL_SHAPES, ("eighth", "triplet_eighth", "whole"))]
    for bar in (r.notes for r in bars_of(spark, pairs).values()):
        assert sum(DURATION_TICKS[x["duration"]] * (3 if x["dotted"] else 2) // (3 if x["triplet"] else 2) for x in bar) == 192 or sum(DURATION_TICKS[x["duration"]] * (1.5 if x["dotted"] else 2 / 3 if x["triplet"] else 1) for x in bar) == pytest.approx(192)
    rows = spark.createDataFrame([("i", 0, 32, "eighth", ["kick"]), ("i", 1, 4, "quintuplet", ["cowbell"]), ("i", 2, 4, "eighth", [])], "item_id string, idx int, position int, duration string, drums array<string>")
    assert {r.problem for r in pb.validate_predictions(rows).collect()} == {"position is off the grid", "position is out of order", "unknown duration", "unknown drum", "no drums"}
    ok = spark.createDataFrame([("i", 0, "quarter", ["kick"])], "item_id string, position int, duration string, drums array<string>")
    assert [x.duration for x in pb.bars_from_predictions(ok).first().notes] == ["q", "h", "q"]


CATALOGUE = "id string, kind string, title string, level string, styles array<string>, subdivision string, limbs array<string>, goals array<string>, tempo_min int, tempo_target int, tempo_max int, description string"


def test_retrieval(spark, song):
    _, events, _ = song
    items = spark.createDataFrame([
        ("a", "exercise", "Tom journey", "beginner", ["rock"], "16th", ["hands"], ["tom movement"], 60, 80, 100, "around the kit"),
        ("b", "exercise", "Off beats", "beginner", ["funk"], "16th", ["hands", "foot"], ["syncopation", "kick independence"], 60, 90, 140, "sixteenths"),
        ("c", "fill", "One bar", "beginner", ["rock"], "8th", ["hands"], ["tom movement"], 80, 100, 120, "a fill"),
        ("d", "fill", "Fast", "advanced", ["rock"], "32nd", ["hands"], [], 80, 100, 120, "a fill"),
    ], CATALOGUE)
    blank = {"level": None, "kind": None, "subdivision": None, "max_tempo": None, "styles": None, "goals": None, "limbs": None, "text": None}
    schema = "query_id string, level string, kind string, subdivision string, max_tempo int, styles array<string>, goals array<string>, limbs array<string>, text string"
    ask = lambda **kw: (kw.pop("q"), *(blank | kw).values())
    q = spark.createDataFrame([ask(q="1", kind="fill", max_tempo=120), ask(q="2", text="the KIT, kit!"), ask(q="3", limbs=["foot"])], schema)
    got = {(r.query_id, r.id): r.score for r in ex.search_exercises(q, items).collect()}
    assert got == {("1", "c"): 20, ("1", "d"): 20, ("2", "a"): 10, ("3", "b"): 10} | {("2", k[1]): v for k, v in got.items() if k[0] == "2"}
    asked = spark.createDataFrame([("r", "s", 7, 8)], "request_id string, score_id string, from_bar int, to_bar int")
    facts = ex.passage_facts(an.inspect_bars(events, asked), events, asked)
    found = {r.goal: list(r.bars) for r in facts.collect()}
    assert found == {"subdivision": [7, 8], "syncopation": [7, 8], "kick independence": [7], "tom movement": [8]}
    best = [r.id for r in ex.exercises_for_passage(facts, items).orderBy("rank").collect()]
    assert best[0] == "b"
    want = spark.createDataFrame([("f", 100, "16th", "intermediate", "rock"), ("g", 200, "16th", "beginner", "rock")], "request_id string, tempo_bpm int, subdivision string, level string, style string")
    assert [(r.request_id, r.id, r.score) for r in ex.recommend_fills(want, items).collect()] == [("f", "c", 150)]
    assert {r.problem for r in ex.validate_fills(events.where("bar_number = 8 and event_idx < 4")).collect()} == {"a fill must be exactly one bar"}


def test_corpus_near_patterns_by_brute_force(spark):
    """Random bars of two scores: every pair of patterns is compared."""
    import random

    rng = random.Random(4)
    rows = []
    for bar in range(60):
        for i in range(8):
            drums = sorted({d for d in ("kick", "snare", HH, "crash") if rng.random() < (0.9 if d == HH else 0.25)})
            rows.append((f"s{bar % 2}", bar // 2 + 1, i, i * 24, 24, "8", False, False, drums, not drums))
    events = spark.createDataFrame(rows, "score_id string, bar_number int, event_idx int, onset_ticks int, duration_ticks int, written_duration string, dotted boolean, triplet boolean, drums array<string>, is_rest boolean")
    sets = {r.pattern: set(r["keys"]) for r in an._patterns(events).select("pattern", "keys").distinct().collect()}
    alike = lambda a, b: int(100 * len(a & b) / len(a | b) + 0.5) / 100
    want = {}
    for p, a in sets.items():
        near = [(-alike(a, b), q) for q, b in sets.items() if q != p and alike(a, b) >= 0.6]
        if near:
            want[p] = (len(near), min(near)[1], -min(near)[0])
    got = {r.pattern: (r.n_near, r.nearest, r.similarity) for r in an.corpus_near_patterns(events, threshold=0.6).collect()}
    assert got == want and len(want) > 20
