"""Labels, subset, manifest, evaluation, practice, text, boxes, streams and sources on hand-made rows."""

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickwise.operators import boxes as bx
from tickwise.operators import evaluation as ev
from tickwise.operators import labels as lb
from tickwise.operators import manifest as mf
from tickwise.operators import practice as pr
from tickwise.operators import subset as ts
from tickwise.operators import text_checks as tx
from tickwise.sources import io
from tickwise.streaming import jobs as st

BEATS = "array<struct<beat string, duration string, drums array<string>, rest boolean, flam boolean>>"
HIT, REST = ("1", "eighth", ["snare_ghost", "kick"], None, None), ("1.5", "eighth", [], True, None)


def label(spark, rows):
    return spark.createDataFrame(rows, f"k int, time_signature string, simile boolean, beats {BEATS}")


def test_label_issues(spark):
    ok = ("4/4", None)
    cases = [
        ([HIT, REST], ok, ""), (None, ok, "invalid_beats"), ([HIT], ("4", None), "invalid_time_signature"), ([HIT], ("0/4", None), "invalid_time_signature"), ([HIT], ("5/4", None), "measure_beyond_grid"), ([HIT], ("4/4", True), "context_dependent_simile"),
        ([None, HIT], ok, "invalid_event"), ([("1", "eighth", None, None, None)], ok, "invalid_drums"), ([("1", "eighth", ["kick", None], None, None)], ok, "invalid_drums"), ([("1", "x", ["kick"], True, True)], ok, "rest_with_drums"),
        ([("1", "eighth", [], None, None)], ok, "empty_hit"), ([("1", "eighth", ["clap"], None, None)], ok, "unsupported_drum"), ([("1", "64th", ["kick"], None, None)], ok, "unsupported_duration"), ([("1", "eighth", ["kick"], None, True)], ok, "unsupported_flam"),
        ([("nan", "eighth", ["kick"], None, None)], ok, "invalid_beat"), ([("x", "eighth", ["kick"], None, None)], ok, "invalid_beat"), ([("0.5", "eighth", ["kick"], None, None)], ok, "beat_outside_grid"), ([("1.1", "eighth", ["kick"], None, None)], ok, "beat_off_grid"), ([HIT, HIT], ok, "duplicate_onset"),
    ]
    rows = [(i, sig, simile, beats) for i, (beats, (sig, simile), _) in enumerate(cases)]
    got = {r.k: ";".join(r.reasons) for r in ts.label_issues(label(spark, rows)).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_targets_and_weights(spark):
    rows = label(spark, [(1, "4/4", None, [HIT, REST, ("2", "quarter", ["kick"], None, None)])])
    sparse = {(r.slot, r.drum_idx, r.duration_idx) for r in ts.encode_sparse(rows, ["k"]).collect()}
    assert sparse == {(0, 1, 5), (0, 2, 5), (8, 2, 3)}
    d = ts.encode_dense(rows, ["k"]).first()
    assert len(d.drums) == 448 and {i for i, x in enumerate(d.drums) if x} == {1, 2, 8 * 14 + 2} and d.durations[0] == 5 and d.durations[8] == 3
    hits = spark.createDataFrame([(0, 0)] * 4 + [(0, 1)] * 1 + [(0, 2)] * 3, "slot int, drum_idx int")
    w = {(r.slot, r.drum_idx): r.weight for r in ts.positive_weights(hits, 4).collect()}
    assert (w[0, 0], w[0, 1], w[0, 2]) == (0.25, 3.0, pytest.approx(1 / 3)) and len(w) == 448
    assert ts.positive_weights(hits.limit(0), 100).first().weight == 50
    h = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 0.5, 1.5), ("a", 3, 0.4, 1.5)], "phase string, epoch int, train_loss double, validation_loss double")
    assert ts.best_epochs(h).first().epoch == 2


def test_subset_reports(spark):
    rows = ts.label_issues(label(spark, [(1, "4/4", None, [HIT]), (2, "x", None, [HIT])])).withColumns({"split": F.lit("train"), "song": F.lit("s")})
    assert {(r.split, r.included_bars, r.excluded_bars, r.included_songs) for r in ts.subset_report(rows).collect()} == {(None, 1, 1, 1), ("train", 1, 1, 1)}
    assert {r.split for r in ts.require_splits(rows).collect()} == {"validation", "test"}
    assert ts.exclusion_counts(rows).first().bars == 1
    m = spark.createDataFrame([("train", "a", "a0", 1, "i/x_bar001.png", "l/x_bar001.json"), ("test", "b", "a", 1, "i/y_bar001.png", "l/z_bar001.json"), ("odd", "c", "a0", 1, "i/q.png", "l/q.json")], "split string, song string, source_song string, bar_number int, image_path string, label_path string")
    assert {r.name for r in ts.split_leaks(m).collect()} == {"a", "a0"}
    files = spark.createDataFrame([("i/x_bar001.png", "1"), ("l/x_bar001.json", "2")], "path string, sha256 string")
    problems = {(r.image_path, r.problem) for r in ts.audit_pairs(m, files).collect()}
    assert ("i/x_bar001.png", "identity repeats") in problems and ("i/y_bar001.png", "stems differ") in problems and ("i/q.png", "split is unknown") in problems and ("i/q.png", "image is missing") in problems
    stored = spark.createDataFrame([("i/x_bar001.png", "1"), ("l/x_bar001.json", "9"), ("gone", "1")], "path string, sha256 string")
    assert {(r.path, r.problem) for r in ts.verify_hashes(stored, files).collect()} == {("l/x_bar001.json", "changed"), ("gone", "missing")}


RAW = "song string, kind string, track int, percussion boolean, clef string, bar int, time_signature string, voice int, ord int, note_value int, dotted boolean, tuplet_num int, tuplet_den int, is_rest boolean, grace boolean, pitches array<struct<midi int, ghost boolean>>"


def test_bar_labels(spark):
    def beat(song, kind, bar, voice, ord_, value, pitches=(), dotted=False, tuplet=(1, 1), grace=False, track=0):
        return (song, kind, track, True, "Neutral", bar, "4/4", voice, ord_, value, dotted, *tuplet, not pitches, grace, [(p, g) for p, g in pitches])

    k, s, ghost = (36, False), (38, False), (38, True)
    rows = [
        beat("a", "gp5", 1, 0, 0, 4, [k]), beat("a", "gp5", 1, 0, 1, 4), beat("a", "gp5", 1, 0, 2, 4, [s], dotted=True), beat("a", "gp5", 1, 1, 0, 8, [ghost], grace=True), beat("a", "gp5", 1, 1, 1, 8), beat("a", "gp5", 1, 1, 2, 4, [(99, False)]),
        beat("a", "gp5", 2, 0, 0, 1), beat("a", "gp5", 1, 0, 0, 4, [(35, False)], track=3),
        *[beat("t", "gp7", 1, 0, i, 8, [k], tuplet=(3, 2)) for i in range(3)], beat("t", "gp7", 1, 1, 0, 16),
    ]
    raw = spark.createDataFrame(rows, RAW)
    bars = spark.createDataFrame([("a", 1, "4/4"), ("a", 2, "4/4"), ("a", 3, "4/4"), ("t", 1, "4/4")], "song string, bar int, time_signature string")
    got = {(r.song, r.bar): r for r in lb.build_bar_labels(raw, bars).collect()}
    one = [(b.beat, b.duration, b.drums, b.rest, b.flam) for b in got["a", 1].beats]
    assert one[:3] == [("1", "eighth", ["kick", "snare_ghost"], False, True), ("1.5", "eighth", [], True, False), ("2", "quarter", ["midi99"], False, False)]
    assert one[3] == ("3", "dotted_quarter", ["snare"], False, False)
    assert got["a", 2].simile and got["a", 3].simile and got["a", 3].beats == [] and not got["a", 1].simile
    # The rest of the second voice arrives second, so its sixteenth does not count in a gp7 song.
    assert [(b.beat, b.duration) for b in got["t", 1].beats] == [("1", "triplet_eighth"), ("1.375", "triplet_eighth"), ("1.625", "triplet_eighth")]
    assert [tuple(r) for r in lb.unmapped_pitches(raw).collect()] == [("a", 1, 99, 1)]


def test_titles_and_links(spark):
    names = ["Rush Tom Sawyer Drum Tab", "Rush-Tom_Sawyer-05-30-2024", "Come Together by Rush Jan. 3, 2021", "AC_DC-Thunder'struck songsterr full", "12 Rush 2024"]
    got = [r.t for r in spark.createDataFrame([(n,) for n in names], "n string").select(mf.normalise_title(F.col("n"), aliases={"thunderstruck": "thunder"}).alias("t")).collect()]
    assert got == ["tom sawyer", "tom sawyer", "come together", "thunder", ""]
    docs = spark.createDataFrame([(1, "tom sawyer"), (2, "tom"), (3, "jam"), (4, "zzz"), (5, "")], "doc int, title string")
    known = spark.createDataFrame([("tom sawyer",), ("jamming",), ("jam on",), ("",)], "title string")
    assert {r.doc: (r.group, r.how) for r in mf.link_by_title(docs, known).collect()} == {1: ("tom sawyer", "exact"), 2: ("tom sawyer", "prefix"), 3: (None, "none"), 4: (None, "none"), 5: (None, "none")}


def test_manifest_and_splits(spark):
    images = spark.createDataFrame([("a_bar001", "i1"), ("a_bar002", "i2"), ("nobar", "i3"), ("lone_bar001", "i4")], "stem string, image_path string")
    labels = spark.createDataFrame([("a_bar001", "l1"), ("a_bar002", "l2"), ("nobar", "l3"), ("x_bar009", "l4")], "stem string, label_path string")
    sources = spark.createDataFrame([("a", "gp7", "a.gp")], "source_song string, source_kind string, source_file string")
    raw = spark.createDataFrame([("a", 1, "raw1")], "source_song string, bar_number int, source_label_path string")
    splits = spark.createDataFrame([("a", "train")], "song string, split string")
    manifest, errors = mf.build_manifest(images, labels, sources, raw, splits)
    assert [r.image_path for r in manifest.collect()] == ["i1"]
    assert {(r.stem, r.problem) for r in errors.collect()} == {("a_bar002", "no source label"), ("nobar", "name has no bar"), ("lone_bar001", "image has no label"), ("x_bar009", "label has no image")}
    rows = spark.createDataFrame([(f"s{i % 30}", f"img{i:03}") for i in range(90)], "song string, image_name string")
    for exact in (True, False):
        got = mf.split_songs(rows, 7, exact).groupBy("split").agg(F.countDistinct("song").alias("n"), F.count("*").alias("c")).collect()
        assert {r.split: (r.n, r.c) for r in got} == {"test": (3, 9), "validation": (3, 9), "train": (24, 72)}
    assert mf.sample_pairs(rows, "image_name", 5, 1).collect() == mf.sample_pairs(rows.repartition(5), "image_name", 5, 1).collect()


NOTES = "item_id int, position int, duration string, drums array<string>"


def test_evaluation_goldens(spark):
    truth = spark.createDataFrame([(0, 0, "eighth", ["kick"]), (1, 0, "eighth", ["kick"])], NOTES)
    pred = spark.createDataFrame([(0, 1, "eighth", ["kick"]), (1, 0, "quarter", ["kick"])], NOTES)
    r = ev.evaluate(truth, pred).first()
    # Bar 0 moved by a slot: its sequence is right and its cells are not; bar 1 has the wrong duration.
    assert (r.sequence_accuracy, r.exact_bar_accuracy, r.nonempty_bars, r.bars) == (0.5, 0.5, 2, 2)
    assert {d.drum: d.f1 for d in ev.drum_scores(truth, pred).collect()}["kick"] == 1.0
    none = {d.duration: d.accuracy for d in ev.duration_scores(truth, pred).collect()}
    assert none["eighth"] == 0 and none["whole"] is None
    assert ev.evaluate(truth.limit(0), pred).first().duration_accuracy is None
    c = {x.item_id: x for x in ev.compare_bars(truth, pred).collect()}
    assert not c[0].exact and c[0].onsets_matched == 0 and c[1].hits_matched == 1 and c[1].durations_matched == 0
    logits = spark.createDataFrame([(1, [5.0, -5.0, -5.0, 0.0], [0.0, 2.0, 2.0, 1.0]), (2, [1.0], [1.0]), (3, [float("nan")] * 4, [1.0] * 4)], "item_id int, drum_logits array<float>, dur_logits array<float>")
    notes = {r.item_id: r.notes for r in ev.decode_logits(logits, 2, ("kick", "snare"), ("a", "b")).collect()}
    assert [(n.position, n.duration, n.drums) for n in notes[1]] == [(0, "b", ["kick"])] and notes[2] is None and notes[3] is None
    p = ev.logit_parity(logits.where("item_id = 1"), logits.where("item_id = 1").withColumn("drum_logits", F.array(F.lit(5.0), F.lit(5.0), F.lit(-5.0), F.lit(0.0)).cast("array<float>"))).first()
    assert p.decision_flips == 1 and not p.ok
    ms = spark.createDataFrame([("a", i) for i in range(1, 11)], "m string, ms int")
    lat = ev.latency_summary(ms, ["m"]).first()
    assert (lat.p50_ms, lat.p95_ms, lat.min_ms, lat.max_ms, lat.mean_ms) == (6.0, 10.0, 1.0, 10.0, 5.5)
    results = spark.createDataFrame([(1, 1, None), (1, 2, True), (1, 3, False), (2, 1, None)], "item_id int, at int, exact boolean")
    latest, todo = ev.resume_items(spark.createDataFrame([(1,), (2,), (3,)], "item_id int"), results)
    assert latest.first().at == 3 and {r.item_id for r in todo.collect()} == {2, 3}
    art = [("r", a, "c", "m", "d", False) for a in ("run", "completed", "evaluation", "export", "checkpoint", "config", "benchmark", "model")]
    bad = [("q", *x[1:3], "m2" if x[1] == "config" else "m", "d", x[1] == "run") for x in art]
    audit = ev.release_audit(spark.createDataFrame(art + bad, "run_id string, artifact string, checkpoint_sha string, model_sha string, dataset_sha string, smoke boolean"))
    assert {(r.run_id, r.problem) for r in audit.collect()} == {("q", "smoke run"), ("q", "artifacts disagree on the model")}


def practice_tables(spark, sessions, attempts, assignments=(), resets=()):
    return {
        "students": spark.createDataFrame([("k", "Kai", "beginner", True, True), ("o", "Other", "beginner", False, True)], "student_id string, display_name string, level string, guardian_consent boolean, cloud_help boolean"),
        "sessions": spark.createDataFrame(sessions, "session_id int, student_id string, score_id string, started_at timestamp, ended_at timestamp, minutes double, from_bar int, to_bar int, target_bpm int, self_rating int"),
        "attempts": spark.createDataFrame(attempts, "session_id int, at timestamp, bpm int, clean boolean"),
        "assignments": spark.createDataFrame(list(assignments), "assignment_id int, student_id string, score_id string, title string, from_bar int, to_bar int, target_bpm int, due_date string, status string, completed_at timestamp, created_at timestamp"),
        "resets": spark.createDataFrame(list(resets), "student_id string, score_id string, reset_at timestamp"),
    }


def test_practice(spark):
    day = datetime(2025, 1, 2)
    sessions = [(i, "k", "s1", day + timedelta(days=i), day + timedelta(days=i, hours=1), 4.0, 1, 2, 100, 3) for i in range(3)] + [(9, "k", "s1", day, None, None, 3, 4, 100, None)]
    attempts = [(i, day + timedelta(days=i), bpm, clean) for i in range(3) for bpm, clean in ((90, True), (95, False))] + [(9, day - timedelta(days=1), 70, True)]
    work = [(1, "k", "s1", "Kai's piece", 1, 2, 90, None, "assigned", None, day), (2, "k", "s1", "B", 1, 2, 90, "2025-02-01", "assigned", None, day), (3, "k", "s1", "C", 1, 2, 90, None, "done", day, day)]
    t = practice_tables(spark, sessions, attempts, work)
    per, ranges = pr.session_summary(t)
    assert {r.student_id: (r.sessions, r.minutes, r.attempts, r.completed_assignments) for r in per.collect()} == {"k": (4, 12.0, 7, 1), "o": (0, 0.0, 0, 0)}
    assert {(r.from_bar, r.attempts, r.best_clean_bpm) for r in ranges.collect()} == {(1, 6, 90), (3, 1, 70)}
    assert pr.session_summary(t, datetime(2026, 1, 1))[1].count() == 0
    fresh = {r.from_bar: r for r in pr.personal_difficulty(t, datetime(2025, 1, 5)).collect()}
    aged = {r.from_bar: r for r in pr.personal_difficulty(t, datetime(2025, 9, 1)).collect()}
    assert fresh[1].enough_data and not fresh[3].enough_data and fresh[3].difficulty is None and 0 <= fresh[1].difficulty <= 1
    assert aged[1].difficulty == fresh[1].difficulty and "over a month old" in aged[1].reasons
    reset = t | {"resets": spark.createDataFrame([("k", "s1", day + timedelta(days=1, hours=5))], "student_id string, score_id string, reset_at timestamp")}
    assert [(r.sessions, r.attempts) for r in pr.personal_difficulty(reset, datetime(2025, 1, 9)).collect()] == [(1, 2)]
    assert [(r.session_id, r.problem) for r in pr.late_attempts(t["attempts"], t["sessions"]).collect()] == [(9, "before the session")]
    assert [r.assignment_id for r in pr.list_assignments(t["assignments"]).orderBy("place").collect()] == [2, 1, 3]
    left = pr.delete_students(t, spark.createDataFrame([("k",)], "student_id string"))
    assert {n: df.count() for n, df in left.items()} == {"students": 1, "sessions": 0, "attempts": 0, "assignments": 0, "resets": 0}
    assert {(r.table, r.n) for r in pr.orphans(t | {"students": t["students"].where("student_id = 'o'")}).collect()} == {("sessions", 4), ("assignments", 3)}
    facts = pr.progress_facts(t, datetime(2025, 1, 5))
    rows = facts.where("student_id = 'k'").orderBy("n").collect()
    assert [r.value for r in rows[:4]] == [4, 7, 12, 1] and rows[4].text == 'Open assignment "B" starts at bar' and [r.fact_id for r in rows] == [f"f{i + 1}" for i in range(len(rows))]
    hidden = [r.text for r in pr.pseudonymise(facts, t["students"], t["assignments"]).where("student_id = 'k'").collect()]
    assert not any("Kai" in x or "s1" in x or '"' in x for x in hidden) and any(x.startswith("score A ") for x in hidden) and any("assignment 2" in x for x in hidden)
    assert "practised 12 minutes across 4 sessions and made 7 attempts" in pr.offline_summary(t).where("student_id = 'k'").first().summary
    assert [r.student_id for r in pr.cloud_allowed(t["students"]).collect()] == ["k"]
    assert {(r.table, r.problem) for r in pr.validate_practice(t).collect()} == {("students", "cloud help needs a guardian's consent")}
    exported = pr.export_student(t, "k").collect()
    assert len(exported) == 1 + 4 + 7 + 3 and not any("Other" in r.row for r in exported)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_text_checks(spark):
    mentions = {"bar 5": [5], "Bars 1, 2 and 6": [1, 2, 6], "bars 7–8": [7, 8], "play 7-9": [7, 8, 9], "at 80-90 bpm": [], "50-60 % and 3-4 times": [], "handlebar 5": [], "bars 3 to 5 or 9": [3, 4, 5, 9], "": [], "bar 12345678901": [12345678901], f"bar {10**30}": [2**63 - 1], "bars 2-5000": list(range(2, 2002))}
    for text, want in mentions.items():
        assert one(spark, text, tx.bar_mentions) == want, text
    assert one(spark, "Hit the accent. The score does not show accents! Fine?", tx.unsupported_claims) == ["Hit the accent."]
    drums = lambda c: tx.ungrounded_drums(c, F.array(F.lit("kick")))
    assert one(spark, "The kick plays. The snare plays. No toms here. A cowbell!", drums) == ["The snare plays.", "A cowbell!"]
    assert one(spark, "a​b", tx.has_hidden) and not one(spark, "a\tb", tx.has_hidden)
    assert one(spark, " a​ \n b" + "c" * 400, lambda c: tx.clean_short_text(c, 10)) == "a bcccccc…"
    assert one(spark, "Keep it a secret", lambda c: tx.safety_flags(c, F.lit(False))).unsafe
    assert one(spark, "Great work, Sam. Sam is gifted", lambda c: tx.summary_flags(c, F.lit("Kai"))).asDict() == {"judgement": True, "names": ["Sam"]}
    claims = one(spark, "In assignment 2 you did 90 minutes, 3 attempts and bars 7 at 80 BPM, then 5", tx.number_claims)
    assert [(c.number, c.unit) for c in claims] == [(90.0, "minute"), (3.0, "attempt"), (7.0, "bar"), (80.0, "bpm"), (5.0, None)]


ANSWER = "answer_id int, answer string, abstained boolean, references array<struct<from_bar int, to_bar int>>, caveats array<string>, seen_drums array<string>, first_bar int, last_bar int"


def test_answers_and_summaries(spark):
    rows = [
        (1, "Bar 3 has a kick. Bar 9 is busy.", False, [(3, 3)], [], ["kick"], 1, 10),
        (2, "Bar 40 is not here; I can only help with bars.", True, [], [], [], 1, 10),
        (3, "The kick plays in bar 2.", False, [(2, 2)], ["Bar 2 was imported and not checked yet."], ["kick"], 1, 10),
    ]
    a = spark.createDataFrame(rows, ANSWER)
    assert {r.answer_id: (r.sentences, r.grounded) for r in tx.grounded_sentences(a).collect()} == {1: (2, 1), 2: (1, 1), 3: (1, 1)}
    assert {(r.answer_id, r.problem) for r in tx.check_answers(a).collect()} == {(1, "names bars that are not cited"), (2, "names bars outside the score")}
    want = spark.createDataFrame([(1, [(3, 3)], [(9, 9)], ["kick"], None, False, None, True, None), (3, [(1, 2)], None, ["snare"], ["kick"], True, True, None, ["not checked"])], "answer_id int, must_reference array<struct<from_bar int, to_bar int>>, must_not_reference array<struct<from_bar int, to_bar int>>, must_mention array<string>, must_not_mention array<string>, abstain boolean, discloses boolean, no_warning boolean, caveat_mentions array<string>")
    g = {r.answer_id: r for r in tx.grade_answers(a, want).collect()}
    assert g[1].citations_valid and g[1].required_references and g[1].forbidden_references and g[1].facts and g[1].forbidden_text is None and g[1].abstention and g[1].no_irrelevant_warning
    assert not g[3].required_references and not g[3].facts and not g[3].forbidden_text and not g[3].abstention and g[3].unreviewed_disclosure and g[3].caveats
    summary = {r.check: (r.of, r.passed, r.rate) for r in tx.answer_summary(tx.grade_answers(a, want)).collect()}
    assert summary["facts"] == (2, 1, 50.0) and summary["caveats"] == (1, 1, 100.0)
    scoped = a.withColumns({"score_id": F.lit("s"), "scope_from": F.lit(1), "scope_to": F.lit(10), "total_bars": F.lit(12)})
    bars = spark.createDataFrame([("s", 3, False), ("s", 5, False), ("s", 2, True)], "score_id string, bar_number int, reviewed boolean")
    assert {r.answer_id: r.caveats for r in tx.required_caveats(scoped, bars).collect()}[1] == "Bars 3, 5 were imported and not checked yet. Only bars 1-10 of 12 were looked at."
    act = [("select_bars", 1, 2, None, None, "Look."), ("select_bars", 1, 2, None, None, "Look."), ("set_tempo", None, None, 200, None, "Fast."), ("open_exercise", None, None, None, "zz", "Try.")]
    actions = spark.createDataFrame([(1, 100, 1, 10, act)], "answer_id int, tempo_bpm int, first_bar int, last_bar int, actions array<struct<type string, from_bar int, to_bar int, tempo_bpm int, exercise_id string, reason string>>")
    assert {(r.idx, r.problem) for r in tx.validate_actions(actions, spark.createDataFrame([("e1",)], "id string")).collect()} == {(1, "action repeats"), (2, "tempo is not within 40 % of the score's"), (3, "too many actions")}
    drafts = spark.createDataFrame([(1, "k", "Practised 12 minutes.", [("Best is 90 BPM.", ["f2"])], [], []), (2, "k", "Practised 90 minutes.", [("Hi Sam, 12 minutes.", ["f2", "f9"])], [("", [])], [""])], "draft_id int, student_id string, summary string, highlights array<struct<text string, fact_ids array<string>>>, next_steps array<struct<text string, fact_ids array<string>>>, caveats array<string>")
    facts = spark.createDataFrame([("k", "f1", "Minutes practised", 12.0), ("k", "f2", "Score s best clean BPM", 90.0)], "student_id string, fact_id string, text string, value double")
    students = spark.createDataFrame([("k", "Kai")], "student_id string, display_name string")
    got = {(r.draft_id, r.problem) for r in tx.check_summaries(drafts, facts, students).collect()}
    assert got == {(2, p) for p in ("a caveat is empty", "names somebody", "an item has no text", "an item cites nothing", "cites an unknown fact", "a number is no cited fact's value")}


def test_boxes(spark):
    boxes = spark.createDataFrame([("d", 1, 1, -5.0, 3.4, 900.0, 5.0), ("d", 1, 2, 400.0, 0.0, 50.0, 30.0), ("d", 1, 2, 10.0, 100.0, 50.0, 30.0), ("d", 7, 3, 1.0, 1.0, 50.0, 50.0)], "doc_id string, page int, box_id int, x double, y double, width double, height double")
    pages = spark.createDataFrame([("d", 1, 850.0, 1100.0)], "doc_id string, page int, page_width double, page_height double")
    c = bx.clamp_boxes(boxes, pages).where("box_id = 1").first()
    assert (c.x, c.y, c.width, c.height) == (0.0, 3.0, 850.0, 12.0)
    assert {(r.box_id, r.problem) for r in bx.validate_boxes(boxes, pages).collect()} == {(1, "too small"), (1, "past the edge"), (2, "id is missing or repeats"), (3, "page does not exist")}
    rows = spark.createDataFrame([("d", 1, i, x, y, 50.0, 40.0) for i, (x, y) in enumerate([(300.0, 10.0), (10.0, 30.0), (100.0, 0.0), (10.0, 200.0)])], boxes.schema)
    assert [r.box_id for r in bx.reading_order(rows).orderBy("place").collect()] == [2, 0, 1, 3]
    todo, counts = bx.pending_boxes(rows, spark.createDataFrame([], "doc_id string, box_id int, key string, status string"), "v1")
    done = todo.where("box_id < 2").select("doc_id", "box_id", "key", F.lit("done").alias("status"))
    todo, counts = bx.pending_boxes(rows, done, "v1")
    assert todo.count() == 2 and counts.first().done == 2 and bx.pending_boxes(rows, done, "v2")[0].count() == 4


def usage(spark, rows):
    return spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(seconds=s), k, r, m, i, o, e) for s, k, r, m, i, o, e in rows], "ts timestamp, key string, request_id int, model string, input_tokens long, output_tokens long, error boolean")


def test_spend_limit_and_health(spark):
    rows = usage(spark, [(0, "a", 1, "x", 1_000_000, 100_000, False), (20, "a", 2, "new", 0, 1_000_000, False), (30, "b", 3, "x", 0, 0, True)])
    r = st.monthly_spend(rows, {"x": (0.2, 1.2), "y": (0.1, 2.0)}, limit=2.0).first()
    assert (r.spent_micros, r.requests, r.over_limit) == (320_000 + 2_000_000, 2, True)
    asks = usage(spark, [(s, "k", i, "m", 0, 0, False) for i, s in enumerate((0, 20, 30, 60, 70))])
    got = [(r.allowed, r.wait_seconds) for r in st.rate_limit(asks, 2).orderBy("ts").collect()]
    assert got == [(True, 0), (True, 0), (False, 30), (True, 0), (False, 10)]
    assert {r.key: r.health for r in st.health(rows).collect()} == {"a": "ok", "b": "problem"}


def run_stream(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams_equal_their_batches(spark, tmp_path):
    rows = usage(spark, [(s * 7 % 300, f"k{s % 3}", s, "x", s * 1000, s * 10, s % 5 == 0) for s in range(60)])
    rows.coalesce(1).write.parquet(f"{tmp_path}/u")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/u")
    want = st.monthly_spend(rows, {"x": (0.2, 1.2)}, 1.0).collect()
    assert run_stream(st.monthly_spend(stream(), {"x": (0.2, 1.2)}, 1.0), "spend", "update").collect() == want
    key = lambda df: {(r.key, r.request_id, r.allowed, r.wait_seconds) for r in df.collect()}
    assert key(run_stream(st.rate_limit(stream(), 3), "limited", "append")) == key(st.rate_limit(rows, 3))
    results = lambda df: df.select(F.col("key").alias("item_id"), F.col("ts").alias("at"), F.when(~F.col("error"), F.lit(True)).alias("exact"))
    assert sorted(run_stream(st.stream_results(results(stream())), "firsts", "append").collect()) == sorted(st.stream_results(results(rows)).collect())
    day = datetime(2024, 1, 1)
    sessions = spark.createDataFrame([(1, "k", "s", 1, 2, day, day + timedelta(minutes=5))], "session_id int, student_id string, score_id string, from_bar int, to_bar int, started_at timestamp, ended_at timestamp")
    tries = spark.createDataFrame([(1, day + timedelta(minutes=m), 60 + m, m % 2 == 0) for m in (-1, 1, 2, 4, 9)], "session_id int, at timestamp, bpm int, clean boolean")
    tries.coalesce(1).write.parquet(f"{tmp_path}/a")
    live = spark.readStream.schema(tries.schema).parquet(f"{tmp_path}/a")
    best, late = st.stream_progress(live, sessions)
    assert run_stream(best, "best", "update").collect() == st.stream_progress(tries, sessions)[0].collect()
    assert sorted(r.bpm for r in run_stream(late, "late", "append").collect()) == [59, 69]


def test_sources_round_trip(spark, tmp_path):
    for name, text in {"a.json": json.dumps({"song": "a", "bar": 1, "time_signature": "4/4", "beats": [{"beat": "1", "duration": "eighth", "drums": ["kick"]}]}), "b.json": json.dumps({"song": "", "bar": 1}), "c.json": "not json", "d.json": json.dumps({"song": "d", "bar": 0})}.items():
        (tmp_path / "labels").mkdir(exist_ok=True)
        (tmp_path / "labels" / name).write_text(text)
    good, bad = io.read_labels(spark, f"{tmp_path}/labels")
    assert [r.song for r in good.collect()] == ["a"] and sorted(r.problem for r in bad.collect()) == ["no bar number", "no song", "not an object"]
    (tmp_path / "scores").mkdir()
    for name, doc in {"1": {"schemaVersion": 1, "scoreId": "s", "revision": 1, "title": "", "tempoBpm": 90, "meter": {"beats": 4, "beatUnit": 4}, "bars": [{"barId": "b", "provenance": {"source": "manual", "reviewed": True, "warnings": []}, "notes": []}]}, "2": {"schemaVersion": 9, "scoreId": "t"}, "3": {"x": 1}}.items():
        (tmp_path / "scores" / name).write_text(json.dumps(doc))
    ok, refused = io.read_scores(spark, f"{tmp_path}/scores")
    assert [(r.score_id, r.schema_version) for r in ok.collect()] == [("s", 1)] and {r.problem for r in refused.collect()} == {"newer schema version", "not a score"}
    hashed = {r.path.rsplit("/", 1)[1]: r for r in io.hash_files(spark, f"{tmp_path}/scores", most_bytes=40).collect()}
    want = {name: hashlib.sha256((tmp_path / "scores" / name).read_bytes()).hexdigest() for name in "123"}
    assert {name: hashed[name].sha256 for name in "123"} == want and {hashed[n].length > 40 for n in "123"} == {True, False}
    m = spark.createDataFrame([("train", "a, b", 'say "x"', "gp7", "f", 3, "i", "l", "r")], io.MANIFEST)
    io.write_csv(m, f"{tmp_path}/m")
    assert io.read_csv(spark, f"{tmp_path}/m").collect() == m.collect()
    for batch in ("b1", "b2", "b1"):
        io.append_results(m, f"{tmp_path}/r", batch)
    assert io.read_results(spark, f"{tmp_path}/r", io.MANIFEST).collect() == m.collect() * 2
    io.write_report(m.select(F.struct("split").alias("s")), f"{tmp_path}/report")
    assert json.loads(spark.read.text(f"{tmp_path}/report").first().value) == {"s": {"split": "train"}}
    io.write_subset(m, f"{tmp_path}/subset")
    assert spark.read.parquet(f"{tmp_path}/subset").where("split = 'train'").count() == 1
    for name, rows, schema in (("students", [("k", '{"guardianConsent": true}')], "student_id string, consent string"), ("sessions", [(1, "2025-01-01T00:00:00Z")], "session_id int, started_at string"), ("attempts", [(1, 1)], "session_id int, clean int"), ("assignments", [(1,)], "assignment_id int"), ("resets", [("k",)], "student_id string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/store/{name}")
    t = io.read_practice(spark, f"{tmp_path}/store")
    assert t["students"].first().guardian_consent and t["attempts"].first().clean is True and dict(t["sessions"].dtypes)["started_at"] == "timestamp"
