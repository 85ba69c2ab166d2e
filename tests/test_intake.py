"""JSON intake against plain checks of the parsed texts."""

import json
import os
import re
from collections import Counter

import pytest

from tickwise.functions.notation import DRUMS, DURATION_TICKS
from tickwise.operators.subset import label_issues
from tickwise.plans import registry_intake as ri
from tickwise.sources.intake import checked_scores, parse_labels, parse_scores

DIR = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


def reasons(spark, texts):
    good, bad = parse_labels(spark.createDataFrame(list(enumerate(texts)), "i int, raw string"))
    return {r.i: r.reasons for r in label_issues(good).collect()} | {r.i: r.problem for r in bad.collect()}


def test_labels_keep_their_types(spark):
    bar = lambda **event: json.dumps({"song": "s", "bar": 1, "time_signature": "4/4", "beats": [{"beat": "1", "duration": "eighth", "drums": ["kick"]} | event]})
    top = lambda **x: json.dumps({"song": "s", "bar": 1, "time_signature": "4/4", "beats": []} | x)
    texts = [
        bar(), bar(flam=1), bar(flam="no"), bar(flam=0), bar(flam=[]), bar(drums=[5]), bar(drums="kick"), bar(drums=[None]), bar(drums=None), bar(drums=[]), bar(beat=1.5), bar(beat=True), bar(beat=None),
        bar(beat=[1]), bar(beat="nan"), bar(beat="5"), bar(duration=8), bar(rest={}, drums=["kick"]), bar(rest="x", drums=["kick"]), bar(rest=1, drums=[]), top(beats=["kick"]), top(beats={}), top(beats=None), top(time_signature=4),
        top(time_signature="6/4", simile=1), top(simile=""), top(song=5), top(song=""), top(bar="7"), top(bar=0), top(bar=2.5), "[]", "{", None, "null",
    ]
    want = [
        [], ["unsupported_flam"], ["unsupported_flam"], [], [], ["invalid_drums"], ["invalid_drums"], ["invalid_drums"], ["invalid_drums"], ["empty_hit"], [], [], ["invalid_beat"],
        ["invalid_beat"], ["invalid_beat"], ["beat_outside_grid"], ["unsupported_duration"], [], ["rest_with_drums"], [], ["invalid_event"], ["invalid_beats"], ["invalid_beats"], ["invalid_time_signature"],
        ["context_dependent_simile", "measure_beyond_grid"], [], "no song", "no song", "no bar number", "no bar number", "no bar number", "not an object", "not an object", "not an object", "not an object",
    ]
    got = reasons(spark, texts)
    assert [got[i] for i in range(len(texts))] == want


def whole(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool) and x == int(x)


def problems(raw):
    """(code, [(place, problem)]) of one text, checked value by value."""
    try:
        doc = json.loads(raw)
    except (ValueError, TypeError):
        doc = None
    if not isinstance(doc, dict) or ("schemaVersion" not in doc and not isinstance(doc.get("bars"), list)):
        return "unreadable", [("document", "not a score")]
    new = "schemaVersion" not in doc
    if not new and whole(doc["schemaVersion"]) and doc["schemaVersion"] > 1:
        return "future_version", [("document", "newer schema version")]
    out = []
    ident = lambda x: isinstance(x, str) and re.fullmatch("[A-Za-z0-9_-]{1,64}", x) is not None
    say = lambda bad, place, what: out.append((place, what)) if bad else None

    def fields(x, names, place):
        for k in x:
            say(k not in names, place, f"unknown field {k}")

    meter = {"beats": 4, "beatUnit": 4} if new else doc.get("meter")
    meter_ok = isinstance(meter, dict) and whole(meter.get("beats")) and 1 <= meter["beats"] <= 32 and whole(meter.get("beatUnit")) and meter["beatUnit"] in (1, 2, 4, 8, 16, 32)
    if not new:
        fields(doc, ("schemaVersion", "scoreId", "revision", "title", "tempoBpm", "meter", "bars"), "score")
        say(not (whole(doc["schemaVersion"]) and doc["schemaVersion"] == 1), "score", "schema version is not 1")
        say(not ident(doc.get("scoreId")), "score", "score id is not 1-64 letters, digits, - or _")
        say(not (whole(doc.get("revision")) and doc["revision"] >= 0), "score", "revision is not 0 or more")
        say(not (isinstance(doc.get("title"), str) and len(doc["title"]) <= 200), "score", "title is missing or too long")
        say(not (whole(doc.get("tempoBpm")) and 20 <= doc["tempoBpm"] <= 300), "score", "tempo is not 20-300")
        say(not meter_ok, "score", "meter is not supported")
    bars = doc.get("bars")
    if not isinstance(bars, list) or not 1 <= len(bars) <= 2000:
        return "invalid", [*out, ("score", "number of bars is out of range")]
    ids = Counter()
    for i, bar in enumerate(bars):
        at = f"bar {i + 1}"
        if not isinstance(bar, dict):
            out.append((at, "is not a bar"))
            continue
        fields(bar, ("barId", "provenance", "notes"), at)
        say(not ident(bar.get("barId")) and not (new and "barId" not in bar), at, "bar id is not valid")
        ids[bar.get("barId") if ident(bar.get("barId")) else None] += 1
        p = bar.get("provenance")
        if not isinstance(p, dict):
            say(not (new and "provenance" not in bar), at, "provenance is missing")
        else:
            fields(p, ("source", "reviewed", "warnings", "model"), f"{at} provenance")
            say(p.get("source") not in ("manual", "local_omr", "openai_omr"), at, "unknown source")
            say(not isinstance(p.get("reviewed"), bool), at, "reviewed is missing")
            w = p.get("warnings")
            say(not (isinstance(w, list) and len(w) <= 50 and all(isinstance(x, str) and len(x) <= 500 for x in w)), at, "warnings are no list of short messages")
            say("model" in p and not (isinstance(p["model"], str) and len(p["model"]) <= 100), at, "model is no short name")
        notes = bar.get("notes")
        if not isinstance(notes, list):
            out.append((at, "notes is not a list"))
            continue
        fine = True
        for j, n in enumerate(notes):
            spot, before = f"{at} note {j + 1}", len(out)
            if not isinstance(n, dict):
                out.append((spot, "is not a note"))
                fine = False
                continue
            fields(n, ("eventId", "duration", "dotted", "triplet", "drums"), spot)
            say(not ident(n.get("eventId")) and not (new and "eventId" not in n), spot, "event id is not valid")
            ids[n.get("eventId") if ident(n.get("eventId")) else None] += 1
            before = len(out)
            drums = n.get("drums")
            say(not isinstance(n.get("duration"), str) or n["duration"] not in DURATION_TICKS, spot, "unknown duration")
            say(not isinstance(n.get("dotted"), bool), spot, "dotted is not true or false")
            say("triplet" in n and not isinstance(n["triplet"], bool), spot, "triplet is not true or false")
            say(not isinstance(drums, list), spot, "drums is not a list")
            if isinstance(drums, list):
                say(any(d not in DRUMS for d in drums), spot, "unknown drum")
                names = [d if isinstance(d, str) else "?" for d in drums]
                say(len(set(names)) < len(names), spot, "a drum repeats")
                say(n.get("dotted") is True and n.get("duration") == "32", spot, "a dotted 32nd is not supported")
                say(n.get("dotted") is True and n.get("triplet") is True, spot, "a dotted triplet is not supported")
            fine = fine and len(out) == before
        if fine:
            run = loose = 0
            kind = None
            for n in [*notes, {}]:
                if n.get("triplet") and n["duration"] == kind and run < 3:
                    run += 1
                else:
                    loose += run % 3
                    run, kind = (1, n["duration"]) if n.get("triplet") else (0, None)
            say(loose, at, "a triplet note is outside a group of three")
            ticks = sum(DURATION_TICKS[n["duration"]] * (1.5 if n["dotted"] else 2 / 3 if n.get("triplet") else 1) for n in notes)
            say(meter_ok and ticks > meter["beats"] * 192 / meter["beatUnit"] + 1e-6, at, "notes overfill the bar")
    out += [(f"id {k}", "id repeats") for k, c in ids.items() if k is not None and c > 1]
    return "invalid", out


def valid(**x):
    note = {"eventId": "n1", "duration": "q", "dotted": False, "drums": ["kick"]}
    return {"schemaVersion": 1, "scoreId": "s1", "revision": 0, "title": "T", "tempoBpm": 90, "meter": {"beats": 4, "beatUnit": 4}, "bars": [{"barId": "b1", "provenance": {"source": "manual", "reviewed": True, "warnings": []}, "notes": [note]}]} | x


def note(**x):
    return valid(bars=[{"barId": "b1", "provenance": {"source": "local_omr", "reviewed": False, "warnings": ["w"], "model": "m"}, "notes": [{"eventId": "n1", "duration": "q", "dotted": False, "drums": ["kick"]} | x]}])


def triplets(*lengths):
    return valid(bars=[{"barId": "b1", "provenance": {"source": "manual", "reviewed": True, "warnings": []}, "notes": [{"eventId": f"n{i}", "duration": d, "dotted": False, "triplet": True, "drums": []} for i, d in enumerate(lengths)]}])


SCORES = [
    valid(), valid(revision=1.0), valid(revision=1.5), valid(revision="1"), valid(extra=1), valid(schemaVersion=2), valid(schemaVersion="2"), valid(schemaVersion=0), valid(title=5), valid(title="x" * 201), valid(tempoBpm=301), valid(tempoBpm=True), valid(meter=None),
    valid(meter={"beats": 3, "beatUnit": 3}), valid(meter={"beats": 1, "beatUnit": 8}), valid(bars=[]), valid(bars={}), valid(bars=["bar", None, 5]), valid(scoreId="a b"), note(dotted=1), note(dotted=True, duration="32"), note(dotted=True, triplet=True), note(triplet=None), note(drums=[5]),
    note(drums=["kick", "kick"]), note(drums="kick"), note(drums=None), note(duration=8), note(eventId="b1"), note(eventId=None), note(flam=True), triplets("8", "8", "8"), triplets("8", "8"), triplets("8", "8", "16", "16", "16"), triplets("8", "8", "8", "8"),
    {"bars": [{"notes": [{"duration": "q", "dotted": False, "drums": []}]}]}, {"bars": [{"barId": None, "provenance": None, "notes": [{"eventId": "", "duration": "w", "dotted": False, "drums": []}, {"duration": "q", "dotted": False, "drums": []}]}]}, {"bars": []}, {"bars": 5}, {}, [], "x", None,
]


def test_scores_equal_plain_checks(spark):
    texts = [json.dumps(x) for x in SCORES] + ["{", "", None]
    good, bad = parse_scores(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, raw string"))
    got = {str(i): ("invalid", []) for i in range(len(texts))}
    for r in bad.collect():
        got[r.path] = (r.code, [*got[r.path][1], (r.place, r.problem)])
    for i, t in enumerate(texts):
        code, want = problems(t)
        assert got[str(i)] == (code, got[str(i)][1]) and sorted(got[str(i)][1]) == sorted(want), (t, got[str(i)], want)
    read = {r.path: r for r in good.collect()}
    assert {p for p in read} == {str(i) for i, t in enumerate(texts) if not problems(t)[1]}
    new = read[str(next(i for i, x in enumerate(SCORES) if isinstance(x, dict) and "schemaVersion" not in x and not problems(json.dumps(x))[1]))]
    assert (new.title, new.tempo_bpm, new.revision, new.meter.beats, new.bars[0].provenance.source) == ("Untitled score", 90, 0, 4, "manual")
    assert len({new.score_id, new.bars[0].bar_id, new.bars[0].notes[0].event_id}) == 3 and all(re.fullmatch("[0-9a-f]{32}", x) for x in (new.score_id, new.bars[0].bar_id))


@have
def test_score_query_equals_plain_checks(spark):
    raw = {r.path: r.raw for r in ri.raw_scores(spark, DIR).collect()}
    want = sorted((p, code, *x) for p, t in raw.items() for code, found in [problems(t)] for x in found)
    got = sorted((r.path, r.code, r.place, r.problem) for r in ri.io3_read_scores(spark, DIR).where("code <> 'read'").collect())
    assert len({c for _, c, *_ in want}) == 3 and got == want


def test_a_note_is_opened_once_and_texts_in_one_pass(spark):
    """What is seen in a note is not written anew into each of its checks, and the report of all scores opens the texts once."""
    import inspect

    docs = spark.createDataFrame([("p", '{"bars": [{"notes": [{"duration": "8", "dotted": false, "drums": ["kick", 5]}]}]}')], "path string, raw string")
    rows = checked_scores(docs)
    assert [(x.place, x.problem) for x in rows.first()["_found"]] == [("bar 1 note 1", "unknown drum")]
    assert "parse_scores" not in inspect.getsource(ri.io3_read_scores)
