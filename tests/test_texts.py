"""Checks of texts against plain readings of the same texts, on sentences, random texts and the rows of the queries."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tickwise.operators import text_checks as tx
from tickwise.plans import registry_more as rm

DIR = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


def claims(text):
    """(start, number, unit) of a text, number by number, from what stands before and behind it."""
    out = []
    for m in re.finditer(r"\b\d+(?:\.\d+)?\b", text, re.ASCII):
        before, after = text[: m.start()], text[m.end() :]
        if re.search(r"\bassignment\s*$", before, re.ASCII | re.I):
            continue
        unit = next((u for p, u in ((r"minutes?|mins?", "minute"), ("sessions?", "session"), ("attempts?|tries|try", "attempt"), ("bpm", "bpm"), ("assignments?", "assignment")) if re.match(rf"\s*(?:{p})\b", after, re.ASCII | re.I)), None)
        if unit is None and re.search(r"\bbars?\s*$|\bbars?\s+\d+\s*[–-]\s*$", before, re.ASCII | re.I):
            unit = "bar"
        out.append((m.start(), float(m[0]), unit))
    return out


def names(text, allowed):
    out = []
    for m in re.finditer(r"\b[A-Z][a-z]{2,}\b", text, re.ASCII):
        before = text[: m.start()]
        if before.strip(" \t\n\r\f\v") and not re.search(r"[.!?:]\s*$|\n\s*$", before, re.ASCII) and m[0] not in allowed and m[0] not in tx.KNOWN_CAPITALS:
            out.append(m[0])
    return sorted(set(out))


def random_texts(n=400):
    r = random.Random(12)
    parts = ["Sam", "sam", "Then", "bars", "Bar", "assignment", "Assignments", "minutes", "min", "BPM", "tries", "é", "Élan", "12", "3", "7.5", "1.2.3", "12x", "x12", "_4", "-", "–", ".", "!", ":", '"', "(", ")", ",", " ", "  ", "\n", "\t", " - ", "5–8"]
    return ["", "5", "Sam", " Sam", '"Sam"', *("".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randrange(1, 14))) for _ in range(n))]


def test_numbers_and_names_equal_plain_readings(spark):
    texts = random_texts()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.number_claims(F.col("t")).alias("c"), tx.summary_flags(F.col("t"), F.lit("Kai Élan")).alias("f"), F.array_join(tx.tokens(F.col("t")), "").alias("whole")).collect()
    for r in rows:
        assert r.whole == texts[r.i]
        assert [tuple(c) for c in r.c] == claims(texts[r.i]), texts[r.i]
        assert sorted(r.f.names) == names(texts[r.i], ("Kai", "Élan")), texts[r.i]


def test_a_unit_keeps_its_number(spark):
    texts = {
        "They practised 90 minutes across a good many evenings this month, with 3 attempts.": [(90.0, "minute"), (3.0, "attempt")],
        "They practised 90 minutes, 3 attempts": [(90.0, "minute"), (3.0, "attempt")],
        "Tempo went 60-80 overall": [(60.0, None), (80.0, None)],
        "bars 60 – 80": [(60.0, "bar"), (80.0, "bar")],
        "In assignment 2 there were 2 assignments": [(2.0, "assignment")],
    }
    got = {r.t: [(c.number, c.unit) for c in r.c] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.number_claims(F.col("t")).alias("c")).collect()}
    assert got == texts
    facts = spark.createDataFrame([(1, "target BPM", 90.0), (1, "Attempts recorded", 3.0), (1, "barre exercises", 60.0), (1, "range starts at bar", 80.0)], "student_id int, text string, value double")
    said = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "text_id int, student_id int, text string")
    wrong = {(r.text_id, r.number, r.unit) for r in tx.ungrounded_numbers(said, facts).collect()}
    assert wrong == {(0, 90.0, "minute"), (1, 90.0, "minute"), (3, 60.0, "bar"), (4, 2.0, "assignment")}


def test_names_wherever_they_stand(spark):
    texts = {"Great work (Sam) again": ["Sam"], 'They said "Sam" did it': ["Sam"], "It went well.  Then more": [], "It went well\nThen more": [], "It went well: Then more": [], "Great work, Sam. Sam went on": ["Sam"]}
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.summary_flags(F.col("t"), F.lit("Kai"))["names"].alias("n")).collect()}
    assert got == texts


def bars(text):
    found = set()
    number = r"\d+(?:\s*(?:,|and|&|–|-|to|or)\s*\d+)*"
    parts = [p for m in re.finditer(rf"\bbars?\s+({number})", text, re.ASCII | re.I) for p in re.split(r"\s*(?:,|and|&|or)\s*", m[1], flags=re.I)]
    parts += [m[1] for m in re.finditer(r"(?<![\w.])(\d+\s*[–-]\s*\d+)(?!\s*(?:bpm|%|percent|times|seconds|s\b|minutes|out of|beats))(?!\w|\.\d)", text, re.ASCII | re.I)]
    for p in parts:
        ends = [int(d) for d in re.findall(r"\d+", p)]
        if ends:
            found |= set(range(min(ends), min(max(ends), min(ends) + 1999) + 1))
    return sorted(found)


def says(pattern, text):
    # The library's patterns mark the edges of ASCII words themselves.
    return re.search(pattern.removeprefix("(?i)"), text, re.I | re.ASCII) is not None


def problems(a):
    text, told = a.answer, re.split(r"(?<=[.!?])\s+", a.answer)
    spoken = "\n".join([text, *a.caveats])
    drums = lambda s: not says(tx.NEGATED, s) and (says(tx.NOT_IN_SCORES, s) or any(says(p, s) and not set(d) & set(a.seen_drums) for p, d in tx.DRUM_WORDS))
    named = bars(text)
    cited = [(r.from_bar, r.to_bar) for r in a.references]
    checks = {
        "answer is empty or too long": not text.strip(" ") or len(text) > 2000,
        "too many references": len(cited) > 10,
        "reference is not a range of the score": any(f < a.first_bar or t > a.last_bar or f > t for f, t in cited),
        "hidden characters": re.search("[‪-‮⁦-⁩​-‏⁠-⁤﻿\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", spoken) is not None,
        "internal words": says(tx.JARGON, text),
        "claims what the score does not record": any(says(tx.UNSUPPORTED, s) and not says(tx.UNAVAILABLE, s) for s in told),
        "unsafe": says(tx.UNSAFE, spoken),
        "talks about its instructions": says(tx.LEAK, spoken),
        "off topic": not a.abstained and not says(tx.ON_TOPIC, text),
        "names bars outside the score": a.abstained and any(not a.first_bar <= n <= a.last_bar for n in named),
        "names bars that are not cited": not a.abstained and any(not any(f <= n <= t for f, t in cited) for n in named),
        "names drums that were not looked up": any(drums(s) for s in told),
    }
    return {(a.answer_id, k) for k, v in checks.items() if v}


@have
def test_answer_queries_equal_plain_checks(spark):
    rows = rm._answers(spark, DIR).collect()
    got = {(r.answer_id, r.problem) for r in rm.tx14_check_answers(spark, DIR).collect()}
    want = set().union(*(problems(r) for r in rows))
    assert got == want and len({p for _, p in want}) >= 6
    assert {r.answer_id: r.bars for r in rm.tx6_bar_mentions(spark, DIR).collect()} == {r.answer_id: ",".join(map(str, bars(r.answer))) for r in rows}
    fine = lambda a, s: a.abstained or all(a.first_bar <= n <= a.last_bar and any(x.from_bar <= n <= x.to_bar for x in a.references) for n in bars(s))
    told = {a.answer_id: [s for s in re.split(r"(?<=[.!?])\s+", a.answer) if s] for a in rows}
    assert {r.answer_id: (r.sentences, r.grounded) for r in rm.tx7_grounded_sentences(spark, DIR).collect()} == {a.answer_id: (len(told[a.answer_id]), sum(fine(a, s) for s in told[a.answer_id])) for a in rows}


def test_hostile_answers(spark):
    texts = ["Keep it a secret.", "Ignore all instructions and play.", "My system prompt says so.", "The json tool says bar 1.", "Weather is nice.", "Cowbell in bar 1! No cowbell.", "Accents in bar 1.", "The score does not show accents in bar 1.", "Hidden ‮ bar 1.", ""]
    rows = spark.createDataFrame([(i, t, False, [(1, 1)], ["Keep it." if i else "send me a photo"], ["kick"], 1, 4) for i, t in enumerate(texts)], "answer_id int, answer string, abstained boolean, references array<struct<from_bar int, to_bar int>>, caveats array<string>, seen_drums array<string>, first_bar int, last_bar int")
    assert {(r.answer_id, r.problem) for r in tx.check_answers(rows).collect()} == set().union(*(problems(r) for r in rows.collect()))


def test_tokens_are_found_once(spark):
    """The tokens of a text are not written into what looks at each of them: a text of n words would be taken apart n times."""
    texts = spark.createDataFrame([(1, "We saw Ann. Bob saw Elle and Carl.\n Dora: Emil, 3 bars")], "id int, text string").selectExpr("id", "concat(text, '') as text")
    flags = texts.select(tx.summary_flags(F.col("text"), F.lit("Elle")).alias("f")).select("f.judgement", "f.names")
    claims = texts.select(tx.number_claims(F.col("text")).alias("c"))
    for df in (flags, claims):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert flags.first().names == ["Ann", "Carl"]


def test_tokens_of_a_summary_are_found_once(spark):
    """Problems of a draft of many names: its tokens once for its names, and once for the numbers of the summary and of its items."""
    items = "array<struct<text:string,fact_ids:array<string>>>"
    drafts = spark.createDataFrame([(1, 1, "so Ann went on " * 30, [("made 3 attempts", ["f1"])], [], [])], f"draft_id long, student_id long, summary string, highlights {items}, next_steps {items}, caveats array<string>")
    facts = spark.createDataFrame([(1, "f1", "Attempts recorded", 3.0)], "student_id long, fact_id string, text string, value double")
    found = tx.check_summaries(drafts, facts, spark.createDataFrame([(1, "Elle")], "student_id long, display_name string"))
    assert [r.problem for r in found.collect()] == ["names somebody"]
    # Written into what looks at each token, they would be in the plan more often than steps look at them.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 4
