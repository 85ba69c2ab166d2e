"""Predictions -> bars, timelines and MIDI events (PB1-PB7). Times stay whole ticks until the last projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwise.functions.frames import in_ranges
from tickwise.functions.notation import BAR_TICKS, DRUMS, DURATION_TICKS, GM_NOTES, MODEL_SHAPES, SLOT_TICKS, SLOTS, TICKS_PER_BEAT, lookup, strings


def validate_predictions(notes: DataFrame, slots: int = SLOTS) -> DataFrame:
    """PB1: notes(item_id, idx, position, duration, drums) -> (item_id, idx, problem)."""
    before = F.lag("position").over(Window.partitionBy("item_id").orderBy("idx"))
    problems = F.array_compact(F.array(
        F.when(F.coalesce(~F.col("position").between(0, slots - 1), F.lit(True)), "position is off the grid"),
        F.when(F.col("position") <= F.col("before"), "position is out of order"),
        F.when(F.coalesce(~F.col("duration").isin(*MODEL_SHAPES), F.lit(True)), "unknown duration"),
        F.when(F.coalesce(F.size("drums") < 1, F.lit(True)), "no drums"),
        F.when(F.size(F.array_except("drums", strings(DRUMS))) > 0, "unknown drum"),
    ))
    return notes.withColumn("before", before).select("item_id", "idx", F.explode(problems).alias("problem"))


# Plain note lengths, longest first: (ticks, written duration, dotted); a dotted 32nd is not written.
_PLAIN = sorted(((t * (3 if dot else 2) // 2, d, dot) for d, t in DURATION_TICKS.items() for dot in (False, True) if not (dot and d == "32")), reverse=True)
_NOTE = "struct<duration:string,dotted:boolean,triplet:boolean,drums:array<string>>"
_WARNING = "struct<code:string,position:int>"
# A bar while it is written: ticks so far, notes, warnings, and the open triplet group (span 0: none) with its three places.
_OPEN = f"struct<at:int,notes:array<{_NOTE}>,warnings:array<{_WARNING}>,start:int,span:int,written:string,p0:array<string>,p1:array<string>,p2:array<string>>"


def _note(duration: Column, dotted: Column, triplet: bool, drums: Column) -> Column:
    return F.struct(duration.alias("duration"), dotted.alias("dotted"), F.lit(triplet).alias("triplet"), drums.alias("drums"))


def _rests(ticks: Column) -> Column:
    """A gap as rests, longest first: each length is half of the one before, so that a gap is its binary digits."""
    each = [F.when(F.floor(ticks / length) % 2 == 1, _note(F.lit(name), F.lit(False), False, F.array().cast("array<string>"))) for name, length in sorted(DURATION_TICKS.items(), key=lambda x: -x[1])]
    return F.array_compact(F.array(*each))


def _closed(bar: Column) -> Column:
    """The notes of an open bar, with those of its triplet group."""
    group = F.array(*[_note(bar["written"], F.lit(False), True, bar[f"p{k}"]) for k in range(3)])
    return F.when(bar["span"] > 0, F.concat(bar["notes"], group)).otherwise(bar["notes"])


def _write(bar: Column, e: Column) -> Column:
    """One predicted note more: into the open group, as the first of a group, or as a plain note."""
    inside = (bar["span"] > 0) & (e["onset"] < bar["start"] + bar["span"])
    own = (F.floor(e["onset"] / e["span"]) * e["span"]).cast("int")
    opens = ~inside & e["triplet"] & (own >= bar["at"])
    start, span = F.when(inside, bar["start"]).otherwise(own), F.when(inside, bar["span"]).otherwise(e["span"])
    place = F.least(F.lit(2), F.floor((e["onset"] - start) * 3 / span + 0.5))
    held = [F.when(inside, bar[f"p{k}"]).otherwise(F.array().cast("array<string>")) for k in range(3)]
    taken = F.size(F.get(F.array(*held), place.cast("int"))) > 0
    places = [F.when((inside | opens) & (place == k), F.array_distinct(F.concat(held[k], e["drums"]))).otherwise(held[k]).alias(f"p{k}") for k in range(3)]
    room = F.least(e["full"], e["next"] - e["onset"])
    plain = reduce(lambda found, x: F.when(room >= x[0], F.struct(F.lit(x[0]).alias("ticks"), F.lit(x[1]).alias("written"), F.lit(x[2]).alias("dotted"))).otherwise(found), reversed(_PLAIN), F.lit(None).cast("struct<ticks:int,written:string,dotted:boolean>"))
    written = F.concat(_closed(bar), _rests(e["onset"] - bar["at"]), F.array(_note(plain["written"], plain["dotted"], False, F.array_distinct(e["drums"]))))
    notes = F.when(inside, bar["notes"]).when(opens, F.concat(_closed(bar), _rests(own - bar["at"]))).otherwise(written)
    at = F.when(inside, bar["at"]).when(opens, own + e["span"]).otherwise(e["onset"] + plain["ticks"])
    alone = ~inside & ~opens
    codes = F.array_compact(F.array(F.when(alone & e["triplet"], "triplet_unplaced"), F.when(~alone & ~e["triplet"], "merged_into_triplet").when(~alone & taken, "merged_into_chord"), F.when(alone & (e["full"] > e["next"] - e["onset"]), "shortened")))
    warnings = F.concat(bar["warnings"], F.transform(codes, lambda c: F.struct(c.alias("code"), e["position"].alias("position"))))
    group = F.when(inside, bar["written"]).otherwise(e["written"])
    return F.struct(at.cast("int").alias("at"), notes.alias("notes"), warnings.alias("warnings"), start.cast("int").alias("start"), F.when(inside | opens, span).otherwise(0).cast("int").alias("span"), group.alias("written"), *places).cast(_OPEN)


def bars_from_predictions(notes: DataFrame) -> DataFrame:
    """PB2: notes that pass validate_predictions -> item_id, notes of 192 ticks in all, warnings.

    A fold over each bar's notes. A duration is kept where it ends before the next note, else shortened; gaps
    become rests; a triplet note opens the group of its beat, which takes what else falls into it, or
    is written as a plain one where that beat has begun under the note before.
    """
    shape = lambda i, default: lookup(F.col("duration"), {name: x[i] for name, x in MODEL_SHAPES.items()}, default)
    ticks = lookup(shape(0, F.lit(None).cast("string")), DURATION_TICKS)
    shaped = notes.withColumns({"written": shape(0, F.lit(None).cast("string")), "triplet": shape(2, F.lit(False)), "span": (ticks * 2).cast("int"), "full": F.floor(ticks * F.when(shape(1, F.lit(False)), 3).otherwise(2) / 2).cast("int"), "onset": (F.col("position") * SLOT_TICKS).cast("int"), "position": F.col("position").cast("int")})
    nested = shaped.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("position", "onset", "written", "triplet", "span", "full", "drums"))).alias("n"))
    followed = F.transform("n", lambda e, i: F.struct(*[e[c].alias(c) for c in ("position", "onset", "written", "triplet", "span", "full", "drums")], F.coalesce(F.get(F.col("n"), i + 1)["onset"], F.lit(BAR_TICKS)).alias("next")))
    none = F.array().cast("array<string>")
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_NOTE}>").alias("notes"), F.array().cast(f"array<{_WARNING}>").alias("warnings"), F.lit(0).alias("start"), F.lit(0).alias("span"), F.lit("").alias("written"), none.alias("p0"), none.alias("p1"), none.alias("p2")).cast(_OPEN)
    done = nested.select("item_id", F.aggregate(followed, empty, _write).alias("b"))
    return done.select("item_id", F.concat(_closed(F.col("b")), _rests(F.lit(BAR_TICKS) - F.col("b.at"))).alias("notes"), F.col("b.warnings").alias("warnings"))


def _asked(requests: DataFrame) -> DataFrame:
    """requests(request_id, score_id, from_bar, to_bar, tempo_bpm, count_in_beats) in 4/4 with seconds of a tick and lead-in ticks."""
    return requests.withColumns({"tick_s": F.lit(60.0) / (F.col("tempo_bpm") * TICKS_PER_BEAT), "lead": F.col("count_in_beats") * TICKS_PER_BEAT})


def playback_hits(events: DataFrame, requests: DataFrame) -> DataFrame:
    """PB3: (request_id, ticks, time, drum, bar_number, event_idx); bars keep their full length, the count-in shifts all."""
    at = F.col("lead") + (F.col("bar_number") - F.col("from_bar")) * BAR_TICKS + F.col("onset_ticks")
    rows = in_ranges(events, _asked(requests), ["score_id"], "bar_number", "from_bar", "to_bar")
    return rows.select("request_id", at.cast("long").alias("ticks"), (at * F.col("tick_s")).alias("time"), F.explode("drums").alias("drum"), "bar_number", "event_idx")


def playback_clicks(requests: DataFrame, beats: int = 4) -> DataFrame:
    """PB4: metronome (where asked) and count-in clicks; the first of a bar has the accent."""
    q = _asked(requests)
    passage = (F.col("to_bar") - F.col("from_bar") + 1) * beats
    lead = q.where("count_in_beats > 0").select("request_id", "tick_s", F.explode(F.expr("sequence(0, cast(count_in_beats as int) - 1)")).alias("beat"), F.lit(0).alias("base"), F.lit(True).alias("count_in"))
    main = q.where("metronome").select("request_id", "tick_s", F.explode(F.sequence(F.lit(0), (passage - 1).cast("int"))).alias("beat"), F.col("lead").cast("int").alias("base"), F.lit(False).alias("count_in"))
    ticks = F.col("base") + F.col("beat") * TICKS_PER_BEAT
    return lead.unionByName(main).select("request_id", ticks.cast("long").alias("ticks"), (ticks * F.col("tick_s")).alias("time"), (F.col("beat") % beats == 0).alias("accent"), "count_in")


def events_between(hits: DataFrame, requests: DataFrame, windows: DataFrame) -> DataFrame:
    """PB5: windows(request_id, from_s, to_s, loop) -> hits in [from_s, to_s) with the pass they belong to; loops are bounded by the window's length."""
    q = _asked(requests).select("request_id", ((F.col("to_bar") - F.col("from_bar") + 1) * BAR_TICKS * F.col("tick_s")).alias("loop_s"))
    rows = hits.join(windows.join(q, "request_id"), "request_id")
    first = F.greatest(F.lit(0), F.ceil((F.col("from_s") - F.col("time")) / F.col("loop_s")) - 1)
    last = F.ceil((F.col("to_s") - F.col("time")) / F.col("loop_s")) + 1
    passes = F.when(F.col("loop"), F.sequence(first, F.greatest(first, last))).otherwise(F.array(F.lit(0).cast("long")))
    return rows.withColumn("pass", F.explode(passes)).withColumn("time", F.col("time") + F.col("pass") * F.col("loop_s")).where((F.col("time") >= F.col("from_s")) & (F.col("time") < F.col("to_s"))).select("request_id", "time", "drum", "bar_number", "event_idx", "pass")


def position_at(events: DataFrame, requests: DataFrame, probes: DataFrame) -> DataFrame:
    """PB6: probes(request_id, probe_s) -> the bar and event that sound there, and the pass; none before the passage, or after it without a loop."""
    q = _asked(requests).withColumns({"begin": F.col("lead") * F.col("tick_s"), "loop_s": (F.col("to_bar") - F.col("from_bar") + 1) * BAR_TICKS * F.col("tick_s")})
    p = probes.join(q, "request_id").where("probe_s >= begin")
    turn = F.when(F.col("loop"), F.floor((F.col("probe_s") - F.col("begin")) / F.col("loop_s"))).otherwise(0)
    inside = (F.col("probe_s") - F.col("begin") - F.col("turn") * F.col("loop_s")) / F.col("tick_s")
    p = p.withColumn("turn", turn).withColumn("ticks", F.floor(inside + 1e-6)).where(F.col("ticks") < (F.col("to_bar") - F.col("from_bar") + 1) * BAR_TICKS)
    # The bar is plain arithmetic, so the as-of join is an equi-join on the bar and the latest onset in it.
    p = p.withColumns({"bar_number": (F.col("from_bar") + F.floor(F.col("ticks") / BAR_TICKS)).cast("int"), "in_bar": F.col("ticks") % BAR_TICKS})
    found = p.join(events.select("score_id", "bar_number", "event_idx", "onset_ticks"), ["score_id", "bar_number"]).where("onset_ticks <= in_bar")
    return found.groupBy("request_id", "probe_s").agg(F.first("bar_number").alias("bar_number"), F.max_by("event_idx", "onset_ticks").alias("event_idx"), F.first("turn").cast("long").alias("pass"))


def midi_events(events: DataFrame) -> DataFrame:
    """PB7: note-ons and note-offs at 480 a quarter in the order of a track, with the delta to the event before."""
    at = ((F.col("bar_number") - 1) * BAR_TICKS + F.col("onset_ticks")) * 10
    note = events.select("score_id", at.cast("long").alias("on"), (at + F.greatest(F.lit(1), F.col("duration_ticks") * 10 - 1)).cast("long").alias("off"), F.explode("drums").alias("drum")).withColumn("note", lookup(F.col("drum"), GM_NOTES))
    both = note.select("score_id", "note", F.explode(F.array(F.struct(F.col("on").alias("time"), F.lit(1).alias("kind")), F.struct(F.col("off").alias("time"), F.lit(0).alias("kind")))).alias("e")).select("score_id", "e.time", "e.kind", "note")
    before = F.lag("time", 1, 0).over(Window.partitionBy("score_id").orderBy("time", "kind", "note"))
    return both.withColumn("delta", F.col("time") - before)
