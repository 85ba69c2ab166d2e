"""Score documents -> events, and checks of both (SC1-SC10).

events: score_id, bar_number, event_idx, onset_ticks, duration_ticks, written_duration, dotted, triplet,
drums array<string>, is_rest. A bar holds 64 events at most, so nesting a bar into one row is bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwise.functions.frames import in_ranges
from tickwise.functions.notation import BAR_TICKS, DRUMS, DURATION_TICKS, note_ticks, strings

EVENT_FIELDS = ("event_idx", "onset_ticks", "duration_ticks", "written_duration", "dotted", "triplet", "drums", "is_rest")
BAR = ["score_id", "bar_number"]


def score_events(scores: DataFrame) -> DataFrame:
    """SC2: nested scores(score_id, bars array<struct<bar_id, notes array<struct<event_id, duration, dotted, triplet, drums>>>>) -> events.

    Onsets are running sums inside the bar's array, so nothing is shuffled. Empty bars give no events.
    """
    ticks = lambda n: note_ticks(n["duration"], n["dotted"], F.coalesce(n["triplet"], F.lit(False)))
    bar = scores.select("score_id", F.posexplode("bars").alias("at", "bar")).select("score_id", (F.col("at") + 1).alias("bar_number"), F.col("bar.bar_id").alias("bar_id"), F.col("bar.notes").alias("notes"))
    note = bar.select(*BAR, "bar_id", "notes", F.posexplode("notes").alias("event_idx", "note"))
    onset = F.aggregate(F.slice("notes", F.lit(1), F.col("event_idx")), F.lit(0), lambda s, n: s + ticks(n))
    drums = F.array_sort("note.drums")
    return note.select(*BAR, "bar_id", "event_idx", F.col("note.event_id").alias("event_id"), onset.alias("onset_ticks"), ticks(F.col("note")).alias("duration_ticks"), F.col("note.duration").alias("written_duration"), F.col("note.dotted").alias("dotted"), F.coalesce("note.triplet", F.lit(False)).alias("triplet"), drums.alias("drums"), (F.size(drums) == 0).alias("is_rest"))


def bar_events(events: DataFrame, *extra: str) -> DataFrame:
    """(score_id, bar_number, ev): ev array<struct<event fields>> in order. One shuffle, by bar; none where events come so nested."""
    if "ev" in events.columns:
        return events.select(*BAR, "ev", *extra)
    return events.groupBy(*BAR).agg(F.sort_array(F.collect_list(F.struct(*EVENT_FIELDS))).alias("ev"), *[F.first(c).alias(c) for c in extra])


def bar_rows(events: DataFrame, *extra: str) -> DataFrame:
    """bar_events() and the columns derived from ev."""
    return with_bar_columns(bar_events(events, *extra))


def with_bar_columns(bars: DataFrame) -> DataFrame:
    """hits (sounding events), keys (distinct onset:drum pairs), smallest event, triplet groups and fill of each bar."""
    hits = F.filter("ev", lambda e: ~e["is_rest"])
    keys = F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda e: F.transform(e["drums"], lambda d: F.concat(F.lpad(e["onset_ticks"].cast("string"), 3, "0"), F.lit(":"), d))))))
    smallest = F.aggregate("ev", F.lit(None).cast(bars.schema["ev"].dataType.elementType), lambda s, e: F.when(s.isNull() | (e["duration_ticks"] < s["duration_ticks"]), e).otherwise(s))
    return bars.withColumn("hits", hits).withColumns({"keys": keys, "smallest": smallest, "triplet_groups": triplet_groups(F.col("ev")), "filled": F.aggregate("ev", F.lit(0), lambda s, e: s + e["duration_ticks"])})


def triplet_groups(ev: Column) -> Column:
    """SC4: greedy runs of three triplet notes of one written duration, as a count."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("run"), F.lit("").alias("kind"))

    def step(s, e):
        run = F.when(~e["triplet"], 0).when(e["written_duration"] == s["kind"], s["run"] + 1).otherwise(1)
        return F.struct((s["n"] + F.when(run == 3, 1).otherwise(0)).alias("n"), F.when(run == 3, 0).otherwise(run).alias("run"), F.when(e["triplet"], e["written_duration"]).otherwise("").alias("kind"))

    return F.aggregate(ev, start, step, lambda s: s["n"])


def bar_fill(events: DataFrame, capacity: int = BAR_TICKS) -> DataFrame:
    """SC3: total ticks of each bar against the meter's capacity."""
    return events.groupBy(*BAR).agg(F.sum("duration_ticks").cast("long").alias("filled_ticks")).withColumn("state", F.when(F.col("filled_ticks") > capacity, "overfull").when(F.col("filled_ticks") < capacity, "incomplete").otherwise("full"))


def validate_events(events: DataFrame, capacity: int = BAR_TICKS) -> DataFrame:
    """SC6: (score_id, bar_number, event_idx, problem); event_idx is null for problems of a bar."""
    in_bar = Window.partitionBy(*BAR).orderBy("event_idx")
    expected = note_ticks(F.col("written_duration"), F.col("dotted"), F.col("triplet"))
    checked = events.withColumn("expected", expected).withColumn("onset", F.coalesce(F.sum(F.coalesce("expected", F.lit(0))).over(in_bar.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    problems = F.array_compact(F.array(
        F.when(F.col("expected").isNull(), "unknown duration"),
        F.when(~F.col("onset_ticks").eqNullSafe(F.col("onset")), "onset does not follow the events before"),
        F.when(F.col("expected").isNotNull() & ~F.col("duration_ticks").eqNullSafe(F.col("expected")), "ticks do not match the written duration"),
        F.when(F.col("drums").isNull() | (F.size(F.array_except("drums", strings(DRUMS))) > 0), "unknown drum"),
        F.when(~F.col("is_rest").eqNullSafe(F.size("drums") == 0), "rest flag does not match the drums"),
    ))
    rows = checked.select(*BAR, F.col("event_idx").cast("int").alias("event_idx"), F.explode(problems).alias("problem"))
    numbers = events.select(*BAR).distinct().withColumn("before", F.lag("bar_number").over(Window.partitionBy("score_id").orderBy("bar_number")))
    none = F.lit(None).cast("int").alias("event_idx")
    gaps = numbers.where("before is not null and bar_number <> before + 1").select(*BAR, none, F.lit("bar numbers do not run on").alias("problem"))
    over = bar_fill(events, capacity).where("state = 'overfull'").select(*BAR, none, F.lit("events overfill the bar").alias("problem"))
    return rows.unionByName(gaps).unionByName(over)


def validate_scores(scores: DataFrame, max_bars: int = 2000) -> DataFrame:
    """SC5: (score_id, place, problem) for nested scores(score_id, revision, title, tempo_bpm, meter, bars)."""
    is_id = lambda c: c.rlike("^[A-Za-z0-9_-]{1,64}$")
    head = F.array_compact(F.array(
        F.when(~F.coalesce(is_id(F.col("score_id")), F.lit(False)), "score id is not 1-64 letters, digits, - or _"),
        F.when(F.coalesce(F.col("revision") < 0, F.lit(True)), "revision is not 0 or more"),
        F.when(F.coalesce(F.length("title") > 200, F.lit(True)), "title is missing or too long"),
        F.when(F.coalesce(~F.col("tempo_bpm").between(20, 300), F.lit(True)), "tempo is not 20-300"),
        F.when(F.coalesce(~(F.col("meter.beats").between(1, 32) & F.col("meter.beat_unit").isin(1, 2, 4, 8, 16, 32)), F.lit(True)), "meter is not supported"),
        F.when(F.coalesce(~F.size("bars").between(1, max_bars), F.lit(True)), "number of bars is out of range"),
    ))
    top = scores.select("score_id", F.lit("score").alias("place"), F.explode(head).alias("problem"))
    bars = scores.select("score_id", "meter", F.posexplode("bars").alias("at", "bar")).withColumn("place", F.concat(F.lit("bar "), (F.col("at") + 1).cast("string")))
    notes = bars.select("score_id", "place", F.posexplode("bar.notes").alias("i", "note")).withColumn("place", F.concat("place", F.lit(" note "), (F.col("i") + 1).cast("string")))
    drums = F.coalesce("note.drums", F.array().cast("array<string>"))
    bad_note = F.array_compact(F.array(
        F.when(~F.coalesce(is_id(F.col("note.event_id")), F.lit(False)), "event id is not valid"),
        F.when(~F.coalesce(F.col("note.duration").isin(*DURATION_TICKS), F.lit(False)), "unknown duration"),
        F.when(F.col("note.drums").isNull(), "drums is not a list"),
        F.when(F.size(F.array_except(drums, strings(DRUMS))) > 0, "unknown drum"),
        F.when(F.size(F.array_distinct(drums)) < F.size(drums), "a drum repeats"),
        F.when(F.col("note.dotted") & (F.col("note.duration") == "32"), "a dotted 32nd is not supported"),
        F.when(F.col("note.dotted") & F.col("note.triplet"), "a dotted triplet is not supported"),
    ))
    note_rows = notes.select("score_id", "place", F.explode(bad_note).alias("problem"))
    ids = bars.select("score_id", F.col("bar.bar_id").alias("id")).unionByName(notes.select("score_id", F.col("note.event_id").alias("id"))).where("id is not null")
    twice = ids.groupBy("score_id", "id").count().where("count > 1").select("score_id", F.concat(F.lit("id "), "id").alias("place"), F.lit("id repeats").alias("problem"))
    bad_bar = F.array_compact(F.array(F.when(~F.coalesce(is_id(F.col("bar.bar_id")), F.lit(False)), "bar id is not valid"), F.when(~F.coalesce(F.col("bar.provenance.source").isin("manual", "local_omr", "openai_omr"), F.lit(False)), "unknown source"), F.when(F.col("bar.provenance.reviewed").isNull(), "reviewed is missing")))
    bar_level = bars.select("score_id", "place", F.explode(bad_bar).alias("problem"))
    events = score_events(scores).join(notes_ok(note_rows), "score_id", "left_anti")
    per_bar = events.groupBy(*BAR).agg(F.array_sort(F.collect_list(F.struct("event_idx", "written_duration", "dotted", "triplet"))).alias("ev"), F.sum("duration_ticks").alias("filled"), F.count_if("triplet").alias("triplets")).join(scores.select("score_id", (F.col("meter.beats") * 192 / F.col("meter.beat_unit")).alias("capacity")), "score_id")
    timing = per_bar.select("score_id", F.concat(F.lit("bar "), F.col("bar_number").cast("string")).alias("place"), F.explode(F.array_compact(F.array(F.when(F.col("triplets") != 3 * triplet_groups(F.col("ev")), "a triplet note is outside a group of three"), F.when(F.col("filled") > F.col("capacity"), "notes overfill the bar")))).alias("problem"))
    return reduce(DataFrame.unionByName, [top, bar_level, note_rows, twice, timing])


def notes_ok(problems: DataFrame) -> DataFrame:
    """Scores whose notes are malformed: timing is not checked there."""
    return problems.select("score_id").distinct()


def slice_bars(events: DataFrame, requests: DataFrame, most: int = 64) -> DataFrame:
    """SC7: requests(request_id, score_id, from_bar, to_bar) -> their events, at most `most` bars, with a truncated flag."""
    last = events.groupBy("score_id").agg(F.max("bar_number").alias("last"))
    asked = requests.join(last, "score_id").withColumns({"lo": F.greatest(F.least("from_bar", "to_bar"), F.lit(1)), "hi": F.least(F.greatest("from_bar", "to_bar"), "last")}).withColumn("cut", F.least("hi", F.col("lo") + (most - 1)))
    shown = asked.select("request_id", "score_id", "lo", "cut", ((F.col("lo") > 1) | (F.col("cut") < F.col("last"))).alias("truncated"))
    return in_ranges(events, shown, ["score_id"], "bar_number", "lo", "cut").drop("lo", "cut")


def score_hash(events: DataFrame) -> DataFrame:
    """SC8: SHA-256 of a canonical text of each score's events."""
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ("bar_number", "event_idx", "onset_ticks", "duration_ticks", "written_duration", "dotted", "triplet")], F.array_join("drums", "+"))
    # Bars are hashed first, so that a score's row holds one digest a bar.
    bars = events.groupBy(*BAR).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("event_idx", text.alias("t"))))["t"], "|"), 256).alias("h"))
    return bars.groupBy("score_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("bar_number", "h")))["h"], "|"), 256).alias("content_hash"))


def review_summary(bars: DataFrame) -> DataFrame:
    """SC9: bars(score_id, bar_number, reviewed, warning_count) -> counts and the bars still to check."""
    todo = F.col("reviewed") == F.lit(False)
    return bars.groupBy("score_id").agg(F.count_if(todo).alias("unreviewed"), F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.when(todo, F.col("warning_count"))), F.lit(0)).cast("long").alias("warnings"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(todo, F.col("bar_number")))), lambda x: x.cast("string")), ",").alias("bars"))


def next_unreviewed(bars: DataFrame, positions: DataFrame) -> DataFrame:
    """SC9: positions(score_id, from_bar) -> the next bar to check after it, wrapping round; null when all are checked.

    Where numbers are missing, a bar ahead and one from the start may be equally far: the one ahead comes first.
    """
    count = bars.groupBy("score_id").agg(F.count(F.lit(1)).alias("n"))
    todo = bars.where("reviewed = false").select("score_id", "bar_number")
    away = F.pmod(F.col("bar_number") - F.col("from_bar") - 1, F.col("n"))
    return positions.join(count, "score_id").join(todo, "score_id", "left").groupBy("score_id", "from_bar").agg(F.min_by("bar_number", F.struct(away, F.col("bar_number") <= F.col("from_bar"), "bar_number")).alias("next_bar"))


def describe_bars(events: DataFrame) -> DataFrame:
    """SC10: one plain sentence a bar, drums in the order they are first heard."""
    bars = bar_rows(events)
    drums = F.array_distinct(F.flatten(F.transform("hits", lambda e: e["drums"])))
    n = F.size("hits")
    body = F.when(n == 0, "rests only").otherwise(F.concat(n.cast("string"), F.when(n == 1, " note - ").otherwise(" notes - "), F.array_join(F.transform(drums, lambda d: F.translate(d, "_", " ")), ", ")))
    return bars.select(*BAR, F.concat(F.lit("Bar "), F.col("bar_number").cast("string"), F.lit(": "), body).alias("line"))
