"""Label building: raw note events of all voices -> one row a bar (LB1-LB10).

raw_beats: song, kind (gp5, gp7), track, percussion, clef, bar, time_signature, voice, ord, note_value, dotted,
tuplet_num, tuplet_den, is_rest, grace, pitches array<struct<midi int, ghost boolean>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwise.functions.notation import PITCH_DRUMS, lookup

WHOLE = 80_640  # a whole note in ticks that 128ths, dots and 3-, 5-, 6-, 7- and 9-tuplets divide
# Names of note values and tuplets.
VALUE_NAMES = {1: "whole", 2: "half", 4: "quarter", 8: "eighth", 16: "sixteenth", 32: "thirty_second", 64: "sixty_fourth", 128: "hundred_twenty_eighth"}
TUPLET_NAMES = {3: "triplet", 5: "quintuplet", 6: "sextuplet", 7: "septuplet"}


def select_drum_track(raw: DataFrame) -> DataFrame:
    """LB1: the first percussion track of a gp5 song; of a gp7 song the track of its first neutral clef, by bar, then track."""
    wanted = raw.where(((F.col("kind") == "gp5") & F.col("percussion")) | ((F.col("kind") == "gp7") & (F.lower("clef") == "neutral")))
    chosen = wanted.groupBy("song").agg(F.min_by("track", F.when(F.col("kind") == "gp5", F.struct(F.lit(0).alias("bar"), "track")).otherwise(F.struct("bar", "track"))).alias("track"))
    return raw.join(chosen, ["song", "track"])


def with_beat_length(raw: DataFrame) -> DataFrame:
    """LB2: exact length in ticks of 1/80640 of a whole note; null where that is no whole number."""
    num = F.lit(WHOLE) * F.when(F.col("dotted"), 3).otherwise(2) * F.coalesce("tuplet_den", F.lit(1))
    den = F.col("note_value") * 2 * F.coalesce("tuplet_num", F.lit(1))
    return raw.withColumn("length", F.when((num % den) == 0, (num / den).cast("long")))


def with_onsets(raw: DataFrame) -> DataFrame:
    """LB3: onset of each beat, the running sum of the lengths before it in its voice."""
    before = Window.partitionBy("song", "bar", "voice").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return raw.withColumn("onset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def merge_voices(raw: DataFrame) -> DataFrame:
    """LB4: one row an onset: union of pitches, a note beats a rest, flam if any; the shortest written value wins, the first on ties.

    In gp7 songs a rest counts for the value only where it arrives first.
    """
    arrival = F.row_number().over(Window.partitionBy("song", "bar", "onset").orderBy("voice", "ord"))
    seen = raw.withColumn("arrival", arrival)
    counts = (F.col("kind") == "gp5") | ~F.col("is_rest") | (F.col("arrival") == 1)
    shape = F.struct("note_value", "dotted", "tuplet_num", "tuplet_den")
    best = F.min_by(F.when(counts, shape), F.when(counts, F.struct((-F.col("note_value")).alias("v"), "arrival")))
    return seen.groupBy("song", "bar", "onset").agg(F.first("time_signature").alias("time_signature"), best.alias("shape"), F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("is_rest"), F.col("pitches"))))).alias("pitches"), F.bool_and("is_rest").alias("is_rest"), F.bool_or("grace").alias("flam")).select("song", "bar", "onset", "time_signature", "shape.*", "pitches", "is_rest", "flam")


def map_drums(pitches: Column) -> Column:
    """LB5: sorted distinct drum names; midi<N> for an unknown pitch, _ghost for ghost notes."""
    return F.array_sort(F.array_distinct(F.transform(pitches, lambda p: F.concat(lookup(p["midi"], PITCH_DRUMS, F.concat(F.lit("midi"), p["midi"].cast("string"))), F.when(p["ghost"], "_ghost").otherwise("")))))


def duration_name(value: Column, dotted: Column, num: Column, den: Column) -> Column:
    """LB6: dotted_triplet_eighth and the like."""
    tuplet = F.when(num != den, lookup(num, TUPLET_NAMES, F.concat(num.cast("string"), F.lit("tuplet"))))
    return F.concat_ws("_", F.when(dotted, "dotted"), tuplet, lookup(value, VALUE_NAMES, value.cast("string")))


def beat_position(onset: Column) -> Column:
    """LB7: 1, 1.5, 2.25, ... on the eighth-of-a-beat grid, half to even."""
    eighths = F.rint(8 + onset * 32 / WHOLE).cast("long")
    return F.when(eighths % 8 == 0, (eighths / 8).cast("long").cast("string")).otherwise((eighths / 8).cast("string"))


def build_bar_labels(raw: DataFrame, bars: DataFrame) -> DataFrame:
    """LB8, LB9: bars(song, bar, time_signature) -> song, bar, time_signature, beats, simile; bars without events stay.

    simile: no events, or only rests of whole notes.
    """
    # Dealt by bar once: windows by voice and onset and both groupings keep that, and the bars' table meets it.
    dealt = select_drum_track(raw).repartition("song", "bar")
    merged = merge_voices(with_onsets(with_beat_length(dealt)))
    beat = F.struct("onset", beat_position(F.col("onset")).alias("beat"), duration_name(F.col("note_value"), F.col("dotted"), F.coalesce("tuplet_num", F.lit(1)), F.coalesce("tuplet_den", F.lit(1))).alias("duration"), F.when(F.col("is_rest"), F.array().cast("array<string>")).otherwise(map_drums(F.col("pitches"))).alias("drums"), F.col("is_rest").alias("rest"), F.col("flam").alias("flam"))
    built = merged.groupBy("song", "bar").agg(F.array_sort(F.collect_list(beat)).alias("beats"), F.bool_and(F.col("is_rest") & (F.col("note_value") == 1)).alias("simile"))
    tidy = F.transform(F.coalesce("beats", F.array().cast(built.schema["beats"].dataType)), lambda b: F.struct(b["beat"].alias("beat"), b["duration"].alias("duration"), b["drums"].alias("drums"), b["rest"].alias("rest"), b["flam"].alias("flam")))
    return bars.join(built, ["song", "bar"], "left").select("song", "bar", "time_signature", tidy.alias("beats"), F.coalesce("simile", F.lit(True)).alias("simile"))


def unmapped_pitches(raw: DataFrame) -> DataFrame:
    """LB10: how often each unknown pitch sounds, by song and bar."""
    return raw.where(~F.col("is_rest")).select("song", "bar", F.explode("pitches").alias("p")).where(~F.col("p.midi").isin(*PITCH_DRUMS)).groupBy("song", "bar", F.col("p.midi").alias("midi")).agg(F.count(F.lit(1)).alias("n"))
