"""Vocabularies of drum notation and column expressions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_PER_BEAT, BAR_TICKS, SLOTS, SLOT_TICKS = 48, 192, 32, 6

# The order of drums and durations in a recogniser's output.
DRUMS = ("hi_hat_closed", "snare", "kick", "ride", "crash", "hi_hat_open_half", "hi_hat_open_full", "hi_hat_pedal", "floor_tom_1", "floor_tom_2", "tom_mid", "tom_hi", "ride_bell", "snare_rim")
DURATIONS = ("whole", "half", "dotted_quarter", "quarter", "dotted_eighth", "eighth", "sixteenth", "thirty_second", "triplet_eighth", "triplet_sixteenth")
# Ticks of written durations, and the names people say.
DURATION_TICKS = {"32": 6, "16": 12, "8": 24, "q": 48, "h": 96, "w": 192}
NOTE_NAMES = {"32": "32nd", "16": "16th", "8": "8th", "q": "quarter", "h": "half", "w": "whole"}
# Model duration name -> (written duration, dotted, triplet).
MODEL_SHAPES = {
    "whole": ("w", False, False),
    "half": ("h", False, False),
    "dotted_quarter": ("q", True, False),
    "quarter": ("q", False, False),
    "dotted_eighth": ("8", True, False),
    "eighth": ("8", False, False),
    "sixteenth": ("16", False, False),
    "thirty_second": ("32", False, False),
    "triplet_eighth": ("8", False, True),
    "triplet_sixteenth": ("16", False, True),
}
# Groups of drums.
FOOT = ("kick", "hi_hat_pedal")
TOMS = ("tom_hi", "tom_mid", "floor_tom_1", "floor_tom_2")
HI_HATS = ("hi_hat_closed", "hi_hat_open_half", "hi_hat_open_full", "hi_hat_pedal")
CYMBALS = ("crash", "ride", "ride_bell")
# General MIDI percussion notes to write, and pitches read from tablature files.
GM_NOTES = {"kick": 36, "snare": 38, "snare_rim": 37, "hi_hat_closed": 42, "hi_hat_pedal": 44, "hi_hat_open_half": 46, "hi_hat_open_full": 46, "crash": 49, "ride": 51, "ride_bell": 53, "tom_hi": 50, "tom_mid": 47, "floor_tom_1": 43, "floor_tom_2": 41}
PITCH_DRUMS = {
    31: "sticks", 35: "kick", 36: "kick", 37: "snare_rim", 38: "snare", 39: "clap", 40: "snare", 41: "floor_tom_2", 42: "hi_hat_closed", 43: "floor_tom_1",
    44: "hi_hat_pedal", 45: "tom_mid", 46: "hi_hat_open_half", 47: "tom_mid", 48: "tom_hi", 49: "crash", 50: "tom_hi", 51: "ride", 52: "china", 53: "ride_bell",
    54: "crash", 55: "splash", 56: "cowbell", 57: "crash", 59: "ride", 91: "snare_rimshot", 92: "hi_hat_open_full", 93: "ride_tie", 96: "choked_crash", 97: "choked_crash", 98: "choked_crash",
}


def lookup(column: Column, values: dict, default: Column | None = None) -> Column:
    """The value of a small fixed map, null or the default for other keys."""
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
    found = F.try_element_at(F.create_map(*pairs), column)
    return found if default is None else F.coalesce(found, default)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def half_up(x: Column) -> Column:
    """floor(x + 0.5), the rounding of scripting languages."""
    return F.floor(x + F.lit(0.5))


def round2(x: Column) -> Column:
    return half_up(x * 100) / F.lit(100.0)


def tenth_percent(a: Column, b: Column) -> Column:
    """Percentage of a in b to one decimal, half up; null where b is 0."""
    return F.when(b != 0, half_up(a * F.lit(1000.0) / b) / F.lit(10.0))


def note_ticks(duration: Column, dotted: Column, triplet: Column) -> Column:
    """Length of a note: half as long again when dotted, two thirds in a triplet."""
    base = lookup(duration, DURATION_TICKS)
    return F.when(dotted, base * 3 / 2).when(triplet, base * 2 / 3).otherwise(base).cast("int")


def count_label(onset: Column) -> Column:
    """1, 1e, 1&, 1a, 2trip, 2let, 3 (32nd), 3 (triplet 16th)."""
    beat = F.floor(onset / TICKS_PER_BEAT).cast("int") + 1
    off = onset % TICKS_PER_BEAT
    tail = F.when(off == 0, "")
    for at, word in ((12, "e"), (24, "&"), (36, "a"), (16, "trip"), (32, "let")):
        tail = tail.when(off == at, word)
    return F.concat(beat.cast("string"), tail.when(off % 6 == 0, " (32nd)").otherwise(" (triplet 16th)"))


def duration_label(duration: Column, dotted: Column, triplet: Column) -> Column:
    return F.concat(F.when(dotted, "dotted ").otherwise(""), F.when(triplet, "triplet ").otherwise(""), lookup(duration, NOTE_NAMES))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def texts(*options: Column) -> Column:
    """The texts that are not null, in order."""
    return F.array_compact(F.array(*options))
