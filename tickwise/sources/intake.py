"""Type-aware intake of JSON texts (IO1, IO3, SC5): what a value is comes before what it is worth.

A text is parsed once to a VARIANT. A typed reading (from_json) turns a value of another type into a null or
a text; here each value keeps its type until it is compared with what its field allows, so a row that does
not fit is a row of problems. All checks of a text are expressions over its one row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.functions.frames import settled
from tickwise.functions.notation import DRUMS, DURATION_TICKS, strings
from tickwise.operators.scores import triplet_groups

# The fields, limits and defaults of a saved score.
FIELDS = {"score": ("schemaVersion", "scoreId", "revision", "title", "tempoBpm", "meter", "bars"), "bar": ("barId", "provenance", "notes"), "note": ("eventId", "duration", "dotted", "triplet", "drums"), "provenance": ("source", "reviewed", "warnings", "model")}
SOURCES = ("manual", "local_omr", "openai_omr")
METER_UNITS = (1, 2, 4, 8, 16, 32)
MAX_BARS, MAX_TITLE, MAX_WARNINGS, MAX_WARNING, MAX_MODEL, TEMPO = 2000, 200, 50, 500, 100, (20, 300)
DEFAULT_TITLE, DEFAULT_TEMPO = "Untitled score", 90
_ID = "^[A-Za-z0-9_-]{1,64}$"


def as_map(v: Column) -> Column:
    """An object's fields, null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_list(v: Column) -> Column:
    """An array's elements, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def field(m: Column, name: str) -> Column:
    """A field of an object: null where it is absent (a JSON null is a value)."""
    return F.try_element_at(m, F.lit(name))


def type_of(v: Column) -> Column:
    """STRING, BOOLEAN, VOID (a JSON null), a kind of number, ARRAY<...> or OBJECT<...>; null where it is absent."""
    return F.schema_of_variant(v)


def text_of(v: Column) -> Column:
    return F.when(type_of(v) == "STRING", F.try_variant_get(v, "$", "string"))


def number_of(v: Column) -> Column:
    return F.when(type_of(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))


def whole_of(v: Column) -> Column:
    """A number without a fraction, as scripting languages see it (5.0 is one)."""
    n = number_of(v)
    return F.when(n == F.floor(n), n.cast("long"))


def flag_of(v: Column) -> Column:
    return F.when(type_of(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def truthy(v: Column) -> Column:
    """Whether a value counts as true: not absent, null, false, zero or empty."""
    return F.coalesce(flag_of(v), number_of(v) != 0, text_of(v) != "", F.size(as_list(v)) > 0, F.size(as_map(v)) > 0, F.lit(False))


def names_of(v: Column) -> Column:
    """A list of texts; null where it is none or holds anything else."""
    items = as_list(v)
    return F.when(~F.exists(items, lambda d: type_of(d) != "STRING"), F.transform(items, lambda d: F.try_variant_get(d, "$", "string")))


# ── Labels ────────────────────────────────────────────────────────────────────


def parse_labels(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IO1: docs(raw, ...) -> (labels, rejected): the other columns, with the label's fields or a problem.

    rejected are texts that are no JSON object, have no song name or no bar of 1 or more. Labels keep what their
    values were: beats that are no list are null, an event that is no object is a null struct, drums that are no
    list of names are null, times of a beat are text (a number as it is written; anything else null), rest, flam
    and simile are what counts as true. So the reasons of TS1 are those of the raw text.
    """
    rest = [c for c in docs.columns if c not in ("song", "bar", "time_signature", "beats", "simile", "problem")]
    m = as_map(F.try_parse_json("raw"))
    rows = docs.select(*rest, m.alias("_m")).select(*rest, "_m", text_of(field(F.col("_m"), "song")).alias("song"), whole_of(field(F.col("_m"), "bar")).cast("int").alias("bar"))
    problem = F.when(F.col("_m").isNull(), "not an object").when(F.coalesce(F.col("song"), F.lit("")) == "", "no song").when(F.coalesce(F.col("bar"), F.lit(0)) < 1, "no bar number")

    def event(e: Column) -> Column:
        x = as_map(e)
        beat = field(x, "beat")
        number = F.when(number_of(beat).isNotNull(), F.try_variant_get(beat, "$", "string"))
        at = F.coalesce(text_of(beat), number, flag_of(beat).cast("int").cast("string"))
        return F.when(x.isNotNull(), F.struct(at.alias("beat"), text_of(field(x, "duration")).alias("duration"), names_of(field(x, "drums")).alias("drums"), truthy(field(x, "rest")).alias("rest"), truthy(field(x, "flam")).alias("flam")))

    rows = rows.withColumn("problem", problem)
    good = rows.where("problem is null").select(*rest, "song", "bar", text_of(field(F.col("_m"), "time_signature")).alias("time_signature"), F.transform(as_list(field(F.col("_m"), "beats")), event).alias("beats"), truthy(field(F.col("_m"), "simile")).alias("simile"))
    return good, rows.where("problem is not null").select(*rest, "problem")


# ── Scores ────────────────────────────────────────────────────────────────────


def _problems(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def _row(where: Column, what: Column | str) -> Column:
    return F.struct(where.alias("place"), (F.lit(what) if isinstance(what, str) else what).alias("problem"))


def _unknown(m: Column, of: str, where: Column) -> Column:
    return F.transform(F.array_sort(F.array_except(F.map_keys(m), strings(FIELDS[of]))), lambda k: _row(where, F.concat(F.lit("unknown field "), k)))


def _not(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def _score_problems(m: Column) -> Column:
    where = F.lit("score")
    meter = as_map(field(m, "meter"))
    bars = as_list(field(m, "bars"))
    return F.concat(_unknown(m, "score", where), _problems(
        F.when(_not(text_of(field(m, "scoreId")).rlike(_ID)), _row(where, "score id is not 1-64 letters, digits, - or _")),
        F.when(_not(whole_of(field(m, "revision")) >= 0), _row(where, "revision is not 0 or more")),
        F.when(_not(F.length(text_of(field(m, "title"))) <= MAX_TITLE), _row(where, "title is missing or too long")),
        F.when(_not(whole_of(field(m, "tempoBpm")).between(*TEMPO)), _row(where, "tempo is not 20-300")),
        F.when(_not(whole_of(field(meter, "beats")).between(1, 32) & whole_of(field(meter, "beatUnit")).isin(*METER_UNITS)), _row(where, "meter is not supported")),
        F.when(_not(F.size(bars).between(1, MAX_BARS)), _row(where, "number of bars is out of range")),
    ))


def _none() -> Column:
    return F.array().cast("array<struct<place:string,problem:string>>")


def _opened_notes(notes: Column) -> Column:
    """Each note's fields as they are typed, found once: array<struct<there, fields, has_id, id, duration, dotted, has_triplet, triplet, drums>>.

    drums are the texts of a list (null for what is none), null where they are no list.
    """
    raw = F.transform(notes, lambda n: F.struct(n.isNotNull().alias("there"), F.map_keys(n).alias("fields"), *[field(n, f).alias(f) for f in ("eventId", "duration", "dotted", "triplet")], as_list(field(n, "drums")).alias("drums")))
    return F.transform(raw, lambda n: F.struct(n["there"].alias("there"), n["fields"].alias("fields"), n["eventId"].isNotNull().alias("has_id"), text_of(n["eventId"]).alias("id"), text_of(n["duration"]).alias("duration"), flag_of(n["dotted"]).alias("dotted"), n["triplet"].isNotNull().alias("has_triplet"), flag_of(n["triplet"]).alias("triplet"), F.transform(n["drums"], text_of).alias("drums")))


def _note_problems(notes: Column, place: Column, new: Column) -> Column:
    """array<struct<problems, ok>> of _opened_notes(): problems of a note's fields, whether its length is known; new says that an absent id is filled in."""
    shortest = next(iter(DURATION_TICKS))

    def checked(n: Column, j: Column) -> Column:
        where = F.concat(place, F.lit(" note "), (j + 1).cast("string"))
        duration, dotted, triplet, drums = n["duration"], n["dotted"], n["triplet"], n["drums"]
        names = F.transform(drums, lambda d: F.coalesce(d, F.lit("?")))
        wrong = _problems(
            F.when(_not(duration.isin(*DURATION_TICKS)), _row(where, "unknown duration")),
            F.when(dotted.isNull(), _row(where, "dotted is not true or false")),
            F.when(n["has_triplet"] & triplet.isNull(), _row(where, "triplet is not true or false")),
            F.when(drums.isNull(), _row(where, "drums is not a list")),
            F.when(F.size(F.array_except(names, strings(DRUMS))) > 0, _row(where, "unknown drum")),
            F.when(F.size(F.array_distinct(names)) < F.size(names), _row(where, "a drum repeats")),
            F.when(drums.isNotNull() & dotted & (duration == shortest), _row(where, "a dotted 32nd is not supported")),
            F.when(drums.isNotNull() & dotted & triplet, _row(where, "a dotted triplet is not supported")),
        )
        bad_id = _problems(F.when(_not(n["id"].rlike(_ID)) & ~(new & ~n["has_id"]), _row(where, "event id is not valid")))
        unknown = F.transform(F.array_sort(F.array_except(n["fields"], strings(FIELDS["note"]))), lambda k: _row(where, F.concat(F.lit("unknown field "), k)))
        return F.when(n["there"], F.struct(unknown.alias("head"), bad_id.alias("id"), wrong.alias("wrong"))).otherwise(F.struct(_none().alias("head"), F.array(_row(where, "is not a note")).alias("id"), F.array(_row(where, "")).alias("wrong")))

    whole = lambda n, x: F.struct(F.when(n["there"], F.concat(x["head"], x["id"], x["wrong"])).otherwise(x["id"]).alias("problems"), (F.size(x["wrong"]) == 0).alias("ok"))
    return F.zip_with(notes, F.transform(notes, checked), whole)


def _bar_problems(x: Column, i: Column, new: Column) -> Column:
    """struct<problems, ok> of struct<b, p, notes>; ok says that timing can be checked."""
    where = F.concat(F.lit("bar "), (i + 1).cast("string"))
    b, p = x["b"], x["p"]
    warnings, model = as_list(field(p, "warnings")), field(p, "model")
    p_where = F.concat(where, F.lit(" provenance"))
    of_provenance = F.concat(_unknown(p, "provenance", p_where), _problems(
        F.when(_not(text_of(field(p, "source")).isin(*SOURCES)), _row(where, "unknown source")),
        F.when(flag_of(field(p, "reviewed")).isNull(), _row(where, "reviewed is missing")),
        F.when(_not((F.size(warnings) <= MAX_WARNINGS) & ~F.exists(warnings, lambda w: _not(F.length(text_of(w)) <= MAX_WARNING))), _row(where, "warnings are no list of short messages")),
        F.when(model.isNotNull() & _not(F.length(text_of(model)) <= MAX_MODEL), _row(where, "model is no short name")),
    ))
    provenance = F.when(new & field(b, "provenance").isNull(), _none()).when(p.isNull(), F.array(_row(where, "provenance is missing"))).otherwise(of_provenance)
    bad_id = F.when(_not(text_of(field(b, "barId")).rlike(_ID)) & ~(new & field(b, "barId").isNull()), _row(where, "bar id is not valid"))

    # Bound to a name, as the checks of the notes are looked at twice.
    each = _note_problems(x["notes"], where, new)
    notes = F.get(F.transform(F.array(F.struct(each.alias("each"))), lambda y: F.struct(F.flatten(F.transform(y["each"], lambda z: z["problems"])).alias("problems"), F.coalesce(~F.exists(y["each"], lambda z: ~z["ok"]), F.lit(False)).alias("ok"))), F.lit(0))

    def of_bar(notes: Column) -> Column:
        tail = F.when(x["notes"].isNull(), F.array(_row(where, "notes is not a list"))).otherwise(notes["problems"])
        whole = F.concat(_unknown(b, "bar", where), _problems(bad_id), provenance, tail)
        return F.when(b.isNull(), F.struct(F.array(_row(where, "is not a bar")).alias("problems"), F.lit(False).alias("ok"))).otherwise(F.struct(whole.alias("problems"), notes["ok"].alias("ok")))

    return F.get(F.transform(F.array(notes), of_bar), F.lit(0))


def _fresh(key: Column, *at: Column) -> Column:
    """A new id for what has none: the same for the same text and place, so that a repeated run gives it again."""
    return F.substring(F.sha2(F.concat_ws("/", key, *[a.cast("string") for a in at]).cast("binary"), 256), 1, 32)


def _typed_bar(x: Column, i: Column, key: Column, new: Column) -> Column:
    """struct<b, p, notes> as a bar of SCORE; absent ids and provenance are filled in where the score is new."""
    own = lambda m, name, fresh: F.when(new & field(m, name).isNull(), fresh).otherwise(text_of(field(m, name)))
    none = F.array().cast("array<string>")
    given = F.struct(text_of(field(x["p"], "source")).alias("source"), flag_of(field(x["p"], "reviewed")).alias("reviewed"), names_of(field(x["p"], "warnings")).alias("warnings"), text_of(field(x["p"], "model")).alias("model"))
    manual = F.struct(F.lit("manual").alias("source"), F.lit(True).alias("reviewed"), none.alias("warnings"), F.lit(None).cast("string").alias("model"))

    def note(n: Column, j: Column) -> Column:
        named = F.when(~F.exists(n["drums"], lambda d: d.isNull()), n["drums"])
        return F.struct(F.when(new & ~n["has_id"], _fresh(key, i, j)).otherwise(n["id"]).alias("event_id"), n["duration"].alias("duration"), F.coalesce(n["dotted"], F.lit(False)).alias("dotted"), F.coalesce(n["triplet"], F.lit(False)).alias("triplet"), F.coalesce(named, none).alias("drums"))

    provenance = F.when(new & field(x["b"], "provenance").isNull(), manual).otherwise(given)
    return F.struct(own(x["b"], "barId", _fresh(key, i)).alias("bar_id"), provenance.alias("provenance"), F.transform(x["notes"], note).alias("notes"))


def _timing(bar: Column, i: Column, capacity: Column) -> Column:
    """Problems of a bar of well-formed notes: triplet notes outside groups of three, too many ticks for the meter (null: unknown)."""
    where = F.concat(F.lit("bar "), (i + 1).cast("string"))
    # Twice the ticks, so that a dotted 32nd is whole.
    length = F.create_map(*[F.lit(x) for k, v in DURATION_TICKS.items() for x in (k, 2 * v)])
    part = lambda n: F.floor(F.try_element_at(length, n["duration"]) * F.when(n["dotted"], 9).when(n["triplet"], 4).otherwise(6) / 6)
    total = F.aggregate(bar["notes"], F.lit(0).cast("long"), lambda a, n: a + part(n))
    events = F.transform(bar["notes"], lambda n, j: F.struct(j.alias("event_idx"), n["duration"].alias("written_duration"), n["dotted"].alias("dotted"), n["triplet"].alias("triplet")))
    loose = F.size(F.filter(bar["notes"], lambda n: n["triplet"])) != 3 * triplet_groups(events)
    return _problems(F.when(loose, _row(where, "a triplet note is outside a group of three")), F.when(total > 2 * capacity, _row(where, "notes overfill the bar")))


def checked_scores(docs: DataFrame, *, version: int = 1) -> DataFrame:
    """Each document of parse_scores() once: path, _code, the fields of a score, and _found array<struct<place, problem>>, empty for a valid one."""
    m, new, path = F.col("_m"), F.col("_new"), F.col("path")
    number, listed = whole_of(field(m, "schemaVersion")), as_list(field(m, "bars"))
    meter = as_map(field(m, "meter"))
    rows = docs.select("path", as_map(F.try_parse_json("raw")).alias("_m"))
    rows = rows.withColumn("_new", m.isNotNull() & field(m, "schemaVersion").isNull())
    rows = rows.withColumn("_code", F.when(m.isNull() | (new & listed.isNull()), "unreadable").when(number > version, "future_version"))
    # Every object is opened once: the bars, their provenance and their notes as maps.
    rows = rows.withColumn("_bars", F.transform(F.transform(listed, as_map), lambda b: F.struct(b.alias("b"), as_map(field(b, "provenance")).alias("p"), _opened_notes(F.transform(as_list(field(b, "notes")), as_map)).alias("notes"))))
    rows = settled(rows)
    default = lambda value, given: F.when(new, F.lit(value)).otherwise(given)
    rows = rows.withColumns({
        "schema_version": F.lit(version),
        "score_id": F.when(new, _fresh(path)).otherwise(text_of(field(m, "scoreId"))),
        "revision": default(0, whole_of(field(m, "revision")).cast("int")),
        "title": default(DEFAULT_TITLE, text_of(field(m, "title"))),
        "tempo_bpm": default(DEFAULT_TEMPO, whole_of(field(m, "tempoBpm")).cast("int")),
        "meter": F.struct(default(4, whole_of(field(meter, "beats")).cast("int")).alias("beats"), default(4, whole_of(field(meter, "beatUnit")).cast("int")).alias("beat_unit")),
        "bars": F.transform("_bars", lambda x, i: _typed_bar(x, i, path, new)),
        "_checks": F.transform("_bars", lambda x, i: _bar_problems(x, i, new)),
    })
    rows = settled(rows)
    ids = F.flatten(F.transform("bars", lambda b: F.concat(F.array(b["bar_id"]), F.coalesce(F.transform(b["notes"], lambda n: n["event_id"]), F.array().cast("array<string>")))))
    rows = rows.withColumn("_ids", F.array_sort(F.filter(ids, lambda x: F.coalesce(x.rlike(_ID), F.lit(False)))))
    twice = F.array_distinct(F.filter("_ids", lambda x, i: (i > 0) & (F.get(F.col("_ids"), i - 1) == x)))
    known = F.col("meter.beats").between(1, 32) & F.col("meter.beat_unit").isin(*METER_UNITS)
    capacity = F.when(known, F.col("meter.beats") * 192 / F.col("meter.beat_unit"))
    of_score = F.when(new, _problems(F.when(_not(F.size("bars").between(1, MAX_BARS)), _row(F.lit("score"), "number of bars is out of range")))).otherwise(F.concat(_problems(F.when(_not(number == version), _row(F.lit("score"), f"schema version is not {version}"))), _score_problems(m)))
    of_bars = F.concat(
        F.flatten(F.transform("_checks", lambda c: c["problems"])),
        F.flatten(F.transform("bars", lambda b, i: F.when(F.get(F.col("_checks"), i)["ok"], _timing(b, i, capacity)).otherwise(_none()))),
        F.transform(twice, lambda x: _row(F.concat(F.lit("id "), x), "id repeats")),
    )
    found = F.concat(of_score, F.when(F.coalesce(F.size("bars").between(1, MAX_BARS), F.lit(False)), of_bars).otherwise(_none()))
    whole = F.when(F.col("_code") == "unreadable", F.array(_row(F.lit("document"), "not a score"))).when(F.col("_code") == "future_version", F.array(_row(F.lit("document"), "newer schema version"))).otherwise(found)
    rows = settled(rows.withColumn("_found", whole).drop("_m", "_bars", "_checks", "_ids"))
    return rows


def parse_scores(docs: DataFrame, *, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """IO3, SC5: docs(path, raw) -> (scores, rejected).

    scores(path, schema_version, score_id, revision, title, tempo_bpm, meter, bars) are the valid documents. A
    document without a version but with a list of bars is migrated: a new score of title and tempo by default,
    in 4/4, whose bars and notes get ids and provenance where these are absent (the ids come from the path and
    place, so that a second run gives them again). rejected(path, code, place, problem) has a row for each
    problem of each other document; code is unreadable (no JSON object, or neither a version nor bars),
    future_version (left as it is) or invalid. Null texts are unreadable; nothing is dropped without a row.
    """
    rows = checked_scores(docs, version=version)
    good = rows.where(F.size("_found") == 0).select("path", "schema_version", "score_id", "revision", "title", "tempo_bpm", "meter", "bars")
    bad = rows.where(F.size("_found") > 0).select("path", F.coalesce("_code", F.lit("invalid")).alias("code"), F.explode("_found").alias("x")).select("path", "code", "x.place", "x.problem")
    return good, bad
