"""Training subset and targets (TS1-TS13). No step before the reports needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.functions.notation import DRUMS, DURATIONS, SLOTS, strings

SPLITS = ("train", "validation", "test")


def fold_ghosts(drum: Column) -> Column:
    """TS9"""
    return F.regexp_replace(drum, "_ghost$", "")


def label_issues(labels: DataFrame) -> DataFrame:
    """TS1: labels(time_signature, simile, beats, ...) plus reasons array<string>, sorted; empty where the label can be used.

    beats is an array of structs (beat, duration, drums, rest, flam); null beats are no list, a null
    struct is no event, null drums or a null in them are no list of names.
    """
    beats = F.col("beats")
    parts = F.split("time_signature", "/")
    num, den = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    good = F.coalesce((F.size(parts) == 2) & (num * den > 0), F.lit(False))
    usable = F.filter(beats, lambda e: e.isNotNull() & e["drums"].isNotNull() & ~F.exists(e["drums"], lambda d: d.isNull()))
    hits = F.filter(usable, lambda e: ~F.coalesce(e["rest"], F.lit(False)))
    at = F.filter(F.transform(hits, lambda e: e["beat"].try_cast("double")), lambda b: b.isNotNull() & ~F.isnan(b) & (F.abs(b) < F.lit(1e308)))
    any_hit = lambda f: F.exists(hits, f)
    reasons = F.array_compact(F.array(
        F.when(~good, "invalid_time_signature"),
        F.when(good & (num * 4 > den * 4), "measure_beyond_grid"),
        F.when(F.coalesce("simile", F.lit(False)), "context_dependent_simile"),
        F.when(F.exists(beats, lambda e: e.isNull()), "invalid_event"),
        F.when(F.size(usable) < F.size(F.filter(beats, lambda e: e.isNotNull())), "invalid_drums"),
        F.when(F.exists(usable, lambda e: F.coalesce(e["rest"], F.lit(False)) & (F.size(e["drums"]) > 0)), "rest_with_drums"),
        F.when(any_hit(lambda e: F.size(e["drums"]) == 0), "empty_hit"),
        F.when(any_hit(lambda e: F.exists(e["drums"], lambda d: ~fold_ghosts(d).isin(*DRUMS))), "unsupported_drum"),
        F.when(any_hit(lambda e: ~F.coalesce(e["duration"].isin(*DURATIONS), F.lit(False))), "unsupported_duration"),
        F.when(any_hit(lambda e: F.coalesce(e["flam"], F.lit(False))), "unsupported_flam"),
        F.when(F.size(at) < F.size(hits), "invalid_beat"),
        F.when(F.exists(at, lambda b: (b < 1) | (b > 1 + (SLOTS - 1) / 8)), "beat_outside_grid"),
        F.when(F.exists(at, lambda b: b.between(1, 1 + (SLOTS - 1) / 8) & (b * 8 != F.floor(b * 8))), "beat_off_grid"),
        F.when(F.size(F.array_distinct(at)) < F.size(at), "duplicate_onset"),
    ))
    return labels.withColumn("reasons", F.when(beats.isNull(), F.array(F.lit("invalid_beats"))).otherwise(F.array_sort(reasons)))


def select_subset(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TS2: (included, excluded); excluded has its reasons joined by ;."""
    checked = labels if "reasons" in labels.columns else label_issues(labels)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0).withColumn("reasons", F.concat_ws(";", "reasons"))


def split_leaks(manifest: DataFrame) -> DataFrame:
    """TS3: names of songs, as packaged or in the source, that occur in two splits."""
    names = manifest.select("split", F.explode(F.array_distinct(F.array("song", "source_song"))).alias("name"))
    return names.groupBy("name").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def audit_pairs(manifest: DataFrame, files: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """TS4: (image_path, problem) of manifest rows: identity repeated, stems differ, files missing, label of another bar, split unknown."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?$", 1)
    twice = manifest.groupBy("source_song", "bar_number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = files.select("path").distinct()
    rows = manifest.join(twice, ["source_song", "bar_number"], "left")
    for c in ("image_path", "label_path"):
        rows = rows.join(at.select(F.col("path").alias(c), F.lit(True).alias(f"has_{c}")), c, "left")
    other = F.lit(None).cast("string")
    if labels is not None:
        rows = rows.join(labels.select("label_path", F.col("song").alias("l_song"), F.col("bar").alias("l_bar")), "label_path", "left")
        other = F.when(F.col("l_song").isNotNull() & ((F.col("l_song") != F.col("source_song")) | (F.col("l_bar") != F.col("bar_number"))), "label is of another bar")
    problems = F.array_compact(F.array(F.when(F.col("n").isNotNull(), "identity repeats"), F.when(stem("image_path") != stem("label_path"), "stems differ"), F.when(F.col("has_image_path").isNull(), "image is missing"), F.when(F.col("has_label_path").isNull(), "label is missing"), other, F.when(~F.col("split").isin(*SPLITS), "split is unknown")))
    return rows.select("image_path", F.explode(problems).alias("problem"))


def verify_hashes(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """TS5: manifest(path, sha256) rows whose file is missing or has another hash."""
    found = files.select("path", F.col("sha256").alias("now"))
    return manifest.join(found, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("path", "sha256", "now", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("problem"))


def subset_report(labels: DataFrame) -> DataFrame:
    """TS6: bars and songs by split, and over all (split null)."""
    used = F.size("reasons") == 0
    return labels.rollup("split").agg(F.count(F.lit(1)).alias("source_bars"), F.count_if(used).alias("included_bars"), F.count_if(~used).alias("excluded_bars"), F.countDistinct(F.when(used, F.col("song"))).alias("included_songs"))


def exclusion_counts(labels: DataFrame) -> DataFrame:
    """TS7: bars by reason; a bar counts once under each of its reasons."""
    return labels.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("bars"))


def require_splits(labels: DataFrame) -> DataFrame:
    """TS8: splits that keep no bars."""
    spark = labels.sparkSession
    return spark.createDataFrame([(s,) for s in SPLITS], "split string").join(labels.where(F.size("reasons") == 0).select("split").distinct(), "split", "left_anti")


def encode_sparse(labels: DataFrame, keys: list[str]) -> DataFrame:
    """TS10: usable labels -> (keys, slot, drum_idx, duration_idx), one row a sounding drum."""
    index = lambda values, c: F.array_position(strings(values), c) - 1
    hit = labels.select(*keys, F.explode(F.filter("beats", lambda e: ~F.coalesce(e["rest"], F.lit(False)))).alias("e"))
    return hit.select(*keys, F.rint((F.col("e.beat").cast("double") - 1) * 8).cast("int").alias("slot"), index(DURATIONS, F.col("e.duration")).cast("int").alias("duration_idx"), F.explode(F.array_distinct(F.transform("e.drums", lambda d: index(DRUMS, fold_ghosts(d)).cast("int")))).alias("drum_idx"))


def encode_dense(labels: DataFrame, keys: list[str]) -> DataFrame:
    """TS11: usable labels -> drums array<float> of 448 and durations array<int> of 32."""
    hits = F.filter("beats", lambda e: ~F.coalesce(e["rest"], F.lit(False)))
    slot = lambda e: F.rint((e["beat"].cast("double") - 1) * 8).cast("int")
    cells = F.flatten(F.transform(hits, lambda e: F.transform(e["drums"], lambda d: slot(e) * len(DRUMS) + (F.array_position(strings(DRUMS), fold_ghosts(d)) - 1))))
    at = F.map_from_entries(F.transform(hits, lambda e: F.struct(slot(e), (F.array_position(strings(DURATIONS), e["duration"]) - 1).cast("int"))))
    return labels.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(SLOTS * len(DRUMS) - 1)), lambda i: F.array_contains(cells, i.cast("long")).cast("float")).alias("drums"), F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0))).alias("durations"))


def positive_weights(sparse: DataFrame, bars: int | Column) -> DataFrame:
    """TS12: weight of each (slot, drum) cell: bars without over bars with the hit, each at least 1, at most 50."""
    spark = sparse.sparkSession
    grid = spark.range(SLOTS * len(DRUMS)).select((F.col("id") / len(DRUMS)).cast("int").alias("slot"), (F.col("id") % len(DRUMS)).cast("int").alias("drum_idx"))
    counted = sparse.groupBy("slot", "drum_idx").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(counted, ["slot", "drum_idx"], "left").select("slot", "drum_idx", F.least(F.lit(50.0), F.greatest(F.lit(bars) - n, F.lit(1)) / F.greatest(n, F.lit(1))).alias("weight"))


def best_epochs(history: DataFrame) -> DataFrame:
    """TS13: history(phase, epoch, train_loss, validation_loss) -> the first epoch of least validation loss, and its gap."""
    row = F.min_by(F.struct("epoch", "train_loss", "validation_loss"), F.struct("validation_loss", "epoch"))
    return history.groupBy("phase").agg(row.alias("r")).select("phase", "r.*", (F.col("r.validation_loss") - F.col("r.train_loss")).alias("gap"))
