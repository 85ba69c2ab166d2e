"""Linking, pairing, manifest and reconciliation (MF1-MF12)."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bands whose names are stripped from titles.
BANDS = ("rush", "nirvana", "metallica", "led zeppelin", "ac dc", "green day", "foo fighters", "james brown", "bob marley", "phil collins", "the police", "the eagles", "eagles")
_MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"


def normalise_title(name: Column, bands: tuple[str, ...] = BANDS, aliases: dict[str, str] | None = None) -> Column:
    """MF1: the bare song title: no dates, suffixes, lone numbers, bands or punctuation; aliases last."""
    s = F.lower(F.translate(F.regexp_replace(name, r"\d{2}-\d{2}-\d{4}", ""), "_-", "  "))
    s = F.substring_index(F.substring_index(s, "songsterr", 1), "drum tab", 1)
    s = F.regexp_replace(s, rf"\b(?:{_MONTH})\.?\s*\d{{0,2}},?\s*\d{{4}}\b|\b20\d{{2}}\b", "")
    s = F.regexp_replace(s, r"\b\d{1,4}\b", "")
    s = F.regexp_replace(s, r"\bby\s+(?:" + "|".join(bands) + r")\b", "")
    for band in sorted(bands, key=len, reverse=True):
        s = F.regexp_replace(s, rf"^\s*{band}\s+", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[',.]", ""), r"\s+", " "))
    for old, new in (aliases or {}).items():
        s = F.when(s == old, new).otherwise(s)
    return s


def link_by_title(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """MF2: docs(doc, title) -> the group of groups(title) with that title, else the only one that starts with it or the other way; null otherwise.

    The longer title of a pair lists its beginnings and the other meets them as a whole, so that both joins
    are by equal values. An empty title matches every group, so it links only where there is one in all.
    """
    beginnings = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n)))
    known = groups.select(F.col("title").alias("found")).where("found <> ''").distinct()
    exact = docs.join(known, docs.title == F.col("found"), "left")
    open_ = exact.where("found is null and title <> ''").select("doc", "title")
    titles = open_.select("title").distinct()
    shorter = titles.withColumn("found", beginnings("title")).join(known, "found")
    longer = known.withColumn("title", beginnings("found")).join(titles, "title").select("title", "found")
    by_title = shorter.select("title", "found").unionByName(longer).distinct().groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("found").alias("near"))
    near = open_.distinct().join(by_title, "title")
    only = known.agg(F.count(F.lit(1)).alias("n"), F.min("found").alias("one")).first()
    lone = F.when((F.col("title") == "") & F.lit(only.n == 1), F.lit(only.one))
    return exact.join(near, ["doc", "title"], "left").select("doc", "title", F.coalesce("found", F.when(F.col("n") == 1, F.col("near")), lone).alias("group"), F.when(F.col("found").isNotNull(), "exact").when((F.col("n") == 1) | lone.isNotNull(), "prefix").otherwise("none").alias("how"))


def pair_crops(crops: DataFrame, labels: DataFrame) -> DataFrame:
    """MF3: crops(song, crop_order, crop), labels(song, bar, label) -> the n-th with the n-th, only in songs whose counts agree."""
    number = lambda df, o: df.withColumn("n", F.row_number().over(Window.partitionBy("song").orderBy(o))).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("song")))
    return number(crops, "crop_order").join(number(labels, "bar"), ["song", "n", "total"]).select("song", "n", "crop", "bar", "label")


def parse_bar_name(stem: Column) -> Column:
    """MF4: struct(song, bar) of <song>_bar<NNN>; nulls where the name has no such form."""
    ok = stem.rlike(r"^.+_bar\d{1,9}$")
    return F.struct(F.when(ok, F.regexp_extract(stem, r"^(.+)_bar\d+$", 1)).alias("song"), F.when(ok, F.regexp_extract(stem, r"_bar(\d+)$", 1).cast("int")).alias("bar"))


def missing_partners(images: DataFrame, labels: DataFrame) -> DataFrame:
    """MF5: stems of images without a label and of labels without an image."""
    a, b = images.select("stem").distinct(), labels.select("stem").distinct()
    return a.subtract(b).withColumn("problem", F.lit("image has no label")).unionByName(b.subtract(a).withColumn("problem", F.lit("label has no image")))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """MF6"""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def split_songs(rows: DataFrame, seed: int, exact: bool = False, order_by: str = "image_name", most: int = 1_000_000) -> DataFrame:
    """MF7, MF8: rows(song, ...) plus split: a tenth of songs (one at least) for test, as many for validation, the rest train.

    exact: songs in order of their first image, shuffled on the driver by a seeded generator; more than
    `most` songs are refused there, before any reaches it. Otherwise songs are ordered by a hash of name and seed.
    """
    if exact:
        if (n_songs := rows.select("song").distinct().count()) > most:
            raise ValueError(f"{n_songs} songs are too many to shuffle on the driver: split them with exact=False")
        songs = [r.song for r in rows.groupBy("song").agg(F.min(order_by).alias("o")).orderBy("o", "song").collect()]
        random.Random(seed).shuffle(songs)
        n = max(1, int(len(songs) * 0.1))
        named = [(s, "test" if i < n else "validation" if i < 2 * n else "train") for i, s in enumerate(songs)]
        return rows.join(rows.sparkSession.createDataFrame(named, "song string, split string"), "song")
    # The place of a song comes from counts of 4096 hash buckets and its rank inside the bucket.
    h = F.xxhash64("song", F.lit(seed))
    songs = rows.select("song").distinct().withColumns({"h": h, "b": F.shiftrightunsigned(h, 52)})
    before = songs.groupBy("b").agg(F.count(F.lit(1)).alias("c")).select("b", (F.sum("c").over(Window.orderBy("b")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("total"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("h", "song")) - 1
    n = F.greatest(F.lit(1), F.floor(F.col("total") * 0.1))
    ranked = songs.join(before, "b").withColumn("place", place)
    return rows.join(ranked.select("song", F.when(F.col("place") < n, "test").when(F.col("place") < 2 * n, "validation").otherwise("train").alias("split")), "song")


def build_manifest(images: DataFrame, labels: DataFrame, sources: DataFrame, raw: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MF9: images(stem, image_path), labels(stem, label_path), sources(source_song, source_kind, source_file), raw(source_song, bar_number, source_label_path), splits(song, split) -> (manifest, errors).

    The song of a pair is the part of its stem before _bar; source_song is that name.
    """
    named = images.join(labels, "stem").withColumn("p", parse_bar_name(F.col("stem")))
    pairs = named.where("p.song is not null").select("stem", "image_path", "label_path", F.col("p.song").alias("song"), F.col("p.song").alias("source_song"), F.col("p.bar").alias("bar_number"))
    full = pairs.join(sources, "source_song", "left").join(raw, ["source_song", "bar_number"], "left").join(splits, "song", "left")
    bad = F.array_compact(F.array(F.when(F.col("source_file").isNull(), "no source file"), F.when(F.col("source_label_path").isNull(), "no source label"), F.when(F.col("split").isNull(), "no split")))
    errors = full.select("stem", F.explode(bad).alias("problem")).unionByName(named.where("p.song is null").select("stem", F.lit("name has no bar").alias("problem"))).unionByName(missing_partners(images, labels))
    return full.where(F.size(bad) == 0).select("split", "song", "source_song", "source_kind", "source_file", "bar_number", "image_path", "label_path", "source_label_path"), errors


def reconcile(raw: DataFrame, packaged: DataFrame, audits: DataFrame) -> DataFrame:
    """MF10: raw(song, bar, ...) labels that are not packaged(song, bar), with one of eight reasons.

    audits(song, crops, labels, matches): what was detected in each document of a song.
    """
    per_song = packaged.groupBy("song").agg(F.count(F.lit(1)).alias("packaged_song_bars"))
    seen = audits.groupBy("song").agg(F.count(F.lit(1)).alias("n_audits"), F.bool_and("matches").alias("matches"))
    rows = raw.join(packaged.select("song", "bar"), ["song", "bar"], "left_anti").join(per_song, "song", "left").join(seen, "song", "left").withColumns({"packaged_song_bars": F.coalesce("packaged_song_bars", F.lit(0)), "n_audits": F.coalesce("n_audits", F.lit(0))})
    some = F.col("packaged_song_bars") > 0
    name = lambda a, b: F.when(some, a).otherwise(b)
    reason = F.when(F.col("n_audits") == 0, name("packaged_dataset_incomplete_no_matching_pdf", "no_matching_pdf")).when(F.col("n_audits") > 1, name("packaged_dataset_incomplete_ambiguous_pdf_match", "ambiguous_pdf_match")).when(~F.col("matches"), name("packaged_dataset_incomplete_crop_mismatch", "crop_label_count_mismatch")).otherwise(name("packaged_dataset_incomplete", "packaged_dataset_not_regenerated"))
    return rows.withColumn("reason", reason)


def reconciliation_summary(rows: DataFrame) -> DataFrame:
    """MF11: bars and songs by reason."""
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("bars"), F.countDistinct("song").alias("songs"))


def reconciliation_report(rows: DataFrame, packaged: DataFrame, audits: DataFrame) -> DataFrame:
    """MF11: one pass of grouping sets over what is missing and what is packaged -> (kind, name, bars, songs, packaged_bars, reason, crop_audit).

    rows as reconcile() gives them, packaged(song, bar, split), audits(song, crops, labels). kind `reason`:
    bars and songs of each reason; `song`: missing and packaged bars of each affected song, its reason, and
    the crops and labels of its only document; `split`: packaged bars and songs of each split.
    """
    seen = audits.groupBy("song").agg(F.count(F.lit(1)).alias("n"), F.max("crops").alias("crops"), F.max("labels").alias("labels"))
    audit = F.when(F.col("n") == 1, F.concat(F.col("crops").cast("string"), F.lit(" crops / "), F.col("labels").cast("string"), F.lit(" labels"))).otherwise("no unique match")
    missing = rows.join(seen, "song", "left").select(F.lit(True).alias("missing"), F.col("song").cast("string").alias("song"), "reason", F.lit(None).cast("string").alias("split"), F.col("packaged_song_bars").cast("long").alias("have"), audit.alias("audit"))
    there = packaged.select(F.lit(False).alias("missing"), F.col("song").cast("string").alias("song"), F.lit(None).cast("string").alias("reason"), "split", F.lit(None).cast("long").alias("have"), F.lit(None).cast("string").alias("audit"))
    sets = [[F.col("missing"), F.col("reason")], [F.col("missing"), F.col("song")], [F.col("missing"), F.col("split")]]
    of = lambda c: F.grouping(c) == 0
    kind = F.when(of("reason") & F.col("missing"), "reason").when(of("song") & F.col("missing"), "song").when(of("split") & ~F.col("missing"), "split")
    per_song = of("song")
    grouped = missing.unionByName(there).withColumn("_song", F.col("song")).withColumn("_reason", F.col("reason")).groupingSets(sets, F.col("missing"), F.col("reason"), F.col("song"), F.col("split"))
    out = grouped.agg(kind.alias("kind"), F.coalesce("reason", "song", "split").alias("name"), F.count(F.lit(1)).alias("bars"), F.countDistinct("_song").alias("songs"), F.when(per_song, F.max("have")).alias("packaged_bars"), F.when(per_song, F.min("_reason")).alias("song_reason"), F.when(per_song, F.max("audit")).alias("crop_audit"))
    return out.where("kind is not null").select("kind", "name", "bars", "songs", "packaged_bars", F.col("song_reason").alias("reason"), "crop_audit")


def sample_pairs(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """MF12: n rows by a hash of key and seed; the same ones every time."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n)
