"""Exercise and fill retrieval (EX1-EX6). Requests meet the catalogue by equal values only, so that both may be large."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwise.functions.notation import FOOT, TOMS, lookup

# Depth of a subdivision, and the levels in order.
DEPTH = {"whole": 0, "half": 0, "quarter": 1, "dotted quarter": 1, "8th": 2, "dotted 8th": 2, "triplet 8th": 2, "16th": 3, "dotted 16th": 3, "triplet 16th": 3, "32nd": 4}
LEVELS = {"beginner": 0, "intermediate": 1, "advanced": 2}


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


# Fields of a query in the order in which one of them becomes the join's key: lists before single values, as they divide the catalogue most.
_LISTS, _SINGLES = ("goals", "styles", "limbs"), ("subdivision", "level", "kind")


def _key(field: str, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.alias("value"))


def search_exercises(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """EX1, EX2: queries(query_id, level, kind, subdivision, max_tempo, styles, goals, limbs, text), nulls for what is not asked.

    catalogue(id, kind, title, level, styles, subdivision, limbs, goals, tempo_min, tempo_target,
    tempo_max, description). Score: 10 for each field asked, 5 for each word in common; with a text, rows
    without a word in common are dropped. A query meets the catalogue by one asked value (a goal, style,
    limb, subdivision, level or kind), else by the words of its text, and only one that asks for neither
    meets all of it, which is its result. The other conditions filter what has met.
    """
    fields = ("level", "kind", "subdivision", "max_tempo", "styles", "goals", "limbs")
    asked = lambda f: F.col(f"q.{f}").isNotNull()
    holds = [~asked(f) | (F.col(f"q.{f}") == F.col(f"c.{f}")) for f in fields[:3]] + [~asked("max_tempo") | (F.col("c.tempo_max") <= F.col("q.max_tempo"))] + [~asked(f) | (F.size(F.array_except(f"q.{f}", f"c.{f}")) == 0) for f in fields[4:]]
    text, have = _words(F.col("text")), _words(F.concat_ws(" ", "title", "description", F.array_join("goals", " "), F.array_join("styles", " ")))
    one = F.coalesce(*[F.when(F.size(f) > 0, _key(f, F.get(f, F.lit(0)))) for f in _LISTS], *[F.when(F.col(f).isNotNull(), _key(f, F.col(f))) for f in _SINGLES])
    keys = F.when(one.isNotNull(), F.array(one)).when(F.size(text) > 0, F.transform(text, lambda w: _key("word", w))).otherwise(F.array(_key("all", F.lit(""))))
    asking = queries.withColumn("q_words", text).withColumn("key", F.explode(keys))
    wanted = asking.select("key.field").distinct()  # ten names at most
    each = lambda field, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: _key(field, v))
    offered = F.concat(*[each(f, F.col(f)) for f in _LISTS], F.array(*[_key(f, F.col(f)) for f in _SINGLES]), each("word", have), F.array(_key("all", F.lit(""))))
    shelf = catalogue.withColumn("c_words", have).withColumn("key", F.explode(F.array_distinct(offered))).withColumn("field", F.col("key.field")).join(F.broadcast(wanted), "field", "left_semi").drop("field")
    met = asking.alias("q").join(shelf.alias("c"), F.col("q.key") == F.col("c.key")).where(reduce(Column.__and__, holds))
    rows = met.withColumn("overlap", F.array_sort(F.array_intersect("q.q_words", "c.c_words")))
    n = sum((F.when(asked(f), 10).otherwise(0) for f in fields), F.lit(0))
    kept = rows.where((F.size("q.q_words") == 0) | (F.size("overlap") > 0)).select("q.query_id", "c.id", (n + 5 * F.size("overlap")).alias("score"), "overlap").dropDuplicates(["query_id", "id"])
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def passage_facts(inspected: DataFrame, events: DataFrame, requests: DataFrame) -> DataFrame:
    """EX3: (request_id, goal, bars) for the bars of a passage: triplets, rests, foot with hands, off-beats, toms.

    inspected has the columns of inspect_bars() for requests; its finest note is goal `subdivision`, with
    the note's name in `detail`.
    """
    seen = inspected.where(~F.col("missing"))
    is_in = lambda values: (lambda d: d.isin(*values))
    per = events.join(seen.select("score_id", "bar_number").distinct(), ["score_id", "bar_number"]).groupBy("score_id", "bar_number").agg(F.bool_or(F.exists("drums", is_in(FOOT)) & F.exists("drums", lambda d: ~d.isin(*FOOT))).alias("foot"), F.bool_or(F.exists("drums", is_in(TOMS))).alias("toms"), F.count_if(~F.col("is_rest") & ~(F.col("onset_ticks") % 48).isin(0, 24)).alias("off"))
    one = seen.join(per, ["score_id", "bar_number"], "left").withColumn("depth", lookup(F.col("smallest_note"), DEPTH, F.lit(0)))
    finest = one.groupBy("request_id").agg(F.max_by("smallest_note", F.struct("depth", (-F.col("bar_number")).alias("o"))).alias("finest"))
    one = one.join(finest, "request_id")
    goals = F.array_compact(F.array(F.when(F.col("smallest_note") == F.col("finest"), F.lit("subdivision")), F.when(F.col("triplet_groups") > 0, "triplets"), F.when(F.col("n_rests") > 0, "reading rests"), F.when(F.col("foot"), "kick independence"), F.when(F.col("off") >= 2, "syncopation"), F.when(F.col("toms"), "tom movement")))
    rows = one.select("request_id", "finest", "bar_number", F.explode(goals).alias("goal"))
    return rows.groupBy("request_id", "goal").agg(F.array_sort(F.collect_set("bar_number")).alias("bars"), F.first(F.when(F.col("goal") == "subdivision", F.col("finest")), ignorenulls=True).alias("detail"))


def exercises_for_passage(facts: DataFrame, catalogue: DataFrame, top: int = 3) -> DataFrame:
    """EX4: the best exercises of a passage. Each query that returns one adds 3 for every goal they share, in the order of queries.

    Queries: the finest note alone, then with each goal. The score is a fold over them: the larger of the
    score so far and the query's, plus the bonus.
    """
    order = {"triplets": 1, "reading rests": 2, "kick independence": 3, "syncopation": 4, "tom movement": 5}
    named = F.when(F.col("goal").isin(*order), F.col("goal"))
    per = facts.groupBy("request_id").agg(F.max("detail").alias("subdivision"), F.array_sort(F.collect_set(named)).alias("goals"))
    combination = F.concat_ws("/", "subdivision", F.array_join("goals", "/"))
    # What a passage asks is one of a few hundred combinations, so each is answered once, without the passages.
    sets = facts.sparkSession.range(1 << len(order)).select(F.array_sort(F.array_compact(F.array(*[F.when(F.col("id").bitwiseAND(1 << i) > 0, g) for i, g in enumerate(order)]))).alias("goals"))
    each = sets.select("goals", F.explode(F.array(*map(F.lit, DEPTH))).alias("subdivision")).withColumn("combination", combination)
    # Items of one subdivision and the same goals score alike here, so of each such shelf only the first ones can be among the best.
    shelf = F.row_number().over(Window.partitionBy("subdivision", F.array_sort(F.array_distinct("goals"))).orderBy("id"))
    front = catalogue.where(F.col("subdivision").isin(*DEPTH)).withColumn("place", shelf).where(F.col("place") <= top).drop("place")
    asked = each.select("combination", "subdivision", F.explode(F.array_union(F.array(F.lit("")), "goals")).alias("goal"))
    none = F.lit(None)
    queries = asked.select(F.struct("combination", lookup(F.col("goal"), order, F.lit(0)).alias("at")).alias("query_id"), "subdivision", F.when(F.col("goal") != "", F.array("goal")).alias("goals"), none.cast("string").alias("level"), none.cast("string").alias("kind"), none.cast("int").alias("max_tempo"), none.cast("array<string>").alias("styles"), none.cast("array<string>").alias("limbs"), none.cast("string").alias("text"))
    found = search_exercises(queries, front).select("query_id.combination", "query_id.at", "id", "score")
    shared = found.join(each.select("combination", "goals"), "combination").join(front.select("id", F.col("goals").alias("has")), "id").withColumn("bonus", 3 * F.size(F.array_intersect("goals", "has")))
    folded = shared.groupBy("combination", "id").agg(F.array_sort(F.collect_list(F.struct("at", "score", "bonus"))).alias("q")).select("combination", "id", F.aggregate("q", F.lit(0), lambda s, x: (F.greatest(s, x["score"]) + x["bonus"]).cast("int")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("combination").orderBy(F.desc("score"), "id"))
    best = folded.withColumn("rank", rank).where(F.col("rank") <= top)
    return per.select("request_id", combination.alias("combination")).join(best, "combination").select("request_id", "id", "score", "rank")


def recommend_fills(requests: DataFrame, catalogue: DataFrame, top: int = 3) -> DataFrame:
    """EX5: requests(request_id, tempo_bpm, subdivision, level, style) -> fills of that level or one below, in tempo, no finer.

    Equal requests are answered once. They meet the fills on level, subdivision and whole beats per
    minute: each request lists the levels and subdivisions that suit it, each fill the tempos it covers. Fills
    of one level, subdivision, tempo and the same styles score alike for every request, so that only the first ones of each such shelf meet any.
    """
    fields = ("tempo_bpm", "subdivision", "level", "style")
    each = requests.select(*fields).distinct()
    index, depth = lookup(F.col("level"), LEVELS), lookup(F.col("subdivision"), DEPTH)
    levels = F.array_compact(F.array(*[F.when((index == i) | (index == i + 1), name) for name, i in LEVELS.items()]))
    subdivisions = F.array_compact(F.array(*[F.when(depth >= d, name) for name, d in DEPTH.items()]))
    asked = each.withColumn("fill_level", F.explode(levels)).withColumn("fill_subdivision", F.explode(subdivisions)).withColumn("beats", F.floor("tempo_bpm").cast("int"))
    shelf = F.row_number().over(Window.partitionBy("level", "subdivision", F.sort_array(F.array_distinct("styles")), "tempo_min", "tempo_target", "tempo_max").orderBy("id"))
    front = catalogue.where("kind = 'fill' and tempo_min <= tempo_max").withColumn("place", shelf).where(F.col("place") <= top)
    fills = front.select("id", F.col("level").alias("fill_level"), F.col("subdivision").alias("fill_subdivision"), "styles", "tempo_min", "tempo_target", "tempo_max", F.explode(F.sequence(F.floor("tempo_min").cast("int"), F.floor("tempo_max").cast("int"))).alias("beats"))
    rows = asked.join(fills, ["fill_level", "fill_subdivision", "beats"]).where(F.col("tempo_bpm").between(F.col("tempo_min"), F.col("tempo_max")))
    score = F.when(F.array_contains("styles", F.col("style")), 100).otherwise(0) + F.greatest(F.lit(0), 50 - F.abs(F.col("tempo_target") - F.col("tempo_bpm")))
    best = rows.select(*fields, "id", score.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy(*fields).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= top)
    same = reduce(Column.__and__, [F.col(f"r.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields])
    return requests.alias("r").join(best.alias("b"), same).select("r.request_id", "b.id", "b.score", "b.rank")


def validate_fills(events: DataFrame) -> DataFrame:
    """EX6: problems of one-bar fills given as events: those of validate_events(), and bars that are not 192 ticks."""
    from tickwise.operators.scores import bar_fill, validate_events

    short = bar_fill(events).where("state = 'incomplete'").select("score_id", "bar_number", F.lit(None).cast("int").alias("event_idx"), F.lit("a fill must be exactly one bar").alias("problem"))
    return validate_events(events).unionByName(short)
