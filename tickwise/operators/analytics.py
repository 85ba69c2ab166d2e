"""Score analytics (AN1-AN17) over bars in 4/4.

Bars are nested once, by (score_id, bar_number). Whatever looks at neighbours needs one further shuffle,
by score_id; near repeats need one by token.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwise.functions.frames import settled
from tickwise.functions.notation import CYMBALS, FOOT, HI_HATS, TICKS_PER_BEAT, TOMS, count_label, duration_label, half_up, jaccard, plural, round2, strings, texts
from tickwise.operators.scores import BAR, bar_events, bar_rows, with_bar_columns

# Weights and levels of the two scores.
FILL_WEIGHTS = {"novelty": 0.35, "tom_share": 0.25, "cymbal_after": 0.2, "timekeeping_drop": 0.1, "density_rise": 0.1}
COMPLEXITY_WEIGHTS = {"subdivision_density": 0.30, "coordination": 0.25, "syncopation": 0.15, "rhythm_changes": 0.15, "drum_movement": 0.10, "tempo": 0.05}
SUBDIVISION_LEVEL = {6: 1.0, 8: 0.9, 9: 1.0, 12: 0.75, 16: 0.6, 18: 0.75, 24: 0.4, 32: 0.3, 36: 0.4}


def counting_of(ev: Column) -> Column:
    """AN2: the spoken count of a bar: the beat's number once, then syllables; rests in brackets."""
    return F.array_join(F.transform(ev, lambda e, i: _said(ev, e, i)), " ")


def _said(ev: Column, e: Column, i: Column) -> Column:
    full = count_label(e["onset_ticks"])
    before = F.get(ev, i - 1)
    again = F.coalesce(F.floor(before["onset_ticks"] / TICKS_PER_BEAT) == F.floor(e["onset_ticks"] / TICKS_PER_BEAT), F.lit(False))
    said = F.when(again, F.trim(F.regexp_replace(full, "^[0-9]+", ""))).otherwise(full)
    return F.when(e["is_rest"], F.concat(F.lit("("), said, F.lit(")"))).otherwise(said)


def _small_label() -> Column:
    return F.when(F.col("smallest").isNotNull(), duration_label(F.col("smallest.written_duration"), F.col("smallest.dotted"), F.col("smallest.triplet")))


def counting(events: DataFrame) -> DataFrame:
    return bar_rows(events).select(*BAR, counting_of(F.col("ev")).alias("counting"))


def _numbers(column: str, where: Column) -> Column:
    """Comma-joined bar numbers that meet a condition, ascending."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(where, F.col(column)))), lambda x: x.cast("string")), ",")


def overview(events: DataFrame, scores: DataFrame) -> DataFrame:
    """AN3: scores(score_id, tempo_bpm, ...) in 4/4 -> one row a score."""
    bars = bar_rows(events)
    one = bars.select("score_id", "bar_number", F.size("hits").alias("n_hits"), F.size("ev").alias("n_events"), F.aggregate("ev", F.lit(0), lambda s, e: s + F.size(e["drums"])).alias("strokes"), F.size(F.filter("ev", lambda e: F.size(e["drums"]) > 1)).alias("chords"), "triplet_groups", "filled", F.col("smallest.duration_ticks").alias("small"), _small_label().alias("small_label"))
    least = one.withColumn("least", F.min("small").over(Window.partitionBy("score_id")))
    total = least.groupBy("score_id").agg(
        F.count(F.lit(1)).alias("total_bars"), F.sum("strokes").cast("long").alias("drum_hits"), F.sum("chords").cast("long").alias("chords"), F.sum(F.col("n_events") - F.col("n_hits")).cast("long").alias("rests"), F.sum("triplet_groups").cast("long").alias("triplet_groups"),
        F.min_by("small_label", F.struct("small", "bar_number")).alias("smallest_note"), _numbers("bar_number", F.col("small") == F.col("least")).alias("smallest_bars"), _numbers("bar_number", F.col("n_hits") == 0).alias("empty_bars"), _numbers("bar_number", F.col("filled") < 192).alias("incomplete_bars"),
    )
    drums = F.flatten(F.transform("ev", lambda e: e["drums"])) if "ev" in events.columns else F.col("drums")
    per_drum = events.select("score_id", F.explode(drums).alias("drum")).groupBy("score_id", "drum").agg(F.count(F.lit(1)).alias("n"))
    used = per_drum.groupBy("score_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "drum", "n"))), lambda x: F.concat(x["drum"], F.lit(":"), x["n"].cast("string"))), ",").alias("drums_used"))
    return total.join(used, "score_id", "left").join(scores.select("score_id", "tempo_bpm"), "score_id").withColumn("duration_seconds", round2(F.col("total_bars") * 240.0 / F.col("tempo_bpm")))


def _hit_words(keys: Column) -> Column:
    """'drum on count' of each onset:drum key, in order."""
    return F.array_join(F.transform(keys, lambda k: F.concat(F.substring_index(k, ":", -1), F.lit(" on "), count_label(F.substring_index(k, ":", 1).cast("int")))), ", ")


def inspect_bars(events: DataFrame, requests: DataFrame | None = None, most: int = 65) -> DataFrame:
    """AN4: facts of each bar, and its hits added and removed against the bar before.

    requests(request_id, score_id, from_bar, to_bar) restrict the result and add request_id, a missing
    flag and problem: a bar asked for that the score lacks has missing true and nulls. A request of more
    than `most` bars gets one row that says so, without a bar number.
    """
    asked = None
    if requests is not None:
        wide = F.col("hi") - F.col("lo") >= most
        numbers = F.when(~wide, F.sequence("lo", "hi")).otherwise(F.array(F.lit(None).cast("int")))
        asked = requests.withColumns({"lo": F.least("from_bar", "to_bar"), "hi": F.greatest("from_bar", "to_bar")}).select("request_id", "score_id", F.when(wide, f"ask about {most} bars at most").alias("problem"), F.explode(numbers).alias("bar_number"))
    w = Window.partitionBy("score_id").orderBy("bar_number")
    before = F.when(F.lag("bar_number").over(w) == F.col("bar_number") - 1, F.lag("keys").over(w))
    bars = bar_rows(events).select(*BAR, "ev", "keys").withColumn("before", before)
    if asked is not None:
        # Words are made for the bars asked for only; they meet the score's list of them, so that bars stay where they are.
        wanted = asked.where("bar_number is not null").groupBy("score_id").agg(F.collect_set("bar_number").alias("wanted"))
        bars = bars.join(wanted, "score_id").where(F.array_contains("wanted", F.col("bar_number"))).drop("wanted")
    bars = with_bar_columns(bars)
    seen = bars.select(*BAR, counting_of(F.col("ev")).alias("counting"), _small_label().alias("smallest_note"), F.size("hits").alias("n_hits"), (F.size("ev") - F.size("hits")).alias("n_rests"), "triplet_groups", _hit_words(F.array_except("keys", "before")).alias("added"), _hit_words(F.array_except("before", "keys")).alias("removed"))
    if asked is None:
        return seen
    return asked.join(seen.withColumn("missing", F.lit(False)), BAR, "left").withColumn("missing", F.coalesce("missing", F.lit(True)))


def compare_passages(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """AN5: pairs(score_id, bar_a, bar_b) -> similarity and what changes from a to b; pairs with a missing bar are dropped."""
    bars = bar_rows(events).select("score_id", "bar_number", "keys", F.array_distinct(F.flatten(F.transform("hits", lambda e: e["drums"]))).alias("drums"), F.size("hits").alias("n"), _small_label().alias("small"))
    side = lambda s: bars.select("score_id", *[F.col(c).alias(f"{c}_{s}") for c in ("bar_number", "keys", "drums", "n", "small")]).withColumnRenamed(f"bar_number_{s}", f"bar_{s}")
    both = pairs.join(side("a"), ["score_id", "bar_a"]).join(side("b"), ["score_id", "bar_b"])
    names = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ",")
    return both.select("score_id", "bar_a", "bar_b", round2(jaccard(F.col("keys_a"), F.col("keys_b"))).alias("similarity"), _hit_words(F.array_except("keys_b", "keys_a")).alias("added"), _hit_words(F.array_except("keys_a", "keys_b")).alias("removed"), (F.col("n_b") - F.col("n_a")).alias("density_delta"), names("drums_b", "drums_a").alias("drums_added"), names("drums_a", "drums_b").alias("drums_removed"), (~F.col("small_a").eqNullSafe(F.col("small_b"))).alias("subdivision_changed"))


def _patterns(events: DataFrame) -> DataFrame:
    bars = bar_rows(events).where(F.size("keys") > 0)
    return bars.select(*BAR, "keys", F.sha2(F.array_join("keys", "|"), 256).alias("pattern"))


def _marks(keys: Column) -> list[Column]:
    """128 bits of a set, in two numbers: an element has one of them by its hash."""
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(k).bitwiseAND(63).cast("int"))
    half = lambda k: F.xxhash64(k).bitwiseAND(64)
    return [F.aggregate(keys, F.lit(0).cast("long"), lambda m, k: F.when(half(k) == at, m.bitwiseOR(one(k))).otherwise(m)) for at in (0, 64)]


def _groups(events: DataFrame) -> DataFrame:
    """(score_id, keys, numbers): the bars of a score with the same hits; empty bars are no pattern."""
    return bar_rows(events).where(F.size("keys") > 0).groupBy("score_id", "keys").agg(F.sort_array(F.collect_list("bar_number")).alias("numbers"))


def exact_repeats(events: DataFrame) -> DataFrame:
    """AN6: groups of bars of a score with the same hits; empty bars are no pattern."""
    return _groups(events).where(F.size("numbers") > 1).select("score_id", F.size("numbers").cast("long").alias("n_bars"), F.array_join(F.col("numbers").cast("array<string>"), ",").alias("bars"), F.size("keys").alias("n_hits"))


def near_repeats(events: DataFrame, threshold: float = 0.75) -> DataFrame:
    """AN7: pairs of bars, one from each exact group, whose similarity rounded to two places reaches the threshold.

    The bars of a score meet each other where the score is, as a few numbers each: a bit that one has and the
    other lacks is an element that they do not share, so most pairs are left out by two differences of bits. Sets are
    compared for the others only. No tokens or pairs are shuffled; a score's bars meet in one task, row by row.
    """
    low, high = _marks(F.col("keys"))
    groups = _groups(events).select("*", low.alias("low"), high.alias("high"))
    side = lambda s: groups.select("score_id", F.get("numbers", F.lit(0)).alias(f"bar_{s}"), F.col("keys").alias(f"k{s}"), F.size("keys").alias(f"n{s}"), F.col("low").alias(f"l{s}"), F.col("high").alias(f"h{s}"))
    lacks = lambda s, o: F.col(f"n{s}") - F.bit_count(F.col(f"l{s}").bitwiseAND(F.bitwise_not(f"l{o}"))) - F.bit_count(F.col(f"h{s}").bitwiseAND(F.bitwise_not(f"h{o}")))
    least = threshold - 0.005 - 1e-9
    may = (F.col("bar_a") < F.col("bar_b")) & (F.least(lacks("a", "b"), lacks("b", "a")) * (1 + least) >= least * (F.col("na") + F.col("nb")))
    met = side("a").alias("a").join(side("b").alias("b"), (F.col("a.score_id") == F.col("b.score_id")) & may)
    # Settled, for a filter on the similarity would else be tried on every pair before the bits are.
    near = settled(met.select("a.score_id", "bar_a", "bar_b", round2(jaccard(F.col("ka"), F.col("kb"))).alias("similarity")))
    return near.where(F.col("similarity") >= threshold)


def corpus_patterns(events: DataFrame) -> DataFrame:
    """AN8: patterns that several bars of the corpus share: bars, scores, and the first place."""
    groups = _patterns(events).groupBy("pattern").agg(F.count(F.lit(1)).alias("n_bars"), F.countDistinct("score_id").alias("n_scores"), F.min(F.struct("score_id", "bar_number")).alias("first"), F.first(F.size("keys")).alias("n_hits"))
    return groups.where("n_bars > 1").select("pattern", "n_bars", "n_scores", F.col("first.score_id").alias("first_score"), F.col("first.bar_number").alias("first_bar"), "n_hits")


def _nearest(least: float, threshold: float, both: bool, left, right, chunk: int = 256):
    """Of two blocks of sets (pattern, keys joined by |): for each set, how many of the other block are near, the most similar and how alike, in hundredths.

    Elements in common are a product of 0/1 matrices, by rows of `chunk`, so memory is bounded whatever is alike. Patterns ascend,
    so that the first of the best is the smallest one. both: the right block's sets are told as well, else the blocks are one.
    """
    import numpy as np

    def read(table):
        table = table.sort_by("pattern")
        return table["pattern"].to_numpy(), [k.split("|") for k in table["keys"].to_pylist()]

    def ones(sets, index):
        m = np.zeros((len(sets), len(index)), np.float32)
        m[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), [index[k] for s in sets for k in s]] = 1
        return m

    (pa, sa), (pb, sb) = read(left), read(right)
    index = {k: i for i, k in enumerate(dict.fromkeys(k for sets in (sa, sb) for s in sets for k in s))}
    b, na, nb = ones(sb, index).T, np.array([len(s) for s in sa], np.float64), np.array([len(s) for s in sb], np.float64)
    count = [np.zeros(len(pa), np.int64), np.zeros(len(pb), np.int64)]
    best, at = [np.zeros(len(pa), np.int64), np.zeros(len(pb), np.int64)], [np.zeros(len(pa), np.int64), np.zeros(len(pb), np.int64)]
    for lo in range(0, len(pa), chunk):
        common = (ones(sa[lo : lo + chunk], index) @ b).astype(np.float64)
        raw = common / (na[lo : lo + chunk, None] + nb[None] - common)
        like = np.floor(raw * 100 + 0.5)
        like[(raw < least) | (like / 100 < threshold)] = 0
        if not both:
            like[np.arange(len(like)), np.arange(lo, lo + len(like))] = 0
        rows, first = slice(lo, lo + len(like)), like.argmax(1)
        count[0][rows], at[0][rows], best[0][rows] = (like > 0).sum(1), first, like[np.arange(len(like)), first]
        if both:
            first, top = like.argmax(0), like.max(0)
            better = top > best[1]
            at[1][better], best[1][better] = first[better] + lo, top[better]
            count[1] += (like > 0).sum(0)
    return [(p[c > 0], c[c > 0], other[x[c > 0]], s[c > 0]) for p, other, c, x, s in ((pa, pb, count[0], at[0], best[0]), (pb, pa, count[1], at[1], best[1]))[: 2 if both else 1]]


def corpus_near_patterns(events: DataFrame, threshold: float = 0.75, block: int = 16384) -> DataFrame:
    """AN8: for each pattern of the corpus with near ones (rounded similarity of the threshold or more): how many, the most similar, and how alike.

    One row a pattern: the pairs themselves grow with the square of the patterns that share a groove, and so they are
    counted where they are found. Patterns are dealt by size into blocks; blocks whose sizes can be near meet in pairs.
    """
    import pyarrow as pa

    least = threshold - 0.005 - 1e-9
    reps = _patterns(events).groupBy("pattern").agg(F.first("keys").alias("keys")).select("pattern", F.array_join("keys", "|").alias("keys"), F.size("keys").alias("n"))
    # Blocks of neighbouring sizes (a few hundred sizes at most): a size that fills more than one is dealt over several.
    first, blocks = {}, []
    for n, c in sorted((r.n, r["count"]) for r in reps.groupBy("n").count().collect()):
        if blocks and blocks[-1][2] + c <= block:
            first[n], blocks[-1][1:] = (len(blocks) - 1, 1), [n, blocks[-1][2] + c]
        else:
            first[n] = (len(blocks), -(-c // block))
            blocks += [[n, n, -(-c // first[n][1])] for _ in range(first[n][1])]
    meet = [(x, y) for y in range(len(blocks)) for x in range(y + 1) if blocks[x][1] >= least * blocks[y][0]]
    spark = events.sparkSession
    of_size = F.broadcast(spark.createDataFrame([(n, *x) for n, x in first.items()] or [(0, 0, 1)], "n int, start int, parts int"))
    dealt = reps.join(of_size, "n").select("pattern", "keys", (F.col("start") + F.pmod(F.xxhash64("pattern"), F.col("parts"))).cast("int").alias("block"))
    side = lambda i: dealt.join(F.broadcast(spark.createDataFrame([(p[i], *p) for p in meet] or [(0, 0, 0)], "block int, x int, y int")), "block").select(*[F.col(c).alias(c) for c in ("x", "y", "pattern", "keys")])

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _nearest(least, threshold, left["x"][0] != left["y"][0], left, right) if left.num_rows and right.num_rows else []
        parts = [pa.table({"pattern": pa.array(p, pa.string()), "n": pa.array(c, pa.int64()), "other": pa.array(o, pa.string()), "like": pa.array(s, pa.int64())}) for p, c, o, s in found]
        return pa.concat_tables(parts) if parts else pa.table({"pattern": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.string()), "like": pa.array([], pa.int64())})

    both = side(0).groupBy("x", "y").cogroup(side(1).groupBy("x", "y")).applyInArrow(near, "pattern string, n long, other string, like long")
    return both.groupBy("pattern").agg(F.sum("n").alias("n_near"), F.min_by("other", F.struct(-F.col("like"), "other")).alias("nearest"), (F.max("like") / 100.0).alias("similarity"))


def fill_candidates(events: DataFrame, threshold: float = 0.5) -> DataFrame:
    """AN9, AN12: bars that stand out from those up to two numbers away, with their signals and reasons in words."""
    bars = bar_rows(events)
    strokes = F.flatten(F.transform("hits", lambda e: e["drums"]))
    keeps = F.exists(strokes, lambda d: d.isin(*HI_HATS, *CYMBALS))
    toms = F.size(F.filter(strokes, lambda d: d.isin(*TOMS)))
    one = bars.select(*BAR, "keys", F.size("hits").alias("n"), F.size(strokes).alias("strokes"), toms.alias("toms"), keeps.alias("keeps"), F.array_contains("keys", "000:crash").alias("crash"))
    around = Window.partitionBy("score_id").orderBy("bar_number").rangeBetween(-2, 2)
    by_number = Window.partitionBy("score_id").orderBy("bar_number")
    near = F.filter(F.collect_list(F.struct("bar_number", "keys", "n", "keeps")).over(around), lambda b: b["bar_number"] != F.col("bar_number"))
    seen = one.withColumns({"near": near, "after": F.coalesce((F.lead("bar_number").over(by_number) == F.col("bar_number") + 1) & F.lead("crash").over(by_number), F.lit(False))})
    sorted_n = F.array_sort(F.transform("near", lambda b: b["n"]))
    m = F.size("near")
    middle = F.when(m == 0, 0.0).otherwise((F.get(sorted_n, F.floor((m - 1) / 2).cast("int")) + F.get(sorted_n, F.floor(m / 2).cast("int"))) / 2)
    seen = seen.withColumns({
        "typical": middle,
        "novelty": F.when(m == 0, 0.0).otherwise(1 - F.array_max(F.transform("near", lambda b: jaccard(F.col("keys"), b["keys"])))),
        "tom_share": F.when(F.col("strokes") > 0, F.col("toms") / F.col("strokes")).otherwise(0.0),
        "timekeeping_drop": ~F.col("keeps") & (F.size(F.filter("near", lambda b: b["keeps"])) > m / 2),
    }).withColumn("density_rise", F.when(F.col("typical") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("n") - F.col("typical")) / F.col("typical")))).otherwise(0.0))
    w = FILL_WEIGHTS
    flag = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    score = w["novelty"] * F.col("novelty") + w["tom_share"] * F.col("tom_share") + w["cymbal_after"] * flag("after") + w["timekeeping_drop"] * flag("timekeeping_drop") + w["density_rise"] * F.col("density_rise")
    typical = F.when(F.col("typical") == F.floor("typical"), F.col("typical").cast("int").cast("string")).otherwise(F.col("typical").cast("string"))
    reasons = texts(
        F.when(F.col("novelty") >= 0.5, F.concat(F.lit("different from the bars around it ("), half_up(F.col("novelty") * 100).cast("string"), F.lit("% new hits)"))),
        F.when(F.col("toms") > 0, F.concat(plural(F.col("toms"), "hit"), F.lit(" on the toms"))),
        F.when(F.col("after"), F.concat(F.lit("crash on beat 1 of bar "), (F.col("bar_number") + 1).cast("string"))),
        F.when(F.col("timekeeping_drop"), "no hi-hat or ride while the bars around it keep time"),
        F.when(F.col("density_rise") > 0, F.concat(F.col("n").cast("string"), F.lit(" hits against about "), typical, F.lit(" nearby"))),
    )
    return seen.withColumn("score", round2(score)).where(F.col("score") >= threshold).select(*BAR, "score", round2(F.col("novelty")).alias("novelty"), round2(F.col("tom_share")).alias("tom_share"), F.col("after").alias("cymbal_after"), "timekeeping_drop", round2(F.col("density_rise")).alias("density_rise"), F.array_join(reasons, "; ").alias("reasons"))


def complexity(events: DataFrame, scores: DataFrame) -> DataFrame:
    """AN10, AN12: 0-100 for each bar, its six signals, its rank in the score, and reasons in words."""
    bars = bar_rows(events)
    strokes = F.array_distinct(F.flatten(F.transform("hits", lambda e: e["drums"])))
    n = F.size("hits")
    level = F.lit(0.2)
    for ticks, value in SUBDIVISION_LEVEL.items():
        level = F.when(F.col("smallest.duration_ticks") == ticks, value).otherwise(level)
    moves = F.size(F.filter(F.transform("hits", lambda e, i: (i > 0) & (F.array_join(e["drums"], ",") != F.array_join(F.get("hits", i - 1)["drums"], ","))), lambda x: x))
    facts = bars.withColumns({
        "n": n, "small": _small_label(),
        "level": F.when(F.col("smallest").isNull(), 0.0).otherwise(level),
        "together": F.size(F.filter("hits", lambda e: F.exists(e["drums"], lambda d: d.isin(*FOOT)) & F.exists(e["drums"], lambda d: ~d.isin(*FOOT)))),
        "off": F.size(F.filter("hits", lambda e: ~(e["onset_ticks"] % TICKS_PER_BEAT).isin(0, 24))),
        "lengths": F.size(F.array_distinct(F.transform("ev", lambda e: e["duration_ticks"]))),
        "drums": F.size(strokes), "moves": moves,
    })
    # What the score adds meets a bar's few numbers, not its events.
    facts = facts.drop("ev", "hits", "keys", "smallest", "filled").join(scores.select("score_id", "tempo_bpm"), "score_id")
    per_hit = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    signals = facts.withColumns({
        "subdivision_density": F.when(F.col("n") > 0, (F.least(F.lit(1.0), F.col("n") / 16) + F.col("level")) / 2).otherwise(0.0),
        "coordination": per_hit("together"), "syncopation": per_hit("off"),
        "rhythm_changes": F.least(F.lit(1.0), (F.col("lengths") - 1) / 3 + F.when(F.col("triplet_groups") > 0, 0.34).otherwise(0.0)),
        "drum_movement": F.when(F.col("n") > 1, (F.least(F.lit(1.0), (F.col("drums") - 1) / 5) + F.col("moves") / (F.col("n") - 1)) / 2).otherwise(0.0),
        "tempo": clamp((F.col("tempo_bpm") - 60) / 140),
    })
    score = half_up(100 * reduce(Column.__add__, [F.lit(w) * F.col(c) for c, w in COMPLEXITY_WEIGHTS.items()])).cast("int")
    reasons = texts(
        F.when(F.col("small").isNotNull() & (F.col("subdivision_density") >= 0.5), F.concat(plural(F.col("n"), "hit"), F.lit(", down to "), F.col("small"), F.lit(" notes"))),
        F.when(F.col("together") > 0, F.concat(F.lit("kick or hi-hat pedal together with another drum on "), F.col("together").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" hits"))),
        F.when(F.col("off") > 0, F.concat(plural(F.col("off"), "hit"), F.lit(' on "e", "a" or triplet counts rather than the beat or "&"'))),
        F.when(F.col("rhythm_changes") >= 0.3, F.concat(F.col("lengths").cast("string"), F.lit(" different note lengths"), F.when(F.col("triplet_groups") > 0, ", including triplets").otherwise(""))),
        F.when(F.col("drums") >= 4, F.concat(F.lit("moves around "), F.col("drums").cast("string"), F.lit(" different drums"))),
    )
    scored = signals.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("score_id").orderBy(F.desc("score"), "bar_number"))
    return scored.select(*BAR, "score", rank.alias("rank"), *[round2(F.col(c)).alias(c) for c in COMPLEXITY_WEIGHTS], F.array_join(reasons, "; ").alias("reasons"))


def bar_ranges(numbers: DataFrame, keys: list[str], number: str = "bar_number") -> DataFrame:
    """AN16: runs of consecutive numbers as (keys, from_bar, to_bar)."""
    w = Window.partitionBy(*keys).orderBy(number)
    return numbers.select(*keys, number).distinct().withColumn("island", F.col(number) - F.row_number().over(w)).groupBy(*keys, "island").agg(F.min(number).alias("from_bar"), F.max(number).alias("to_bar")).drop("island")


def complex_passages(ranked: DataFrame, top: int = 3) -> DataFrame:
    """AN11: the top bars of complexity() joined into passages, each with the best score of its bars."""
    best = ranked.where(F.col("rank") <= top)
    w = Window.partitionBy("score_id").orderBy("bar_number")
    return best.withColumn("island", F.col("bar_number") - F.row_number().over(w)).groupBy("score_id", "island").agg(F.min("bar_number").alias("from_bar"), F.max("bar_number").alias("to_bar"), F.max("score").alias("score")).drop("island")


def _plan_steps() -> Column:
    """The five steps of a plan for bars lo to hi, from the columns counting and tempo_bpm."""
    spaced = _spaced(F.col("counting"))
    label = F.when(F.col("lo") == F.col("hi"), F.concat(F.lit("bar "), F.col("lo").cast("string"))).otherwise(F.concat_ws("", F.lit("bars "), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string")))
    bpm = lambda f: F.greatest(F.lit(40), F.least(F.col("tempo_bpm"), half_up(F.col("tempo_bpm") * f).cast("int"))).cast("int")
    return F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(t).alias("title"), b.cast("int").alias("bpm"), F.concat(*x).alias("instruction")) for i, (t, b, x) in enumerate((
        ("Count it", F.lit(None), (F.lit("Say the count for "), label, F.lit(" out loud: "), spaced)),
        ("Slow", bpm(0.6), (F.lit("Play "), label, F.lit(" slowly with the metronome."))),
        ("Loop", bpm(0.8), (F.lit("Loop "), label, F.lit(" at a medium tempo."))),
        ("Connect", bpm(0.8), (F.lit("Add one bar before and one bar after "), label, F.lit("."))),
        ("Full tempo", F.col("tempo_bpm"), (F.lit("Play "), label, F.lit(" at the score's tempo."))),
    ))])


def _spaced(counting: Column) -> Column:
    """A spoken count with its syllables apart."""
    return F.regexp_replace(counting, r"(\d)(e|&|a|trip|let)(?![a-z])", "$1 $2")


def practice_plan(events: DataFrame, scores: DataFrame, requests: DataFrame) -> DataFrame:
    """AN13: requests(request_id, score_id, from_bar, to_bar) whose bars all exist -> five steps each."""
    asked = requests.withColumns({"lo": F.least("from_bar", "to_bar"), "hi": F.greatest("from_bar", "to_bar")})
    spoken = inspect_bars(events, requests).groupBy("request_id").agg(F.max("missing").alias("missing"), _counted().alias("counting")).where(~F.col("missing"))
    return asked.join(spoken, "request_id").join(scores.select("score_id", "tempo_bpm"), "score_id").select("request_id", "score_id", F.explode(_plan_steps()).alias("s")).select("request_id", "score_id", "s.*")


def _counted() -> Column:
    return F.array_join(F.sort_array(F.collect_list(F.struct("bar_number", "counting")))["counting"], " | ")


def insights(events: DataFrame, scores: DataFrame, bars: DataFrame) -> DataFrame:
    """AN14: (score_id, kind, place, text, from_bar, to_bar): overview, complex, repeats, fills and review rows."""
    none = F.lit(None).cast("int")
    row = lambda df, kind, place, text, lo=none, hi=none: df.select("score_id", F.lit(kind).alias("kind"), place.cast("int").alias("place"), text.alias("text"), lo.cast("int").alias("from_bar"), hi.cast("int").alias("to_bar"))
    o = overview(events, scores)
    first = row(o, "overview", F.lit(1), F.concat(F.col("total_bars").cast("string"), F.lit(" bars of 4/4 at "), F.col("tempo_bpm").cast("string"), F.lit(" BPM")))
    short = row(o.where("smallest_note is not null"), "overview", F.lit(2), F.concat(F.lit("Shortest note: "), "smallest_note"), F.substring_index("smallest_bars", ",", 1), F.substring_index("smallest_bars", ",", 1))
    by = lambda *order: F.row_number().over(Window.partitionBy("score_id").orderBy(*order))
    busy = complex_passages(complexity(events, scores)).withColumn("place", by(F.desc("score"), "from_bar"))
    passages = row(busy, "complex", F.col("place"), F.concat(F.lit("notation score "), F.col("score").cast("string"), F.lit("/100")), F.col("from_bar"), F.col("to_bar"))
    exact = exact_repeats(events).withColumn("at", F.substring_index("bars", ",", 1).cast("int")).withColumn("place", by("at"))
    same = row(exact, "repeats", F.col("place"), F.concat(F.lit("same pattern in bars "), "bars"), F.col("at"), F.col("at"))
    alike = near_repeats(events).withColumn("place", by(F.desc("similarity"), "bar_a", "bar_b")).where("place <= 3")
    near = row(alike, "near", F.col("place"), F.concat(half_up(F.col("similarity") * 100).cast("string"), F.lit("% the same as bar "), F.col("bar_a").cast("string")), F.col("bar_b"), F.col("bar_b"))
    fills = fill_candidates(events).withColumn("place", by(F.desc("score"), "bar_number")).where("place <= 3")
    fill = row(fills, "fills", F.col("place"), F.concat(F.lit("might be a fill: "), "reasons"), F.col("bar_number"), F.col("bar_number"))
    todo = row(bars.where("reviewed = false").withColumn("place", by("bar_number")), "review", F.col("place"), F.lit("imported and not checked yet"), F.col("bar_number"), F.col("bar_number"))
    return reduce(DataFrame.unionByName, [first, short, passages, same, near, fill, todo])


def resolve_citations(citations: DataFrame, scores: DataFrame, bars: DataFrame) -> DataFrame:
    """AN15: citations(citation_id, score_id, revision, from_bar_id, to_bar_id) -> status and bar numbers."""
    revision = scores.select("score_id", F.col("revision").alias("current"))
    one = lambda s: bars.select("score_id", F.col("bar_id").alias(f"{s}_bar_id"), F.col("bar_number").alias(f"{s}_at"))
    found = citations.join(revision, "score_id", "left").join(one("from"), ["score_id", "from_bar_id"], "left").join(one("to"), ["score_id", "to_bar_id"], "left")
    status = F.when(F.col("current").isNull(), "unknown score").when(F.col("current") != F.col("revision"), "score has changed").when(F.col("from_at").isNull() | F.col("to_at").isNull(), "bars are gone").otherwise("ok")
    ok = F.col("status") == "ok"
    return found.withColumn("status", status).select("citation_id", "score_id", "status", F.when(ok, F.least("from_at", "to_at")).alias("from_bar"), F.when(ok, F.greatest("from_at", "to_at")).alias("to_bar"))


def _english(items: Column) -> Column:
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1)))


def offline_answers(events: DataFrame, scores: DataFrame, requests: DataFrame) -> DataFrame:
    """AN17: requests(request_id, score_id, question, from_bar, to_bar) -> (request_id, question, answer, abstained, cited).

    Questions: explain-bar, count-bar, practice-plan, find-complex, find-repeats, overview. The first
    three look at up to four bars of the range and abstain where none of them exists (a plan: where any
    is missing). cited is a list of bar ranges such as 1-4,6-6.
    """
    asked = requests.withColumns({"lo": F.least("from_bar", "to_bar"), "hi": F.greatest("from_bar", "to_bar")})
    plan = F.col("question") == "practice-plan"
    shown = asked.where(F.col("question").isin("explain-bar", "count-bar", "practice-plan")).select("request_id", "score_id", "question", "lo", F.when(plan, F.col("hi")).otherwise(F.least("hi", F.col("lo") + 3)).alias("hi"))
    there = inspect_bars(events, shown.select("request_id", "score_id", F.col("lo").alias("from_bar"), F.col("hi").alias("to_bar"))).drop("score_id").join(shown, "request_id")
    number = F.col("bar_number").cast("string")
    told = F.when(F.col("n_hits") == 0, F.concat(F.lit("Bar "), number, F.lit(" is all rests."))).otherwise(F.concat(F.lit("Bar "), number, F.lit(" has "), plural(F.col("n_hits"), "hit"), F.when(F.col("smallest_note").isNotNull(), F.concat(F.lit(", the shortest note is a "), "smallest_note")).otherwise(""), F.when(F.col("n_rests") > 0, F.concat(F.lit(", "), plural(F.col("n_rests"), "rest"))).otherwise(""), F.lit(".")))
    changed = F.when((F.coalesce("added", F.lit("")) == "") & (F.coalesce("removed", F.lit("")) == ""), F.concat(F.lit("Bar "), number, F.lit(" is the same as the bar before."))).otherwise(F.concat(F.lit("Bar "), number, F.lit(" "), F.concat_ws(" and ", F.when(F.col("added") != "", F.concat(F.lit("adds "), "added")), F.when(F.col("removed") != "", F.concat(F.lit("drops "), "removed"))), F.lit(".")))
    first = F.min(F.when(~F.col("missing"), F.col("bar_number"))).over(Window.partitionBy("request_id"))
    line = F.when(F.col("question") == "count-bar", F.concat(F.lit("Bar "), number, F.lit(": "), _spaced(F.col("counting")), F.lit("."))).when(F.col("bar_number") == F.col("first"), told).otherwise(changed)
    has = ~F.col("missing")
    rows = there.withColumn("first", first).withColumn("line", F.when(has & ~plan, line))
    per = rows.groupBy("request_id", "score_id", "question", "lo", "hi").agg(F.max("missing").alias("missing"), _counted().alias("counting"), F.sort_array(F.collect_list(F.when(has, F.struct("bar_number", "line")))).alias("lines"))
    spoken = F.array_join(F.transform(_plan_steps(), lambda s: F.concat(s["step"].cast("string"), F.lit(". "), s["title"], F.when(s["bpm"].isNotNull(), F.concat(F.lit(" at "), s["bpm"].cast("string"), F.lit(" BPM"))).otherwise(""), F.lit(": "), s["instruction"])), " ")
    span = lambda lo, hi: F.concat(lo.cast("string"), F.lit("-"), hi.cast("string"))
    per = per.join(scores.select("score_id", "tempo_bpm", F.lit(True).alias("known")), "score_id", "left").where(F.when(plan, ~F.col("missing") & F.col("known")).otherwise(F.size("lines") > 0))
    said = per.select("request_id", F.when(plan, spoken).otherwise(F.array_join("lines.line", " ")).alias("answer"), F.when(plan, span(F.col("lo"), F.col("hi"))).otherwise(span(F.get("lines", F.lit(0))["bar_number"], F.element_at("lines", -1)["bar_number"])).alias("cited"))
    # A row a score, with what the other questions ask of it: each part is found once.
    top, join_spans = F.element_at("p", 1), lambda x: F.array_join(F.transform(x, lambda r: span(r["from_bar"], r["to_bar"])), ",")
    best = complexity(events, scores).where("rank <= 3").select(*BAR, "score", "rank", "reasons")
    island = F.col("bar_number") - F.row_number().over(Window.partitionBy("score_id").orderBy("bar_number"))
    passages = best.withColumn("island", island).groupBy("score_id", "island").agg((-F.max("score")).alias("o"), F.min("bar_number").alias("from_bar"), F.max("bar_number").alias("to_bar"), F.sort_array(F.collect_list(F.struct("rank", "bar_number", "reasons"))).alias("why"))
    passages = passages.groupBy("score_id").agg(F.sort_array(F.collect_list(F.struct("o", "from_bar", "to_bar", "why"))).alias("p"))
    # The reasons of the first passage's bars, the busiest bar's first; three of them.
    why = F.slice(F.flatten(F.transform(F.filter(top["why"], lambda r: r["reasons"] != ""), lambda r: F.split(r["reasons"], "; "))), 1, 3)
    bars_of = lambda x: F.concat(F.lit("bars "), span(x["from_bar"], x["to_bar"]))
    reason = F.when(F.size(why) > 0, _english(why)).otherwise("it has the most notes")
    busy = F.concat(F.lit("The busiest notation is in "), bars_of(top), F.lit(" (notation score "), (-top["o"]).cast("string"), F.lit(" out of 100): "), reason, F.lit(". This is how busy the notes are, not how hard they feel."))
    exact = _groups(events).where(F.size("numbers") > 1).groupBy("score_id").agg(F.sort_array(F.collect_list("numbers")).alias("same"))
    order = F.row_number().over(Window.partitionBy("score_id").orderBy(F.desc("similarity"), "bar_a", "bar_b"))
    alike = near_repeats(events).withColumn("k", order).where("k <= 2").groupBy("score_id").agg(F.sort_array(F.collect_list(F.struct("k", "bar_a", "bar_b", "similarity"))).alias("near"))
    same_text = F.array_join(F.transform("same", lambda g: F.concat(F.lit("Bars "), _english(g.cast("array<string>")), F.lit(" are exactly the same."))), " ")
    near_text = F.array_join(F.transform("near", lambda m: F.concat(F.lit("Bar "), m["bar_b"].cast("string"), F.lit(" is "), half_up(m["similarity"] * 100).cast("string"), F.lit("% the same as bar "), m["bar_a"].cast("string"), F.lit("."))), " ")
    none = F.array().cast("array<int>")
    repeated = F.sort_array(F.array_distinct(F.concat(F.coalesce(F.flatten("same"), none), F.coalesce(F.flatten(F.transform("near", lambda m: F.array(m["bar_a"], m["bar_b"]))), none))))
    groups = exact.join(alike, "score_id", "full").withColumn("r", repeated)
    starts = F.filter("r", lambda x, i: (i == 0) | (F.get("r", i - 1) != x - 1))
    ends = F.filter("r", lambda x, i: (i == F.size("r") - 1) | (F.get("r", i + 1) != x + 1))
    groups = groups.select("score_id", F.concat_ws(" ", same_text, near_text).alias("repeats"), join_spans(F.slice(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("from_bar"), b.alias("to_bar"))), 1, 10)).alias("repeats_at"))
    drums = F.transform(F.slice(F.split("drums_used", ","), 1, 4), lambda d: F.translate(F.substring_index(d, ":", 1), "_", " "))
    busiest = F.coalesce(F.concat(F.lit(" The busiest notation is in "), bars_of(top), F.lit(".")), F.lit(""))
    summary = F.concat(F.lit("This score has "), F.col("total_bars").cast("string"), F.lit(" bars of 4/4 at "), F.col("tempo_bpm").cast("string"), F.lit(" BPM, about "), half_up(F.col("duration_seconds")).cast("string"), F.lit(" seconds long."), F.when(F.col("drums_used") != "", F.concat(F.lit(" It mostly uses "), _english(drums))).otherwise(F.lit(" It has no hits")), F.when(F.col("smallest_note").isNotNull(), F.concat(F.lit(", and the shortest note is a "), "smallest_note")).otherwise(""), F.lit("."), busiest)
    by_score = overview(events, scores).join(passages, "score_id", "full").join(groups, "score_id", "full")
    by_score = by_score.select("score_id", busy.alias("busy"), F.coalesce(join_spans(F.col("p")), F.lit("")).alias("busy_at"), "repeats", "repeats_at", summary.alias("summary"), F.coalesce(span(top["from_bar"], top["to_bar"]), F.lit("")).alias("summary_at"))
    whole = asked.select("request_id", "score_id", "question").join(by_score, "score_id", "left")
    of = lambda a, b, c: F.when(F.col("question") == "find-complex", a).when(F.col("question") == "find-repeats", b).when(F.col("question") == "overview", c)
    scored = whole.select("request_id", "question", of(F.col("busy"), F.coalesce("repeats", F.lit("No bars repeat in this part of the score.")), F.col("summary")).alias("of_score"), of(F.col("busy_at"), F.col("repeats_at"), F.col("summary_at")).alias("of_score_at"))
    answer = F.coalesce("of_score", "answer")
    return scored.join(said, "request_id", "left").select("request_id", "question", F.coalesce(answer, F.lit("Those bars are not in the part of the score that was shared.")).alias("answer"), answer.isNull().alias("abstained"), F.when(answer.isNull(), "").otherwise(F.coalesce("of_score_at", "cited", F.lit(""))).alias("cited"))
