"""Decoding and model evaluation (EV1-EV18).

Notes are (item_id, position, duration, drums). Both sides are nested to a row an item, so one join by item
serves every metric.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwise.functions.notation import DRUMS, DURATIONS, MODEL_SHAPES, SLOT_TICKS, SLOTS, half_up, strings, tenth_percent
from tickwise.operators.scores import BAR


def decode_logits(rows: DataFrame, slots: int, drums: tuple[str, ...], durations: tuple[str, ...], threshold: float = 0.5) -> DataFrame:
    """EV1: rows(item_id, drum_logits, dur_logits) plus notes, ordered; null notes where a length is wrong or a value not finite.

    A drum sounds where sigmoid(x) > threshold, that is x > log(t / (1 - t)); the duration is the first maximum.
    """
    line, d, u = math.log(threshold / (1 - threshold)), len(drums), len(durations)
    finite = lambda c: ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = (F.size("drum_logits") == slots * d) & (F.size("dur_logits") == slots * u) & finite("drum_logits") & finite("dur_logits")

    def note(i: Column) -> Column:
        cells, lengths = F.slice("drum_logits", i * d + 1, F.lit(d)), F.slice("dur_logits", i * u + 1, F.lit(u))
        on = F.filter(F.transform(cells, lambda x, k: F.when(x > line, F.get(strings(drums), k))), lambda x: x.isNotNull())
        return F.struct(i.alias("position"), F.element_at(strings(durations), F.array_position(lengths, F.array_max(lengths)).cast("int")).alias("duration"), on.alias("drums"))

    notes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), note), lambda n: F.size(n["drums"]) > 0)
    return rows.withColumn("notes", F.when(F.coalesce(ok, F.lit(False)), notes))


def _nested(notes: DataFrame, name: str) -> DataFrame:
    """One row an item: notes in order of position, hits as position:drum, positions and drums."""
    rows = notes.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("position", "duration", F.array_sort("drums").alias("drums")))).alias(name))
    return rows.withColumns({f"{name}_hits": F.flatten(F.transform(name, lambda n: F.transform(n["drums"], lambda d: F.concat(n["position"].cast("string"), F.lit(":"), d)))), f"{name}_drums": F.array_distinct(F.flatten(F.col(name)["drums"]))})


def paired(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Items of truth or prediction with both sides nested; a silent side is an empty list."""
    t, p = _nested(truth, "t"), _nested(pred, "p")
    both = t.join(p, "item_id", "full")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(both.schema[c].dataType))
    return both.select("item_id", *[empty(c).alias(c) for c in ("t", "t_hits", "t_drums", "p", "p_hits", "p_drums")])


def _matched_durations() -> Column:
    """Positions of truth that are predicted with the same duration."""
    keyed = lambda c: F.transform(c, lambda n: F.concat(n["position"].cast("string"), F.lit(":"), n["duration"]))
    return F.size(F.array_intersect(keyed("t"), keyed("p")))


def evaluate(truth: DataFrame, pred: DataFrame, cells: int = SLOTS * len(DRUMS)) -> DataFrame:
    """EV2-EV5, EV8: one row: sequence, exact-bar, cell and duration accuracy, non-empty predictions, bars.

    A sequence is the ordered (drums, duration) list; its positions do not count. Durations are
    counted at true hits; without any the accuracy is null.
    """
    shape = lambda c: F.transform(c, lambda n: F.struct(n["drums"].alias("drums"), n["duration"].alias("duration")))
    off = F.size(F.array_except("t_hits", "p_hits")) + F.size(F.array_except("p_hits", "t_hits"))
    one = paired(truth, pred).select((shape("t") == shape("p")).alias("same"), off.alias("off"), _matched_durations().alias("right"), F.size("t").alias("n_true"), (F.size("p") > 0).alias("some"))
    return one.agg(F.count(F.lit(1)).alias("bars"), F.count_if("same").alias("same"), F.count_if(F.col("off") == 0).alias("exact"), F.sum("off").alias("off"), F.sum("right").alias("right"), F.sum("n_true").alias("n_true"), F.count_if("some").alias("nonempty_bars")).select("bars", "nonempty_bars", (F.col("same") / F.col("bars")).alias("sequence_accuracy"), (F.col("exact") / F.col("bars")).alias("exact_bar_accuracy"), (1 - F.col("off") / (F.col("bars") * cells)).alias("cell_accuracy"), F.try_divide("right", "n_true").alias("duration_accuracy"))


def drum_scores(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """EV6: by drum: bars where it is rightly, wrongly or not found, F1 (0 without any) and support."""
    one = paired(truth, pred).select(F.explode(F.array_union("t_drums", "p_drums")).alias("drum"), "t_drums", "p_drums").select("drum", F.array_contains("t_drums", F.col("drum")).alias("t"), F.array_contains("p_drums", F.col("drum")).alias("p"))
    counts = one.groupBy("drum").agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"))
    names = truth.sparkSession.createDataFrame([(d,) for d in DRUMS], "drum string")
    full = names.join(counts, "drum", "left").fillna(0, ["tp", "fp", "fn"])
    return full.withColumns({"f1": F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), "support": F.col("tp") + F.col("fn")})


def duration_scores(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """EV7: by true duration: support, right, accuracy (null without support)."""
    rows = truth.join(pred.select("item_id", "position", F.col("duration").alias("said")), ["item_id", "position"], "left")
    counts = rows.groupBy("duration").agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("said") == F.col("duration")).alias("correct"))
    names = truth.sparkSession.createDataFrame([(d,) for d in DURATIONS], "duration string")
    return names.join(counts, "duration", "left").fillna(0, ["support", "correct"]).withColumn("accuracy", F.try_divide("correct", "support"))


def model_agreement(a: DataFrame, b: DataFrame, items: DataFrame, cells: int = SLOTS * len(DRUMS)) -> DataFrame:
    """EV9: items(item_id): how often two models' notes agree, as sequences with positions and as cells; meaningful where enough bars have notes."""
    both = items.select("item_id").distinct().join(paired(a, b), "item_id", "left")
    off = F.coalesce(F.size(F.array_except("t_hits", "p_hits")) + F.size(F.array_except("p_hits", "t_hits")), F.lit(0))
    got = both.agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.size(F.coalesce("t_drums", F.array())) > 0).alias("bars_with_notes"), F.count_if(F.col("t").isNull() | (F.col("t") == F.col("p"))).alias("sequence_match"), F.sum(off).alias("off"))
    return got.select("bars", "bars_with_notes", "sequence_match", F.round(F.try_divide("sequence_match", "bars"), 4).alias("sequence_match_rate"), F.round(F.try_divide(F.col("off"), F.col("bars") * cells), 6).alias("slot_disagreement_rate"), (F.col("bars_with_notes") >= F.greatest(F.lit(1), F.floor(F.col("bars") / 10))).alias("meaningful"))


def logit_parity(a: DataFrame, b: DataFrame, threshold: float = 0.5, tolerance: float = 1e-4) -> DataFrame:
    """EV10: (item_id, drum_logits, dur_logits) of two runs -> largest difference, what is allowed at this scale, decision flips."""
    line = math.log(threshold / (1 - threshold))
    both = a.alias("a").join(b.alias("b"), "item_id")
    gap = lambda c: F.array_max(F.zip_with(f"a.{c}", f"b.{c}", lambda x, y: F.abs(x - y)))
    most = lambda c: F.array_max(F.transform(f"a.{c}", F.abs))
    flips = F.size(F.filter(F.zip_with("a.drum_logits", "b.drum_logits", lambda x, y: (x > line) != (y > line)), lambda x: x))
    one = both.select(F.greatest(gap("drum_logits"), gap("dur_logits")).alias("gap"), F.greatest(most("drum_logits"), most("dur_logits")).alias("most"), flips.alias("flips"))
    return one.agg(F.count(F.lit(1)).alias("bars"), F.max("gap").alias("max_abs_diff"), (F.lit(tolerance) * F.greatest(F.lit(1.0), F.max("most"))).alias("allowed_diff"), F.sum("flips").alias("decision_flips")).withColumn("ok", (F.col("max_abs_diff") <= F.col("allowed_diff")) & (F.col("decision_flips") == 0))


def latency_summary(rows: DataFrame, by: list[str], ms: str = "ms") -> DataFrame:
    """EV11: mean, p50, p95, p99, least and most by group; a percentile is the value at index floor(n p) of the sorted values.

    Places come from counts of equal values, so a group's values are never gathered in one row.
    """
    n = rows.where(F.col(ms).isNotNull()).groupBy(*by, ms).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    placed = n.withColumns({"upto": F.sum("c").over(w.orderBy(ms)), "n": F.sum("c").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1), F.col(ms)))
    return placed.groupBy(*by).agg(F.sum("c").alias("runs"), F.round(F.sum(F.col(ms) * F.col("c")) / F.sum("c"), 3).alias("mean_ms"), *[F.round(at(p).cast("double"), 3).alias(f"p{int(p * 100)}_ms") for p in (0.5, 0.95, 0.99)], F.round(F.min(ms).cast("double"), 3).alias("min_ms"), F.round(F.max(ms).cast("double"), 3).alias("max_ms"))


def heldout_truth(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """EV12: notes of test bars from gp7 sources; slots are round((beat - 1) * 8)."""
    test = manifest.where("split = 'test' and source_kind = 'gp7'").join(labels, ["song", "bar"])
    note = test.select(F.concat_ws("/", "song", F.col("bar").cast("string")).alias("item_id"), F.explode("beats").alias("e")).where(~F.coalesce("e.rest", F.lit(False)))
    return note.select("item_id", half_up((F.col("e.beat").cast("double") - 1) * 8).cast("int").alias("position"), F.col("e.duration").alias("duration"), F.col("e.drums").alias("drums"))


def bar_to_truth(events: DataFrame) -> DataFrame:
    """EV13: events -> notes of bars that the recognisers' vocabulary can say: every duration named, 192 ticks in all."""
    name = F.lit(None).cast("string")
    for model, (written, dotted, triplet) in MODEL_SHAPES.items():
        name = F.when((F.col("written_duration") == written) & (F.col("dotted") == dotted) & (F.col("triplet") == triplet), model).otherwise(name)
    named = events.withColumn("duration", name)
    whole = named.groupBy(*BAR).agg(F.count_if(F.col("duration").isNull()).alias("bad"), F.sum("duration_ticks").alias("ticks")).where("bad = 0 and ticks = 192").select(*BAR)
    return named.join(whole, BAR).where(~F.col("is_rest")).select(*BAR, half_up(F.col("onset_ticks") / SLOT_TICKS).cast("int").alias("position"), "duration", F.array_sort("drums").alias("drums"))


def compare_bars(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """EV14: one row an item: exact, and true, predicted and matched onsets, drum hits and durations."""
    pos = lambda c: F.col(c)["position"]
    onsets = F.size(F.array_intersect(pos("t"), pos("p")))
    return paired(truth, pred).select("item_id", (F.col("t") == F.col("p")).alias("exact"), F.size("t").alias("onsets_truth"), F.size("p").alias("onsets_predicted"), onsets.alias("onsets_matched"), F.size("t_hits").alias("hits_truth"), F.size("p_hits").alias("hits_predicted"), F.size(F.array_intersect("t_hits", "p_hits")).alias("hits_matched"), onsets.alias("durations_compared"), _matched_durations().alias("durations_matched"))


def benchmark_summary(results: DataFrame, prices: tuple[float, float] | None = None) -> DataFrame:
    """EV15: results(set, provider, item_id, ms, error, input_tokens, output_tokens, columns of compare_bars) by set and provider.

    A result with an error, or without a score, is not answered. Percentiles are nearest rank.
    """
    ok = F.col("error").isNull() & F.col("exact").isNotNull()
    s = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    counts = results.groupBy("set", "provider").agg(F.count(F.lit(1)).alias("bars"), F.count_if(ok).alias("answered"), F.count_if(ok & F.col("exact")).alias("n_exact"), *[s(c).alias(c) for c in ("onsets_truth", "onsets_predicted", "onsets_matched", "hits_truth", "hits_predicted", "hits_matched", "durations_compared", "durations_matched", "input_tokens", "output_tokens")])
    # Nearest rank by counts of equal values, so that no group's values are gathered.
    w = Window.partitionBy("set", "provider")
    placed = results.where(ok & F.col("ms").isNotNull()).groupBy("set", "provider", "ms").agg(F.count(F.lit(1)).alias("c")).withColumns({"upto": F.sum("c").over(w.orderBy("ms")), "n": F.sum("c").over(w)})
    ranks = placed.groupBy("set", "provider").agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * F.lit(p)), F.col("ms"))).alias(f"p{int(p * 100)}_ms") for p in (0.5, 0.95)])
    counts = counts.join(ranks, ["set", "provider"], "left")
    f1 = lambda k: F.coalesce(half_up(F.try_divide(2000.0 * F.col(f"{k}_matched"), F.col(f"{k}_truth") + F.col(f"{k}_predicted"))) / 10.0, F.lit(0.0))
    cost = F.lit(None).cast("double") if prices is None else half_up((F.col("input_tokens") * prices[0] + F.col("output_tokens") * prices[1]) / 1e6 * 10_000) / 10_000.0
    return counts.select("set", "provider", "bars", "answered", (F.col("bars") - F.col("answered")).alias("errors"), tenth_percent(F.col("bars") - F.col("answered"), F.col("bars")).alias("error_rate"), tenth_percent(F.col("n_exact"), F.col("bars")).alias("exact_bars"), f1("onsets").alias("onset_f1"), f1("hits").alias("drum_hit_f1"), tenth_percent(F.col("durations_matched"), F.col("durations_compared")).alias("duration_accuracy"), "p50_ms", "p95_ms", "input_tokens", "output_tokens", cost.alias("cost_usd"))


def resume_items(items: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EV16: results(item_id, at, exact, ...) -> (the latest scored result of each item, items still to do)."""
    scored = results.where("exact is not null")
    latest = scored.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("at")))).where("n = 1").drop("n")
    return latest, items.join(scored.select("item_id"), "item_id", "left_anti")


def segmentation_summary(pages: DataFrame, worst: int = 5) -> tuple[DataFrame, DataFrame]:
    """EV17: pages(source, doc_id, page, expected, found) -> (by source, the worst misses of each); pages that expect nothing are skipped."""
    p = pages.where("expected <> 0")
    total = p.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("found") == F.col("expected")).alias("exact"), F.sum("expected").alias("expected"), F.sum("found").alias("found"), F.sum(F.abs(F.col("found") - F.col("expected"))).alias("abs_error"))
    miss = p.where("found <> expected").withColumn("miss", F.abs(F.col("found") - F.col("expected")))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("miss"), F.desc("doc_id"), F.desc("page")))
    return total, miss.withColumn("rank", rank).where(F.col("rank") <= worst)


def release_audit(artifacts: DataFrame) -> DataFrame:
    """EV18: artifacts(run_id, artifact, checkpoint_sha, model_sha, dataset_sha, smoke) -> (run_id, problem).

    Evaluation, export and completion must agree on the checkpoint; export, config and benchmark on the
    model; run, completion, evaluation and export on the dataset, none of them missing; none is a smoke run.
    """
    groups = {"checkpoint": ("completed", "evaluation", "export", "checkpoint"), "model": ("export", "config", "benchmark", "model"), "dataset": ("run", "completed", "evaluation", "export")}
    per = artifacts.groupBy("run_id").agg(F.bool_or(F.coalesce("smoke", F.lit(False))).alias("smoke"), *[F.countDistinct(F.when(F.col("artifact").isin(*names), F.col(f"{k}_sha"))).alias(f"n_{k}") for k, names in groups.items()], *[F.count_if(F.col("artifact").isin(*names) & F.col(f"{k}_sha").isNotNull()).alias(f"have_{k}") for k, names in groups.items()])
    problems = F.array_compact(F.array(F.when(F.col("smoke"), "smoke run"), *[F.when((F.col(f"n_{k}") != 1) | (F.col(f"have_{k}") < len(names)), f"artifacts disagree on the {k}") for k, names in groups.items()]))
    return per.select("run_id", F.explode(problems).alias("problem"))
