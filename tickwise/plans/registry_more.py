"""Registered queries on labels, evaluation, practice, playback, retrieval, text, boxes and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tickwise.functions.notation import DRUMS, DURATIONS
from tickwise.operators import analytics as an
from tickwise.operators import boxes as bx
from tickwise.operators import evaluation as ev
from tickwise.operators import exercises as ex
from tickwise.operators import labels as lb
from tickwise.operators import manifest as mf
from tickwise.operators import playback as pb
from tickwise.operators import practice as pr
from tickwise.operators import subset as ts
from tickwise.operators import text_checks as tx
from tickwise.plans import adapters as ad
from tickwise.streaming import jobs as st

QUERIES = {}
NOW = datetime(2000, 1, 1)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _labels(spark, sf_dir):
    return ts.label_issues(ad.labels(spark, sf_dir))


def _usable(spark, sf_dir):
    return ts.select_subset(_labels(spark, sf_dir))[0]


@query
def ts1_label_issues(spark, sf_dir):
    return _labels(spark, sf_dir).select("song", "bar", F.array_join("reasons", ";").alias("reasons"))


@query
def ts2_excluded(spark, sf_dir):
    return ts.select_subset(_labels(spark, sf_dir))[1].select("song", "bar", "reasons")


@query
def ts3_split_leaks(spark, sf_dir):
    k = (F.substring("song", 5, 20).cast("long") * 50 + F.col("bar") - 1) % 40 == 7
    return ts.split_leaks(ad.labels(spark, sf_dir).select(F.when(k, "test").otherwise(F.col("split")).alias("split"), "song", F.col("song").alias("source_song")))


@query
def ts6_subset_report(spark, sf_dir):
    return ts.subset_report(_labels(spark, sf_dir)).withColumn("split", F.coalesce("split", F.lit("all")))


@query
def ts7_exclusion_counts(spark, sf_dir):
    return ts.exclusion_counts(_labels(spark, sf_dir))


@query
def ts10_sparse_targets(spark, sf_dir):
    return ts.encode_sparse(_usable(spark, sf_dir), ["song", "bar"]).distinct()


@query
def ts11_dense_targets(spark, sf_dir):
    d = ts.encode_dense(_usable(spark, sf_dir), ["song", "bar"])
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return d.select("song", "bar", total(F.transform("drums", lambda x: x.cast("long"))).alias("cells"), total(F.transform("drums", lambda x, i: x.cast("long") * i)).alias("cell_sum"), total("durations").alias("duration_sum"))


@query
def ts12_positive_weights(spark, sf_dir):
    usable = _usable(spark, sf_dir)
    w = ts.positive_weights(ts.encode_sparse(usable, ["song", "bar"]), usable.agg(F.count(F.lit(1))).scalar())
    return w.withColumn("weight", F.round("weight", 9))


@query
def ev1_decode_logits(spark, sf_dir):
    e = ad.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.slice("embedding", 1, 24).alias("drum_logits"), F.slice("embedding", 25, 40).alias("dur_logits"))
    return ev.decode_logits(e, 4, DRUMS[:6], DURATIONS).select("item_id", F.to_json("notes").alias("notes"))


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c, kind in df.dtypes if kind == "double"})


@query
def ev2_evaluate(spark, sf_dir):
    return _rounded(ev.evaluate(*ad.truth_and_predictions(spark, sf_dir)))


@query
def ev6_drum_scores(spark, sf_dir):
    return _rounded(ev.drum_scores(*ad.truth_and_predictions(spark, sf_dir)))


@query
def ev7_duration_scores(spark, sf_dir):
    return _rounded(ev.duration_scores(*ad.truth_and_predictions(spark, sf_dir)))


@query
def ev9_model_agreement(spark, sf_dir):
    a, b = ad.truth_and_predictions(spark, sf_dir)
    return ev.model_agreement(a, b, a)


@query
def ev10_logit_parity(spark, sf_dir):
    e = ad.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.slice("embedding", 1, 24).alias("drum_logits"), F.slice("embedding", 25, 40).alias("dur_logits"))
    moved = e.withColumns({c: F.transform(c, lambda x: x * F.lit(1.00001).cast("float")) for c in ("drum_logits", "dur_logits")})
    return ev.logit_parity(e, moved)


@query
def ev11_latency_summary(spark, sf_dir):
    return ev.latency_summary(ad.usage(spark, sf_dir).select("model", F.col("input_tokens").alias("ms")), ["model"])


@query
def ev13_bar_to_truth(spark, sf_dir):
    return ev.bar_to_truth(ad.events(spark, sf_dir)).withColumn("drums", F.array_join("drums", "+"))


@query
def ev14_compare_bars(spark, sf_dir):
    return ev.compare_bars(*ad.truth_and_predictions(spark, sf_dir))


@query
def ev15_benchmark_summary(spark, sf_dir):
    n = F.col("item_id")
    r = ev.compare_bars(*ad.truth_and_predictions(spark, sf_dir)).withColumns({"set": F.concat(F.lit("set"), (n % 2).cast("string")), "provider": F.concat(F.lit("p"), (n % 3).cast("string")), "ms": n % 1000 + 1, "error": F.when(n % 13 == 0, "late"), "input_tokens": F.lit(1), "output_tokens": F.lit(1)})
    return ev.benchmark_summary(r).drop("input_tokens", "output_tokens", "cost_usd").withColumns({c: F.col(c).cast("double") for c in ("p50_ms", "p95_ms")})


@query
def ev17_segmentation(spark, sf_dir):
    p = ad.boxes(spark, sf_dir).groupBy("doc_id", "page").agg(F.count_if(F.col("width") >= 30).alias("expected"), F.count(F.lit(1)).alias("found")).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string")))
    return ev.segmentation_summary(p)[0]


@query
def pr1_validate_practice(spark, sf_dir):
    t = ad.practice(spark, sf_dir)
    n = F.col("session_id")
    students = t["students"].withColumns({"level": F.when(F.col("student_id") % 17 == 0, "expert").otherwise(F.col("level")), "display_name": F.when(F.col("student_id") % 19 == 0, "").otherwise(F.col("display_name")), "cloud_help": F.col("student_id") % 3 == 0})
    sessions = t["sessions"].withColumns({"from_bar": F.when(n % 23 == 0, F.col("to_bar") + 1).otherwise(F.col("from_bar")), "target_bpm": F.when(n % 29 == 0, 401).otherwise(F.col("target_bpm")), "self_rating": F.when(n % 31 == 0, 6).otherwise(F.col("self_rating")), "minutes": F.when(n % 37 == 0, -1.0).otherwise(F.col("minutes"))})
    attempts = t["attempts"].withColumn("bpm", F.when((F.col("bpm") == 60) & (n % 5 == 0), 0).otherwise(F.col("bpm")))
    assignments = t["assignments"].withColumns({"status": F.when(F.col("assignment_id") % 41 == 0, "late").otherwise(F.col("status")), "title": F.when(F.col("assignment_id") % 43 == 0, F.repeat(F.lit("x"), 201)).otherwise(F.col("title"))})
    return pr.validate_practice(t | {"students": students, "sessions": sessions, "attempts": attempts, "assignments": assignments}).groupBy("table", "id", "problem").agg(F.count(F.lit(1)).alias("n"))


@query
def pr2_late_attempts(spark, sf_dir):
    t = ad.practice(spark, sf_dir)
    moved = F.when(F.col("bpm") % 7 == 0, F.expr("at + interval 40 minutes")).when(F.col("bpm") % 7 == 1, F.expr("at - interval 40 minutes")).otherwise(F.col("at"))
    return pr.late_attempts(t["attempts"].withColumn("at", moved), t["sessions"]).select("session_id", "bpm", "clean", "problem")


@query
def pr3_orphans(spark, sf_dir):
    t = ad.practice(spark, sf_dir)
    return pr.orphans(t | {"students": t["students"].where("level <> 'advanced'"), "sessions": t["sessions"].where("self_rating is not null")})


@query
def pr4_session_summary(spark, sf_dir):
    return pr.session_summary(ad.practice(spark, sf_dir))[0]


@query
def pr4_ranges(spark, sf_dir):
    return pr.session_summary(ad.practice(spark, sf_dir))[1].fillna(0, ["best_clean_bpm"])


@query
def pr5_assignments(spark, sf_dir):
    return pr.list_assignments(ad.practice(spark, sf_dir)["assignments"]).select("assignment_id", "student_id", "place")


@query
def pr7_difficulty(spark, sf_dir):
    return pr.personal_difficulty(ad.practice(spark, sf_dir), NOW).drop("reasons").fillna(-1, ["difficulty"])


@query
def pr9_progress_facts(spark, sf_dir):
    return pr.progress_facts(ad.practice(spark, sf_dir), NOW)


@query
def pr11_pseudonymise(spark, sf_dir):
    t = ad.practice(spark, sf_dir)
    return pr.pseudonymise(pr.progress_facts(t, NOW), t["students"], t["assignments"])


@query
def pr12_offline_summary(spark, sf_dir):
    return pr.offline_summary(ad.practice(spark, sf_dir))


@query
def pr13_cloud_allowed(spark, sf_dir):
    return pr.cloud_allowed(ad.practice(spark, sf_dir)["students"]).select("student_id")


def _playback(spark, sf_dir):
    return ad.requests(spark, sf_dir).join(ad.scores(spark, sf_dir).select("score_id", "tempo_bpm"), "score_id").withColumns({"count_in_beats": F.lit(4), "metronome": F.lit(True), "loop": F.lit(True)})


@query
def pb1_validate_predictions(spark, sf_dir):
    _, p = ad.truth_and_predictions(spark, sf_dir)
    n = F.col("item_id")
    bad = p.withColumns({"idx": F.col("position"), "position": F.when((n % 7 == 0) & (F.col("position") % 5 == 0), F.col("position") - 40).otherwise(F.col("position")), "duration": F.when(n % 11 == 0, "sixty_fourth").otherwise(F.col("duration")), "drums": F.when(n % 13 == 0, F.array(F.lit("gong"))).when(n % 17 == 0, F.array().cast("array<string>")).otherwise(F.col("drums"))})
    return pb.validate_predictions(bad)


@query
def pb2_bars_from_predictions(spark, sf_dir):
    _, p = ad.truth_and_predictions(spark, sf_dir)
    return pb.bars_from_predictions(p).select("item_id", F.size("notes").alias("n_notes"), F.size("warnings").alias("n_warnings"), F.to_json("notes").alias("notes"))


@query
def pb3_playback_hits(spark, sf_dir):
    return pb.playback_hits(ad.events(spark, sf_dir), _playback(spark, sf_dir)).drop("event_idx").withColumn("time", F.round("time", 6))


@query
def pb4_playback_clicks(spark, sf_dir):
    return pb.playback_clicks(_playback(spark, sf_dir)).drop("time")


@query
def pb5_events_between(spark, sf_dir):
    q = _playback(spark, sf_dir)
    windows = q.select("request_id", F.lit(5.0).alias("from_s"), F.lit(25.0).alias("to_s"), F.lit(True).alias("loop"))
    return pb.events_between(pb.playback_hits(ad.events(spark, sf_dir), q), q, windows).drop("event_idx").withColumn("time", F.round("time", 5))


@query
def pb6_position_at(spark, sf_dir):
    q = _playback(spark, sf_dir)
    probes = q.select("request_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"), "tempo_bpm").select("request_id", "i", ((F.col("i") * 101 + 200) * 60.0 / (F.col("tempo_bpm") * 48)).alias("probe_s"))
    return pb.position_at(ad.events(spark, sf_dir), q, probes).join(probes, ["request_id", "probe_s"]).select("request_id", "i", "bar_number", "event_idx", "pass")


@query
def pb7_midi_events(spark, sf_dir):
    return pb.midi_events(ad.events(spark, sf_dir))


def _catalogue(spark, sf_dir):
    """Parts as exercises."""
    p = ad.table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    goals = ("triplets", "syncopation", "kick independence", "tom movement", "reading rests")
    return p.select(F.concat(F.lit("ex"), F.lpad(n.cast("string"), 9, "0")).alias("id"), ad.pick(("exercise", "fill"), n % 2).alias("kind"), F.col("p_name").alias("title"), ad.pick(("beginner", "intermediate", "advanced"), n % 3).alias("level"), F.array(ad.pick(("rock", "jazz", "funk"), n % 3)).alias("styles"), ad.pick(("8th", "16th", "triplet 8th"), n % 3).alias("subdivision"), F.array(F.lit("hands"), ad.pick(("foot", "hands"), n % 2)).alias("limbs"), F.array_distinct(F.array(ad.pick(goals, n % 5), ad.pick(goals, n % 3))).alias("goals"), (50 + n % 40).cast("int").alias("tempo_min"), (80 + n % 60).cast("int").alias("tempo_target"), (100 + n % 90).cast("int").alias("tempo_max"), F.col("p_type").alias("description"))


@query
def ex1_search_exercises(spark, sf_dir):
    n = F.col("c_custkey")
    q = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_custkey")).select(n.alias("query_id"), F.when(n % 2 == 0, ad.pick(("beginner", "intermediate", "advanced"), n % 3)).alias("level"), F.when(n % 3 == 0, "fill").alias("kind"), F.lit(None).cast("string").alias("subdivision"), F.when(n % 4 == 0, 120).alias("max_tempo"), F.when(n % 5 == 0, F.array(F.lit("rock"))).alias("styles"), F.lit(None).cast("array<string>").alias("limbs"), F.array(ad.pick(("triplets", "syncopation", "tom movement"), n % 3)).alias("goals"), F.lit(None).cast("string").alias("text"))
    return ex.search_exercises(q, _catalogue(spark, sf_dir)).drop("overlap")


@query
def ex3_passage_facts(spark, sf_dir):
    e, q = ad.events(spark, sf_dir), ad.requests(spark, sf_dir)
    return ex.passage_facts(an.inspect_bars(e, q), e, q).withColumn("bars", F.array_join(F.transform("bars", lambda b: b.cast("string")), ","))


@query
def ex4_exercises_for_passage(spark, sf_dir):
    e, q = ad.events(spark, sf_dir), ad.requests(spark, sf_dir)
    return ex.exercises_for_passage(ex.passage_facts(an.inspect_bars(e, q), e, q), _catalogue(spark, sf_dir))


@query
def ex5_recommend_fills(spark, sf_dir):
    s = ad.scores(spark, sf_dir)
    n = F.col("score_id")
    asked = s.select(n.alias("request_id"), "tempo_bpm", ad.pick(("8th", "16th"), n % 2).alias("subdivision"), ad.pick(("beginner", "intermediate", "advanced"), n % 3).alias("level"), ad.pick(("rock", "jazz"), n % 2).alias("style"))
    return ex.recommend_fills(asked, _catalogue(spark, sf_dir))


@query
def lb8_bar_labels(spark, sf_dir):
    raw = ad.raw_beats(spark, sf_dir)
    built = lb.build_bar_labels(raw, raw.select("song", "bar", "time_signature").distinct())
    text = F.array_join(F.transform("beats", lambda b: F.concat(b["duration"], F.lit(":"), F.array_join(b["drums"], "+"), F.when(b["flam"], "!").otherwise(""))), " ")
    return built.select("song", "bar", F.size("beats").alias("n_beats"), text.alias("beats"), "simile")


@query
def lb10_unmapped_pitches(spark, sf_dir):
    return lb.unmapped_pitches(ad.raw_beats(spark, sf_dir))


@query
def mf1_normalise_title(spark, sf_dir):
    return ad.titles(spark, sf_dir).select("doc", mf.normalise_title(F.col("name")).alias("title"))


@query
def mf2_link_by_title(spark, sf_dir):
    t = ad.titles(spark, sf_dir).select("doc", mf.normalise_title(F.col("name")).alias("title"))
    known = t.select(F.when(F.col("doc") % 2 == 0, F.substring_index("title", " ", 2)).otherwise(F.col("title")).alias("title"))
    return mf.link_by_title(t, known)


@query
def mf3_pair_crops(spark, sf_dir):
    c = ad.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("song"), F.col("l_orderkey").alias("o")).distinct()
    crops = c.select("song", F.col("o").alias("crop_order"), F.col("o").alias("crop"))
    kept = ad.table(spark, sf_dir, "lineitem").join(ad.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("not (s_acctbal < 5000 and l_returnflag = 'R')").select(F.col("l_suppkey").alias("song"), F.col("l_orderkey").alias("o")).distinct()
    return mf.pair_crops(crops, kept.select("song", F.col("o").alias("bar"), F.col("o").alias("label"))).drop("bar")


@query
def mf6_duplicate_keys(spark, sf_dir):
    return mf.duplicate_keys(ad.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def mf8_split_songs(spark, sf_dir):
    return mf.split_songs(ad.packaging(spark, sf_dir)[0], seed=7)


@query
def mf10_reconcile(spark, sf_dir):
    return mf.reconcile(*ad.packaging(spark, sf_dir)).select("song", "bar", "reason")


@query
def mf11_reconciliation_summary(spark, sf_dir):
    return mf.reconciliation_summary(mf.reconcile(*ad.packaging(spark, sf_dir)))


@query
def tx2_sentences(spark, sf_dir):
    s = tx.sentences(F.col("answer"))
    return ad.answers(spark, sf_dir).select("answer_id", F.size(s).cast("long").alias("n"), F.aggregate(s, F.lit(0).cast("long"), lambda t, x: t + F.length(x)).alias("chars"))


@query
def tx3_unsupported_claims(spark, sf_dir):
    c = tx.unsupported_claims(F.col("answer"))
    return ad.answers(spark, sf_dir).select("answer_id", c.alias("c")).where(F.size("c") > 0).select("answer_id", F.array_join("c", " | ").alias("claims"))


@query
def tx4_ungrounded_drums(spark, sf_dir):
    c = tx.ungrounded_drums(F.col("answer"), F.array(F.lit("kick")))
    return ad.answers(spark, sf_dir).select("answer_id", c.alias("c")).where(F.size("c") > 0).select("answer_id", F.array_join("c", " | ").alias("sentences"))


@query
def tx5_safety_flags(spark, sf_dir):
    return ad.answers(spark, sf_dir).select("answer_id", tx.safety_flags(F.col("answer"), F.col("abstained")).alias("f")).select("answer_id", "f.*")


@query
def tx6_bar_mentions(spark, sf_dir):
    return ad.answers(spark, sf_dir).select("answer_id", F.array_join(F.transform(tx.bar_mentions(F.col("answer")), lambda n: n.cast("string")), ",").alias("bars"))


def _answers(spark, sf_dir):
    ref = F.array(F.struct("from_bar", "to_bar"))
    return ad.answers(spark, sf_dir).select("answer_id", "answer", "abstained", ref.alias("references"), F.lit(1).alias("first_bar"), F.lit(14).alias("last_bar"), F.array(F.lit("Some bars were imported and not checked yet.")).alias("caveats"), F.array(F.lit("kick"), F.lit("snare")).alias("seen_drums"))


@query
def tx7_grounded_sentences(spark, sf_dir):
    return tx.grounded_sentences(_answers(spark, sf_dir))


@query
def tx9_answer_summary(spark, sf_dir):
    a = _answers(spark, sf_dir)
    n = F.col("answer_id")
    spans = F.array(F.struct((n % 12 + 1).cast("int").alias("from_bar"), (n % 12 + 1).cast("int").alias("to_bar")))
    want = a.select("answer_id", spans.alias("must_reference"), F.lit(None).cast("array<struct<from_bar:int,to_bar:int>>").alias("must_not_reference"), F.array(F.lit("kick")).alias("must_mention"), F.array(F.lit("cowbell")).alias("must_not_mention"), (n % 10 == 0).alias("abstain"), (n % 2 == 0).alias("discloses"), (n % 2 == 1).alias("no_warning"), F.lit(None).cast("array<string>").alias("caveat_mentions"))
    return tx.answer_summary(tx.grade_answers(a, want))


@query
def tx14_check_answers(spark, sf_dir):
    return tx.check_answers(_answers(spark, sf_dir))


@query
def bx1_clamp_boxes(spark, sf_dir):
    return bx.clamp_boxes(ad.boxes(spark, sf_dir), ad.pages(spark, sf_dir))


@query
def bx1_validate_boxes(spark, sf_dir):
    return bx.validate_boxes(ad.boxes(spark, sf_dir), ad.pages(spark, sf_dir))


@query
def bx2_reading_order(spark, sf_dir):
    return bx.reading_order(ad.boxes(spark, sf_dir))


PRICES = {"click": (0.2, 1.2), "view": (0.1, 0.4), "purchase": (0.5, 2.0)}


@query
def st1_monthly_spend(spark, sf_dir):
    return st.monthly_spend(ad.usage(spark, sf_dir), PRICES, limit=1.0)


@query
def st2_rate_limit(spark, sf_dir):
    return st.rate_limit(ad.usage(spark, sf_dir), n=1)


@query
def st3_health(spark, sf_dir):
    return st.health(ad.usage(spark, sf_dir))


@query
def st4_progress(spark, sf_dir):
    t = ad.practice(spark, sf_dir)
    return st.stream_progress(t["attempts"], t["sessions"])[0].fillna(0, ["best_clean_bpm"])


@query
def st5_results(spark, sf_dir):
    u = ad.usage(spark, sf_dir)
    return st.stream_results(u.select(F.col("key").alias("item_id"), F.col("ts").alias("at"), F.when(~F.col("error"), F.col("request_id") % 2 == 0).alias("exact"), "request_id"))
