"""Registered queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.operators import analytics as an
from tickwise.operators import scores as sc
from tickwise.plans import adapters as ad
from tickwise.plans import registry_checks, registry_intake, registry_more, sql_more

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest bars of each score, and how many bars of it play the same pattern."""
    e = ad.events(spark, sf_dir)
    busy = an.complexity(e, ad.scores(spark, sf_dir)).where("rank <= 3")
    same = an.exact_repeats(e).select("score_id", "n_bars", F.explode(F.transform(F.split("bars", ","), lambda b: b.cast("int"))).alias("bar_number"))
    sounding = F.when(F.col("subdivision_density") > 0, 1).otherwise(0)
    return busy.join(same, ["score_id", "bar_number"], "left").select("score_id", "bar_number", "score", "rank", F.coalesce("n_bars", sounding).alias("copies"))


def _of_events(name: str, fn: Callable[[DataFrame], DataFrame], nested: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn((ad.nested_events if nested else ad.events)(spark, sf_dir))




@query
def sc2_score_events(spark, sf_dir):
    return sc.score_events(ad.score_documents(spark, sf_dir)).drop("dotted", "bar_id", "event_id").withColumn("drums", F.array_join("drums", "+"))


@query
def sc5_validate_scores(spark, sf_dir):
    return sc.validate_scores(ad.faulty_documents(spark, sf_dir))


_of_events("sc3_bar_fill", sc.bar_fill)
_of_events("sc4_triplet_groups", lambda e: sc.bar_rows(e).select("score_id", "bar_number", "triplet_groups"))
_of_events("sc6_validate_events", lambda e: sc.validate_events(e).drop("event_idx"))
_of_events("sc8_score_hash", sc.score_hash)
_of_events("sc10_describe_bars", sc.describe_bars)
_of_events("an2_counting", an.counting)
_of_events("an4_inspect_bars", an.inspect_bars)
_of_events("an6_exact_repeats", an.exact_repeats)
_of_events("an7_near_repeats", an.near_repeats, nested=True)
_of_events("an8_corpus_patterns", an.corpus_patterns)
_of_events("an8_corpus_near_patterns", lambda e: an.corpus_near_patterns(e), nested=True)
_of_events("an9_fill_candidates", lambda e: an.fill_candidates(e).drop("reasons"))


@query
def sc7_slice_bars(spark, sf_dir):
    return sc.slice_bars(ad.events(spark, sf_dir), ad.requests(spark, sf_dir)).select("request_id", "score_id", "bar_number", "event_idx", "truncated")


@query
def sc9_review_summary(spark, sf_dir):
    return sc.review_summary(ad.bars(spark, sf_dir))


@query
def sc9_next_unreviewed(spark, sf_dir):
    return sc.next_unreviewed(ad.bars(spark, sf_dir), ad.requests(spark, sf_dir).select("score_id", "from_bar"))


@query
def an3_overview(spark, sf_dir):
    return an.overview(ad.events(spark, sf_dir), ad.scores(spark, sf_dir))


@query
def an5_compare_passages(spark, sf_dir):
    e = ad.events(spark, sf_dir)
    pairs = e.select("score_id", F.col("bar_number").alias("bar_a"), (F.col("bar_number") + 2).alias("bar_b")).distinct()
    return an.compare_passages(e, pairs).drop("added", "removed")


@query
def an10_complexity(spark, sf_dir):
    return an.complexity(ad.events(spark, sf_dir), ad.scores(spark, sf_dir)).drop("reasons")


@query
def an11_complex_passages(spark, sf_dir):
    return an.complex_passages(an.complexity(ad.events(spark, sf_dir), ad.scores(spark, sf_dir)))


@query
def an12_reasons(spark, sf_dir):
    e = ad.nested_events(spark, sf_dir)
    fills = an.fill_candidates(e).select("score_id", "bar_number", F.lit("fill").alias("kind"), "reasons")
    return fills.unionByName(an.complexity(e, ad.scores(spark, sf_dir)).select("score_id", "bar_number", F.lit("complexity").alias("kind"), "reasons"))


@query
def an13_practice_plan(spark, sf_dir):
    return an.practice_plan(ad.events(spark, sf_dir), ad.scores(spark, sf_dir), ad.requests(spark, sf_dir)).drop("instruction").withColumn("bpm", F.coalesce("bpm", F.lit(0)))


@query
def an14_insights(spark, sf_dir):
    return an.insights(ad.nested_events(spark, sf_dir), ad.scores(spark, sf_dir), ad.bars(spark, sf_dir))


@query
def an15_resolve_citations(spark, sf_dir):
    k = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    cited = k.select(F.col("k").alias("citation_id"), F.floor(F.col("k") / 50).alias("score_id"), (F.col("k") % 5).cast("int").alias("revision"), F.concat(F.lit("b"), F.col("k").cast("string")).alias("from_bar_id"), F.concat(F.lit("b"), (F.col("k") + 1).cast("string")).alias("to_bar_id"))
    return an.resolve_citations(cited, ad.scores(spark, sf_dir), ad.bars(spark, sf_dir)).fillna(0, ["from_bar", "to_bar"])


@query
def an16_bar_ranges(spark, sf_dir):
    return an.bar_ranges(ad.bars(spark, sf_dir), ["score_id"])


@query
def an17_offline_answers(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("explain-bar", "count-bar", "practice-plan", "find-complex", "find-repeats", "overview")])
    asked = ad.requests(spark, sf_dir).withColumn("question", F.explode(kinds)).withColumn("request_id", F.concat(F.col("request_id").cast("string"), F.lit("/"), "question"))
    return an.offline_answers(ad.nested_events(spark, sf_dir), ad.scores(spark, sf_dir), asked)


def queries() -> dict[str, Query]:
    return QUERIES | registry_more.QUERIES | registry_checks.QUERIES | registry_intake.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (sql_more.SQL | registry_checks.SQL | registry_intake.SQL).items() if k in queries()}
