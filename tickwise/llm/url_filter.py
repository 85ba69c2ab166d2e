"""URL filter: host and path rules, and the ratio of two character language models for the rest.

Both models are variable-order Markov models over the characters of host and path, with Witten-Bell
smoothing down to single characters: one of URLs that a rule accepts, one of URLs that a rule rejects.
A URL's score is the difference of its log-likelihoods divided by its length. Three sixteenths of the
labelled URLs, by a hash, are left out of the counts and calibrate the threshold: it is where both
classes of them are equally many standard deviations away.

DataFrame functions only. Counts are kept for the longest order; each shorter order is summed from the
next longer one, and smoothed probabilities are joined upwards, so URLs themselves are exploded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 5  # characters of the longest gram, the predicted one included
START, END = "\u0002", "\u0003"
ALPHABET = 256  # outcomes of the uniform distribution below single characters


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0)) if isinstance(url, str) else F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule(action, host, path) that fits; null where none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, f"{rule_host}{rule_path}").otherwise(rule)
        action = F.when(fits, act).otherwise(action)
    return rule, action


def _ratios(grams: DataFrame) -> DataFrame:
    """grams(gram, a, r: counts in accepted and rejected) -> (gram, ratio): log p_accepted - log p_rejected."""
    longest = cut(grams.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    # All further tables have fewer rows than this one: a partition for each half million of them is enough.
    parts = max(1, -(-longest.count() // 500_000))
    counts = {ORDER: longest.coalesce(parts)}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = counts[k + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")).coalesce(parts)
    lower = None
    for k in range(1, ORDER + 1):
        # A context's total and its number of different next characters, in each class.
        own = counts[k].withColumn("ctx", F.expr(f"substring(gram, 1, {k - 1})"))
        context = own.groupBy("ctx").agg(*[f(c).alias(f"{p}{c}") for c in "ar" for p, f in (("n", F.sum), ("t", lambda c: F.sum((F.col(c) > 0).cast("long"))))]).coalesce(parts)
        own = own.join(context, "ctx").coalesce(parts)
        if lower is None:
            own = own.withColumn("la", F.lit(1 / ALPHABET)).withColumn("lr", F.lit(1 / ALPHABET))
        else:
            own = own.withColumn("short", F.expr("substring(gram, 2)")).join(lower, "short").coalesce(parts)
        # Never seen context: what the shorter one says.
        p = {c: F.when(F.col(f"n{c}") == 0, F.col(f"l{c}")).otherwise((F.col(c) + F.col(f"t{c}") * F.col(f"l{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))) for c in "ar"}
        lower = own.select(F.col("gram").alias("short"), p["a"].alias("la"), p["r"].alias("lr"))
    lower = cut(lower)
    return lower.select(F.col("short").alias("gram"), (F.log("la") - F.log("lr")).alias("ratio"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, url: str = "url") -> DataFrame:
    """pages(url, ...) -> the same columns plus host, path, rule, verdict (allow or block) and score.

    rules are (action, host, path): a rule fits its host and all subdomains where the path starts with
    the rule's, and the longest that fits decides. Where none does, verdict is allow if the models'
    score reaches the threshold. An empty host and path are no evidence: allow, score null. Without
    calibrating URLs of both classes the threshold is 0; a class without URLs is uniform. Every input
    row gives one row; input columns with these names are replaced.
    """
    pages = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")])
    # Names of the columns in between, none of which the input has.
    mark = "_"
    while any(c.lower().startswith(mark) for c in pages.columns):
        mark += "_"
    txt, act, h1, h2 = (f"{mark}{n}" for n in ("txt", "act", "h1", "h2"))
    host, path = url_parts(F.col(url))
    judged = pages.withColumns({"host": host, "path": path})
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, act: action, txt: F.concat("host", "path")})

    texts = judged.where(F.col(txt) != "").groupBy(F.col(txt).alias("_txt")).agg(F.count_if(F.col(act) == "allow").alias("a"), F.count_if(F.col(act) == "block").alias("r"), F.substring(F.md5(txt), 1, 1).isin("0", "1", "2").alias("out"))
    padded = F.concat(F.lit(START * (ORDER - 1)), "_txt", F.lit(END))
    each = texts.select(F.xxhash64("_txt").alias("h1"), F.xxhash64(F.lit(1), "_txt").alias("h2"), "a", "r", "out", F.explode(F.transform(F.sequence(F.lit(1), F.length("_txt") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("gram"))
    learned = lambda c: F.when(F.col("out"), 0).otherwise(F.col(c)).cast("long").alias(c)
    ratios = _ratios(each.select("gram", learned("a"), learned("r")))
    scored = cut(each.select("h1", "h2", "a", "r", "out", "gram").join(ratios, "gram").groupBy("h1", "h2").agg(F.round(F.avg("ratio"), 9).alias("score"), F.first("a").alias("a"), F.first("r").alias("r"), F.first("out").alias("out")))

    def weighted(c: str) -> list[Column]:
        w = F.col(c)
        mean = F.try_divide(F.sum(w * F.col("score")), F.sum(w))
        square = F.try_divide(F.sum(w * F.col("score") * F.col("score")), F.sum(w))
        return [mean.alias(f"m{c}"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias(f"s{c}")]

    got = scored.where("out").agg(*weighted("a"), *weighted("r")).first()
    threshold = 0.0
    if got.ma is not None and got.mr is not None:
        spread = got.sa + got.sr
        threshold = round((got.ma * got.sr + got.mr * got.sa) / spread, 6) if spread > 0 else round((got.ma + got.mr) / 2, 6)
    with_score = judged.withColumns({h1: F.xxhash64(txt), h2: F.xxhash64(F.lit(1), txt)}).join(scored.select(F.col("h1").alias(h1), F.col("h2").alias(h2), "score"), [h1, h2], "left")
    verdict = F.coalesce(act, F.when(F.coalesce(F.col("score"), F.lit(threshold)) >= threshold, "allow").otherwise("block"))
    return with_score.withColumn("verdict", verdict).select(*pages.columns, "host", "path", "rule", "verdict", "score")
