"""Practice analytics (PR1-PR13).

students(student_id, display_name, level, guardian_consent, cloud_help), sessions(session_id, student_id,
score_id, started_at, ended_at, minutes, from_bar, to_bar, target_bpm, self_rating), attempts(session_id, at,
bpm, clean), assignments(assignment_id, student_id, score_id, title, from_bar, to_bar, target_bpm, due_date,
status, completed_at, created_at), resets(student_id, score_id, reset_at).
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwise.sources import tables

RANGE = ["student_id", "score_id", "from_bar", "to_bar"]
# Weights of the difficulty.
WEIGHTS = {"unclean": 0.40, "tempo_gap": 0.35, "rating": 0.25}


def validate_practice(t: dict[str, DataFrame]) -> DataFrame:
    """PR1: (table, id, problem) of rows that break a rule."""
    bad = lambda c: F.coalesce(~c, F.lit(True))
    rules = {
        "students": ("student_id", {"level is unknown": F.col("level").isin("beginner", "intermediate", "advanced"), "name is empty or too long": F.length("display_name").between(1, 120), "cloud help needs a guardian's consent": ~F.col("cloud_help") | F.col("guardian_consent")}),
        "sessions": ("session_id", {"bar range is not ordered": (F.col("from_bar") >= 1) & (F.col("to_bar") >= F.col("from_bar")), "target tempo is not 1-400": F.col("target_bpm").between(1, 400), "rating is not 1-5": F.col("self_rating").isNull() | F.col("self_rating").between(1, 5), "minutes are negative": F.col("minutes").isNull() | (F.col("minutes") >= 0), "start is missing": F.col("started_at").isNotNull()}),
        "attempts": ("session_id", {"tempo is not 1-400": F.col("bpm").between(1, 400), "time is missing": F.col("at").isNotNull()}),
        "assignments": ("assignment_id", {"status is unknown": F.col("status").isin("assigned", "done"), "title is empty or too long": F.length("title").between(1, 200), "bar range is not ordered": (F.col("from_bar") >= 1) & (F.col("to_bar") >= F.col("from_bar"))}),
    }
    return reduce(DataFrame.unionByName, [t[name].select(F.lit(name).alias("table"), F.col(key).cast("string").alias("id"), F.explode(F.array_compact(F.array(*[F.when(bad(rule), text) for text, rule in checks.items()]))).alias("problem")) for name, (key, checks) in rules.items()])


def late_attempts(attempts: DataFrame, sessions: DataFrame) -> DataFrame:
    """PR2: attempts before their session began or after it ended."""
    s = sessions.select("session_id", "started_at", "ended_at")
    why = F.when(F.col("at") < F.col("started_at"), "before the session").when(F.col("at") > F.col("ended_at"), "after the session")
    return attempts.join(s, "session_id").withColumn("problem", why).where("problem is not null").drop("started_at", "ended_at")


def orphans(t: dict[str, DataFrame]) -> DataFrame:
    """PR3: rows whose student or session does not exist, counted by table."""
    s, q = t["students"].select("student_id"), t["sessions"].select("session_id")
    found = [t[n].join(s, "student_id", "left_anti").select(F.lit(n).alias("table")) for n in ("sessions", "assignments", "resets")] + [t["attempts"].join(q, "session_id", "left_anti").select(F.lit("attempts").alias("table"))]
    return reduce(DataFrame.unionByName, found).groupBy("table").agg(F.count(F.lit(1)).alias("n"))


def delete_students(t: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """PR3: the tables without these students and all that is theirs."""
    gone = ids.select("student_id")
    ended = t["sessions"].join(gone, "student_id", "left_semi").select("session_id")
    return {n: df.join(ended, "session_id", "left_anti") if n == "attempts" else df.join(gone, "student_id", "left_anti") for n, df in t.items()}


_STORED = ("students", "sessions", "attempts", "assignments", "resets")


def store_practice(t: dict[str, DataFrame], path: str, buckets: int = tables.BUCKETS) -> None:
    """PR3, PR6: the tables under path, in buckets of the student (their number is given again with each change); an attempt has its session's student."""
    own = t["attempts"].join(t["sessions"].select("session_id", "student_id"), "session_id")
    for name in _STORED:
        tables.create(own if name == "attempts" else t[name], f"{path}/{name}", "student_id", buckets)


def stored_practice(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: tables.read(spark, f"{path}/{name}", "student_id") for name in _STORED}


def delete_stored(spark: SparkSession, path: str, ids: DataFrame, buckets: int = tables.BUCKETS) -> None:
    """PR3: delete students and all that is theirs from the stored tables: what hangs on a student goes before the student."""
    for name in reversed(_STORED):
        tables.delete(spark, f"{path}/{name}", ids, "student_id", buckets)


def reset_stored(spark: SparkSession, path: str, new: DataFrame, buckets: int = tables.BUCKETS) -> None:
    """PR6: put difficulty resets into the stored table; the latest of each student and score stays."""
    tables.upsert(spark, f"{path}/resets", new, "student_id", ["student_id", "score_id"], "reset_at", buckets)


def session_summary(t: dict[str, DataFrame], since: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """PR4: (by student: sessions, minutes, attempts, assignments done; by range: attempts and best clean tempo)."""
    s = t["sessions"] if since is None else t["sessions"].where(F.col("started_at") >= F.lit(since))
    # Attempts are summed by session first, so that sessions meet one row each.
    tried = t["attempts"].groupBy("session_id").agg(F.count(F.lit(1)).alias("attempts"), F.max(F.when(F.col("clean"), F.col("bpm"))).alias("best"))
    joined = s.join(tried, "session_id", "left")
    ranges = joined.groupBy(*RANGE).agg(F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.max("best").alias("best_clean_bpm"))
    done = t["assignments"].where("status = 'done'")
    done = done if since is None else done.where(F.col("completed_at") >= F.lit(since))
    per = joined.groupBy("student_id").agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("minutes"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"))
    counted = t["students"].select("student_id").join(per, "student_id", "left").join(done.groupBy("student_id").agg(F.count(F.lit(1)).alias("completed_assignments")), "student_id", "left")
    return counted.fillna(0, ["sessions", "minutes", "attempts", "completed_assignments"]), ranges


def list_assignments(assignments: DataFrame) -> DataFrame:
    """PR5: each student's assignments in order, those without a due date last."""
    return assignments.withColumn("place", F.row_number().over(Window.partitionBy("student_id").orderBy(F.asc_nulls_last("due_date"), "created_at", "assignment_id")))


def upsert_resets(resets: DataFrame, new: DataFrame) -> DataFrame:
    """PR6: the latest reset of each student and score."""
    return resets.unionByName(new).groupBy("student_id", "score_id").agg(F.max("reset_at").alias("reset_at"))


def _recency(at: Column, now: datetime) -> Column:
    micros = F.timestamp_diff("MICROSECOND", at.cast("timestamp_ntz"), F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz"))
    days = F.greatest(F.lit(0.0), micros / 86_400e6)
    return F.exp(-days / 30)


def personal_difficulty(t: dict[str, DataFrame], now: datetime) -> DataFrame:
    """PR7, PR8: difficulty of each range with three sessions and six attempts at least, and the reasons in words.

    Sessions and attempts before the student's last reset of the score do not count.
    """
    last = upsert_resets(t["resets"], t["resets"].limit(0))
    s = t["sessions"].join(last, ["student_id", "score_id"], "left").where("reset_at is null or started_at >= reset_at")
    w = _recency(F.col("started_at"), now)
    rated = F.col("self_rating").isNotNull()
    by_session = s.groupBy(*RANGE).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(rated).alias("rated"), F.sum(F.when(rated, w * (5 - F.col("self_rating")) / 4)).alias("hard"), F.sum(F.when(rated, w)).alias("rw"))
    a = t["attempts"].join(s.select("session_id", *RANGE, "target_bpm", "reset_at"), "session_id").where("reset_at is null or at >= reset_at").withColumn("w", _recency(F.col("at"), now))
    share = F.least(F.lit(1.0), F.col("bpm") / F.col("target_bpm"))
    by_attempt = a.groupBy(*RANGE).agg(F.count(F.lit(1)).alias("attempts"), F.sum("w").alias("w"), F.sum(F.when(~F.col("clean"), F.col("w")).otherwise(0.0)).alias("unclean_w"), F.max(F.when(F.col("clean"), share)).alias("best"))
    both = by_session.join(by_attempt, RANGE, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    enough = (F.col("sessions") >= 3) & (F.col("attempts") >= 6)
    full = both.withColumns({"enough": enough, "unclean": F.try_divide("unclean_w", "w"), "gap": 1 - F.coalesce("best", F.lit(0.0)), "rating": F.when(F.col("rated") > 0, F.try_divide("hard", "rw")).otherwise(0.5), "recent": F.try_divide("w", "attempts")})
    score = F.round(WEIGHTS["unclean"] * F.col("unclean") + WEIGHTS["tempo_gap"] * F.col("gap") + WEIGHTS["rating"] * F.col("rating"), 3)
    told = F.array_compact(F.array(
        F.when(F.col("unclean") >= 0.5, "At least half of the recent attempts were unclean.").when(F.col("unclean") > 0, "Some recorded attempts were unclean."),
        F.when(F.col("gap") > 0.2, "The best clean tempo is below the target."),
        F.when((F.col("rated") > 0) & (F.col("rating") >= 0.5), "Self-ratings say that this range often feels difficult."),
        F.when(F.col("recent") < 0.5, "Most of this practice is over a month old."),
    ))
    reasons = F.when(~enough, F.array(F.lit("Need at least 3 sessions and 6 attempts for this range."))).when(F.size(told) == 0, F.array(F.lit("Recent attempts were clean and close to the target."))).otherwise(told)
    return full.select(*RANGE, "sessions", "attempts", F.col("enough").alias("enough_data"), F.when(enough, score).alias("difficulty"), F.array_join(reasons, " ").alias("reasons"))


def progress_facts(t: dict[str, DataFrame], now: datetime, since: datetime | None = None) -> DataFrame:
    """PR9: (student_id, fact_id f1..fn, text, value) in a fixed order: totals, open assignments, ranges."""
    per, ranges = session_summary(t, since)
    totals = per.select("student_id", F.explode(F.array(*[F.struct(F.lit(1).alias("part"), F.lit("").alias("o1"), F.lit(i).alias("o2"), F.lit(text).alias("text"), F.col(c).cast("double").alias("value")) for i, (text, c) in enumerate((("Sessions practised", "sessions"), ("Attempts recorded", "attempts"), ("Minutes practised", "minutes"), ("Assignments completed", "completed_assignments")))])).alias("f"))
    title = lambda tail: F.concat(F.lit('Open assignment "'), "title", F.lit(f'" {tail}'))
    open_ = list_assignments(t["assignments"]).where("status = 'assigned'").select("student_id", F.explode(F.array(*[F.struct(F.lit(2).alias("part"), F.lpad(F.col("place").cast("string"), 9, "0").alias("o1"), F.lit(i).alias("o2"), title(x).alias("text"), F.col(c).cast("double").alias("value")) for i, (x, c) in enumerate((("starts at bar", "from_bar"), ("ends at bar", "to_bar"), ("target BPM", "target_bpm")))])).alias("f"))
    known = ranges.join(personal_difficulty(t, now).select(*RANGE, "difficulty"), RANGE, "left")
    key = F.concat_ws("/", F.col("score_id").cast("string"), F.lpad(F.col("from_bar").cast("string"), 6, "0"), F.lpad(F.col("to_bar").cast("string"), 6, "0"))
    name = lambda tail: F.concat(F.lit("Score "), F.col("score_id").cast("string"), F.lit(f" {tail}"))
    about = known.select("student_id", F.explode(F.array(*[F.struct(F.lit(3).alias("part"), key.alias("o1"), F.lit(i).alias("o2"), name(x).alias("text"), F.col(c).cast("double").alias("value")) for i, (x, c) in enumerate((("range starts at bar", "from_bar"), ("range ends at bar", "to_bar"), ("range attempts", "attempts"), ("best clean BPM", "best_clean_bpm"), ("difficulty", "difficulty")))])).alias("f")).where("f.value is not null")
    rows = totals.unionByName(open_).unionByName(about).select("student_id", "f.*")
    n = F.row_number().over(Window.partitionBy("student_id").orderBy("part", "o1", "o2"))
    return rows.select("student_id", n.alias("n"), F.concat(F.lit("f"), n.cast("string")).alias("fact_id"), "text", "value")


def export_student(t: dict[str, DataFrame], student_id) -> DataFrame:
    """PR10: (table, row as JSON) of all rows of one student."""
    own = {n: df.where(F.col("student_id") == student_id) for n, df in t.items() if n != "attempts"}
    own["attempts"] = t["attempts"].join(own["sessions"].select("session_id"), "session_id", "left_semi")
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("table"), F.to_json(F.struct("*")).alias("row")) for n, df in own.items()])


def _quoted(text: Column) -> Column:
    """Text as a pattern that matches it literally."""
    return F.regexp_replace(text, r"([^A-Za-z0-9\s])", r"\\$1")


def pseudonymise(facts: DataFrame, students: DataFrame, assignments: DataFrame) -> DataFrame:
    """PR11: facts without names: titles become assignment n, scores become score A, the student's name, in any case, becomes the student.

    Open assignments of one title are one: the number of the last of them, as they are listed. A fact's
    title is what stands between its first quotation mark and the words after the last one.
    """
    listed = list_assignments(assignments).where("status = 'assigned'").withColumn("k", F.row_number().over(Window.partitionBy("student_id").orderBy("place")))
    titles = listed.groupBy("student_id", F.col("title").alias("old")).agg(F.concat(F.lit("assignment "), F.max("k").cast("string")).alias("new"))
    named = facts.withColumns({"old": F.regexp_extract("text", '^Open assignment "(.*)" [^"]*$', 1), "tail": F.regexp_extract("text", '^Open assignment ".*"( [^"]*)$', 1), "score": F.regexp_extract("text", r"^Score (\S+) ", 1)})
    rank = F.dense_rank().over(Window.partitionBy("student_id").orderBy("score"))
    scores = named.where("score <> ''").select("student_id", "score").distinct().withColumn("letter", F.char(65 + (rank - 1) % 26))
    rows = named.join(titles, ["student_id", "old"], "left").join(scores, ["student_id", "score"], "left").join(students.select("student_id", "display_name"), "student_id")
    text = F.when(F.col("new").isNotNull(), F.concat(F.lit("Open assignment "), "new", "tail")).when(F.col("letter").isNotNull(), F.concat(F.lit("score "), "letter", F.substring(F.col("text"), F.length("score") + 7, F.length("text")))).otherwise(F.col("text"))
    clean = F.when(F.trim("display_name") == "", text).otherwise(F.regexp_replace(text, F.concat(F.lit("(?iu)"), _quoted(F.trim("display_name"))), F.lit("the student")))
    return rows.select("student_id", "n", "fact_id", F.coalesce(clean, text).alias("text"), "value")


def offline_summary(t: dict[str, DataFrame], since: datetime | None = None) -> DataFrame:
    """PR12: a plain-text summary of each student."""
    per, ranges = session_summary(t, since)
    s = lambda c: F.col(c).cast("long").cast("string")
    line = F.concat(F.lit("Score "), F.col("score_id").cast("string"), F.lit(", bars "), s("from_bar"), F.lit("-"), s("to_bar"), F.lit(": "), F.coalesce(F.concat(s("best_clean_bpm"), F.lit(" BPM best clean tempo")), F.lit("no clean BPM recorded")), F.lit(" across "), s("attempts"), F.lit(" attempts."))
    lines = ranges.groupBy("student_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("score_id", "from_bar", "to_bar", line.alias("line"))))["line"], " ").alias("lines"))
    head = F.concat("display_name", F.lit(" practised "), s("minutes"), F.lit(" minutes across "), s("sessions"), F.lit(" sessions and made "), s("attempts"), F.lit(" attempts. "), s("completed_assignments"), F.lit(" assignments were completed."))
    return per.join(t["students"].select("student_id", "display_name"), "student_id").join(lines, "student_id", "left").select("student_id", F.concat_ws(" ", head, "lines").alias("summary"))


def cloud_allowed(students: DataFrame) -> DataFrame:
    """PR13: students whose rows may leave: a guardian consented and asked for it."""
    return students.where(F.col("guardian_consent") & F.col("cloud_help"))
