"""Queries on what is read and kept: JSON texts made from the driver's tables, some of whose values have other types
than their fields allow, tables kept in buckets, appended results and written subsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.functions.notation import DRUMS, DURATIONS
from tickwise.operators import manifest as mf
from tickwise.operators import practice as pr
from tickwise.operators import subset as ts
from tickwise.plans import adapters as ad
from tickwise.plans.sql_more import LABELS, PACKAGING
from tickwise.sources import intake, io, scratch

QUERIES, SQL = {}, {}
BUCKETS = 8

# One text a rule, for both engines: (condition, JSON text); the last has none.
_EIGHTHS = ("0", "125", "25", "375", "5", "625", "75", "875")
_DURATIONS = (*DURATIONS, "sixty_fourth", "quintuplet_eighth")
_NAMES = (*DRUMS, "cowbell", "midi99", "snare_ghost", "kick_ghost")


def _first(rules):
    """CASE of the rules as SQL that both engines read."""
    return "CASE " + " ".join(f"WHEN {c} THEN {t}" for c, t in rules[:-1]) + f" ELSE {rules[-1]} END"


def _text(array: str) -> str:
    """The JSON text of one bar as SQL, given how the engine writes a pick from a list (array) of texts."""
    n, ln = "l_partkey", "l_linenumber"
    slot = f"(({n} + 4 * {ln}) % 36)"
    at = lambda values, i: array.format(values=", ".join(f"'{v}'" for v in values), i=f"({i})")
    number = f"concat(cast(floor({slot} / 8) + 1 as int), '.', {at(_EIGHTHS, f'{slot} % 8')})"
    quoted = f"concat('\"', {number}, '\"')"
    beat = _first([(f"{n} % 23 = 7", "'true'"), (f"{n} % 29 = 3", "'null'"), (f"{n} % 53 = 4", "'\"soon\"'"), (f"{n} % 5 = 1", number), quoted])
    duration = _first([(f"{n} % 41 = 6", "'8'"), f"concat('\"', {at(_DURATIONS, 'cast(l_quantity as int) % 12')}, '\"')"])
    drums = _first([(f"{n} % 31 = 4", "'[5]'"), (f"{n} % 31 = 9", "'\"kick\"'"), (f"{n} % 31 = 14", "'[null]'"), (f"{n} % 37 = 2", "'[]'"), (f"{n} % 59 = 8", "'null'"), f"concat('[\"', {at(_NAMES, f'{n} % {len(_NAMES)}')}, '\"]')"])
    flam = _first([(f"{n} % 19 = 3", "', \"flam\": 1'"), (f"{n} % 19 = 5", "', \"flam\": \"\"'"), (f"{n} % 19 = 8", "', \"flam\": \"no\"'"), (f"{n} % 19 = 11", "', \"flam\": []'"), (f"{n} % 19 = 12", "', \"flam\": true'"), "''"])
    rest = _first([(f"{ln} % 6 = 5", "', \"rest\": true'"), (f"{n} % 17 = 1", "', \"rest\": {}'"), "''"])
    return _first([(f"{n} % 47 = 5", "'\"kick\"'"), (f"{n} % 47 = 6", "'[]'"), f"concat('{{\"beat\": ', {beat}, ', \"duration\": ', {duration}, ', \"drums\": ', {drums}, {flam}, {rest}, '}}')"])


def _bar_text(array: str) -> str:
    at = lambda values, i: array.format(values=", ".join(f"'{v}'" for v in values), i=f"({i})")
    song = _first([("k % 43 = 1", "'\"\"'"), ("k % 43 = 2", "'5'"), "concat('\"song', cast(floor(k / 50) as int), '\"')"])
    bar = _first([("k % 44 = 3", "'\"7\"'"), ("k % 44 = 5", "'0'"), ("k % 44 = 6", "'2.5'"), "cast(k % 50 + 1 as varchar(20))"])
    meter = at(('"4/4"', '"4/4"', '"3/4"', '"7/4"', '"6/8"', '"x"', "4", "null"), "k % 8")
    beats = _first([("k % 45 = 7", "'{}'"), ("k % 45 = 8", "'null'"), "concat('[', events, ']')"])
    simile = _first([("k % 20 = 0", "', \"simile\": true'"), ("k % 20 = 1", "', \"simile\": 0'"), ("k % 20 = 2", "', \"simile\": \"yes\"'"), "''"])
    return f"concat('{{\"song\": ', {song}, ', \"bar\": ', {bar}, ', \"time_signature\": ', {meter}, ', \"beats\": ', {beats}, {simile}, {_first([('k % 46 = 9', chr(39) * 2), chr(39) + '}' + chr(39)])})"


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, raw): one JSON text a bar, a bar an order."""
    spark_array = "element_at(array({values}), cast({i} as int) + 1)"
    li = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.expr(_text(spark_array)).alias("e"))
    bars = li.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "e")))["e"], ", ").alias("events"))
    return bars.select("k", F.expr(_bar_text(spark_array)).alias("raw"))


_DUCK_ARRAY = "[{values}][cast({i} as int) + 1]"
RAW = f"raw AS (SELECT k, {_bar_text(_DUCK_ARRAY)} AS raw FROM (SELECT l_orderkey AS k, string_agg({_text(_DUCK_ARRAY)}, ', ' ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS events FROM lineitem GROUP BY 1))"
_TRUE = "CASE WHEN json_type({j}) = 'BOOLEAN' THEN CAST({j} AS VARCHAR) = 'true' WHEN json_type({j}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST({j} AS DOUBLE) <> 0 WHEN json_type({j}) = 'VARCHAR' THEN ({j} ->> '$') <> '' WHEN json_type({j}) = 'ARRAY' THEN json_array_length({j}) > 0 WHEN json_type({j}) = 'OBJECT' THEN len(json_keys({j})) > 0 ELSE false END"
_KNOWN = ", ".join(f"'{d}'" for d in DRUMS)
_LENGTHS = ", ".join(f"'{d}'" for d in DURATIONS)
SQL["io1_read_labels"] = f"""
WITH {RAW},
v AS (SELECT k, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM raw),
h AS (SELECT k, j, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'not an object' WHEN coalesce(json_type(j, '$.song'), '') <> 'VARCHAR' OR (j ->> '$.song') = '' THEN 'no song' WHEN NOT (coalesce(json_type(j, '$.bar'), '') IN ('UBIGINT', 'BIGINT') AND CAST(j -> '$.bar' AS BIGINT) >= 1) THEN 'no bar number' END AS problem FROM v),
b AS (SELECT k, j, json_type(j, '$.beats') = 'ARRAY' AS listed, {_TRUE.format(j="(j -> '$.simile')")} AS simile, CASE WHEN json_type(j, '$.time_signature') = 'VARCHAR' THEN string_split(j ->> '$.time_signature', '/') END AS m FROM h WHERE problem IS NULL),
t AS (SELECT *, len(m) = 2 AND coalesce(TRY_CAST(m[1] AS INT) * TRY_CAST(m[2] AS INT) > 0, false) AS good FROM b),
e AS (SELECT k, unnest(range(CAST(json_array_length(j, '$.beats') AS BIGINT))) AS i, unnest(CAST(j -> '$.beats' AS JSON[])) AS e FROM t WHERE listed),
o AS (SELECT k, i, json_type(e) = 'OBJECT' AS is_event, e -> '$.drums' AS d, {_TRUE.format(j="(e -> '$.rest')")} AS rest, {_TRUE.format(j="(e -> '$.flam')")} AS flam, CASE WHEN json_type(e, '$.duration') = 'VARCHAR' THEN e ->> '$.duration' END AS duration, CASE WHEN json_type(e, '$.beat') = 'BOOLEAN' THEN CASE WHEN (e ->> '$.beat') = 'true' THEN 1.0 ELSE 0.0 END ELSE TRY_CAST(e ->> '$.beat' AS DOUBLE) END AS beat FROM e),
q AS (SELECT *, is_event AND coalesce(json_type(d), '') = 'ARRAY' AND len([x FOR x IN CAST(CASE WHEN json_type(d) = 'ARRAY' THEN d ELSE '[]' END AS JSON[]) IF coalesce(json_type(x), 'NULL') <> 'VARCHAR']) = 0 AS usable FROM o),
w AS (SELECT *, CASE WHEN usable THEN [x ->> '$' FOR x IN CAST(d AS JSON[])] END AS names, usable AND NOT rest AS hit FROM q),
f AS (
  SELECT k, 'invalid_event' AS reason FROM w WHERE NOT is_event
  UNION SELECT k, 'invalid_drums' FROM w WHERE is_event AND NOT usable
  UNION SELECT k, 'rest_with_drums' FROM w WHERE usable AND rest AND len(names) > 0
  UNION SELECT k, 'empty_hit' FROM w WHERE hit AND len(names) = 0
  UNION SELECT k, 'unsupported_drum' FROM w WHERE hit AND len([x FOR x IN names IF regexp_replace(x, '_ghost$', '') NOT IN ({_KNOWN})]) > 0
  UNION SELECT k, 'unsupported_duration' FROM w WHERE hit AND coalesce(duration, '') NOT IN ({_LENGTHS})
  UNION SELECT k, 'unsupported_flam' FROM w WHERE hit AND flam
  UNION SELECT k, 'invalid_beat' FROM w WHERE hit AND beat IS NULL
  UNION SELECT k, 'beat_outside_grid' FROM w WHERE hit AND (beat < 1 OR beat > 4.875)
  UNION SELECT k, 'beat_off_grid' FROM w WHERE hit AND beat BETWEEN 1 AND 4.875 AND beat * 8 <> floor(beat * 8)
  UNION SELECT k, 'duplicate_onset' FROM w WHERE hit AND beat IS NOT NULL GROUP BY k, beat HAVING count(*) > 1
  UNION SELECT k, 'invalid_beats' FROM t WHERE NOT coalesce(listed, false)
  UNION SELECT k, 'invalid_time_signature' FROM t WHERE listed AND NOT coalesce(good, false)
  UNION SELECT k, 'measure_beyond_grid' FROM t WHERE listed AND good AND TRY_CAST(m[1] AS INT) > TRY_CAST(m[2] AS INT)
  UNION SELECT k, 'context_dependent_simile' FROM t WHERE listed AND simile),
r AS (SELECT k, string_agg(reason, ';' ORDER BY reason) AS reasons FROM f GROUP BY k)
SELECT h.k, coalesce(h.problem, '') AS problem, CASE WHEN h.problem IS NULL THEN h.j ->> '$.song' ELSE '' END AS song, CASE WHEN h.problem IS NULL THEN CAST(h.j -> '$.bar' AS INT) ELSE 0 END AS bar, coalesce(r.reasons, '') AS reasons FROM h LEFT JOIN r USING (k)
"""


def io1_read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar's text: its problem, or the reasons that keep it out of training."""
    good, bad = intake.parse_labels(raw_labels(spark, sf_dir))
    kept = ts.label_issues(good).select("k", F.lit("").alias("problem"), "song", "bar", F.array_join("reasons", ";").alias("reasons"))
    return kept.unionByName(bad.select("k", "problem", F.lit("").alias("song"), F.lit(0).alias("bar"), F.lit("").alias("reasons")))


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, raw): saved scores with faults of type, field and value by the score's number, and scores without a version."""
    d = ad.faulty_documents(spark, sf_dir).select("*", F.regexp_extract("title", r"(\d+)", 1).cast("long").alias("n"))
    n = F.col("n")
    note = lambda x: F.struct(F.when(n % 17 != 3, x["event_id"]).alias("eventId"), x["duration"].alias("duration"), x["dotted"].alias("dotted"), F.when(x["triplet"], True).alias("triplet"), x["drums"].alias("drums"))
    bar = lambda b: F.struct(F.when(n % 17 != 3, b["bar_id"]).alias("barId"), F.when(n % 17 != 3, F.struct(b["provenance"]["source"].alias("source"), b["provenance"]["reviewed"].alias("reviewed"), F.when(n % 19 != 4, F.array().cast("array<string>")).alias("warnings"))).alias("provenance"), F.transform(b["notes"], note).alias("notes"))
    versioned = F.struct(F.lit(1).alias("schemaVersion"), F.col("score_id").alias("scoreId"), "revision", "title", F.col("tempo_bpm").alias("tempoBpm"), F.struct(F.col("meter.beats").alias("beats"), F.col("meter.beat_unit").alias("beatUnit")).alias("meter"), F.transform("bars", bar).alias("bars"))
    plain = F.to_json(versioned)
    without = F.to_json(F.struct(F.transform("bars", bar).alias("bars")))
    raw = F.when(n % 17 == 3, without).otherwise(plain)
    faults = {5: ('"schemaVersion":1', '"schemaVersion":2'), 6: ('"schemaVersion":1', '"schemaVersion":"1"'), 7: ('"revision":', '"extra":{"a":[1]},"revision":'), 8: ('"tempoBpm":', '"tempoBpm":"fast","was":'), 9: ('"dotted":false', '"dotted":0'), 10: (r'"drums":\["', '"drums":[7,"'), 11: (r'"notes":\[', '"notes":[null,'), 12: (r'"bars":\[', '"bars":["bar",'), 13: ('"reviewed":true', '"reviewed":"yes","model":5'), 14: ('"bars":', '"was":'), 15: (r"\}$", "")}
    old, new = (F.coalesce(*[F.when(n % 17 == at, x[i]) for at, x in faults.items()], F.lit(("(?!)", "")[i])) for i in (0, 1))
    raw = F.regexp_replace(raw, old, new)
    return d.select(F.concat(F.lit("score-"), n.cast("string")).alias("path"), raw.alias("raw"))


def io3_read_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every saved score: (path, code, place, problem) of those refused, and a row with the number of bars of each that was read."""
    rows = intake.checked_scores(raw_scores(spark, sf_dir))
    # Both kinds of rows come from one pass, as opening the texts is what takes the time.
    read = F.array(F.struct(F.concat(F.size("bars").cast("string"), F.lit(" bars")).alias("place"), F.concat_ws(" ", F.lit("score"), F.col("title"), F.col("tempo_bpm").cast("string")).alias("problem")))
    valid = F.size("_found") == 0
    code = F.when(valid, "read").otherwise(F.coalesce("_code", F.lit("invalid")))
    return rows.select("path", code.alias("code"), F.explode(F.when(valid, read).otherwise(F.col("_found"))).alias("x")).select("path", "code", "x.place", "x.problem")


def _practice(spark: SparkSession, sf_dir: str) -> str:
    """The practice tables, stored anew."""
    path = scratch.new_folder(spark, "practice")
    pr.store_practice(ad.practice(spark, sf_dir), path, BUCKETS)
    return path


def pr3_delete_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth student is deleted, twice; what is left of each student's rows in each table."""
    path = _practice(spark, sf_dir)
    gone = ad.table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("student_id"))
    for _ in range(2):
        pr.delete_stored(spark, path, gone, BUCKETS)
    kept = [df.select(F.lit(name).alias("table"), "student_id") for name, df in pr.stored_practice(spark, path).items()]
    return reduce(DataFrame.unionByName, kept).groupBy("table", "student_id").agg(F.count(F.lit(1)).alias("n"))


SQL["pr3_delete_students"] = """
SELECT 'students' AS "table", c_custkey AS student_id, count(*) AS n FROM customer WHERE c_custkey % 5 <> 0 GROUP BY ALL
UNION ALL SELECT 'sessions', o_custkey, count(*) FROM orders WHERE o_custkey % 5 <> 0 GROUP BY ALL
UNION ALL SELECT 'assignments', o_custkey, count(*) FROM orders WHERE o_custkey % 5 <> 0 GROUP BY ALL
UNION ALL SELECT 'attempts', o_custkey, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 5 <> 0 GROUP BY ALL
UNION ALL SELECT 'resets', c_custkey, 1 FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders)
"""


def pr6_upsert_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored resets after each order of a student reset one of its scores, put in twice."""
    path = _practice(spark, sf_dir)
    new = ad.table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("student_id"), (F.col("o_orderkey") % 2).alias("score_id"), F.col("o_orderdate").alias("reset_at"))
    for _ in range(2):
        pr.reset_stored(spark, path, new, BUCKETS)
    return pr.stored_practice(spark, path)["resets"]


SQL["pr6_upsert_resets"] = """
WITH f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1),
r AS (SELECT c_custkey AS student_id, c_custkey % 2 AS score_id, first + to_days(c_nationkey * 30) AS reset_at FROM customer JOIN f ON c_custkey = o_custkey
 UNION ALL SELECT o_custkey, o_orderkey % 2, o_orderdate FROM orders WHERE o_custkey % 3 <> 0)
SELECT student_id, score_id, CAST(max(reset_at) AS TIMESTAMP) AS reset_at FROM r GROUP BY 1, 2
"""


def mf11_reconciliation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons, affected songs with their audit, and totals of the splits."""
    raw, packaged, audits = ad.packaging(spark, sf_dir)
    n = F.col("song")
    split = F.when(n % 10 < 8, "train").when(n % 10 == 8, "validation").otherwise("test")
    counted = audits.withColumns({"crops": n % 50 + 1, "labels": F.when(F.col("matches"), n % 50 + 1).otherwise(n % 50 + 3)})
    report = mf.reconciliation_report(mf.reconcile(raw, packaged, audits), packaged.withColumn("split", split), counted)
    return report.fillna(-1, ["packaged_bars"]).fillna("", ["reason", "crop_audit"])


SQL["mf11_reconciliation_report"] = f"""
WITH {PACKAGING}, au AS (SELECT song, song % 3 + 1 AS n FROM (SELECT DISTINCT song FROM k) WHERE song % 4 <> 3), hv AS (SELECT song, count(*) AS n FROM pk GROUP BY 1)
SELECT 'reason' AS kind, reason AS name, count(*) AS bars, count(DISTINCT song) AS songs, -1 AS packaged_bars, '' AS reason, '' AS crop_audit FROM rc GROUP BY reason
UNION ALL SELECT 'song', CAST(rc.song AS VARCHAR), count(*), 1, coalesce(any_value(hv.n), 0), any_value(reason), CASE WHEN any_value(au.n) = 1 THEN (rc.song % 50 + 1) || ' crops / ' || (rc.song % 50 + CASE WHEN rc.song % 5 = 0 THEN 1 ELSE 3 END) || ' labels' ELSE 'no unique match' END FROM rc LEFT JOIN hv USING (song) LEFT JOIN au USING (song) GROUP BY rc.song
UNION ALL SELECT 'split', CASE WHEN song % 10 < 8 THEN 'train' WHEN song % 10 = 8 THEN 'validation' ELSE 'test' END AS s, count(*), count(DISTINCT song), -1, '', '' FROM pk GROUP BY s
"""


def io6_append_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of each year's orders appended as a batch, every second one twice, and read again."""
    path = scratch.new_folder(spark, "results")
    rows = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"))
    years = sorted(r.year for r in rows.select("year").distinct().collect())  # a few
    for at in (*years, *years[::2]):
        io.append_results(rows.where(F.col("year") == at), path, f"year-{at}")
    return io.read_results(spark, path, "item_id long, status string, year int")


SQL["io6_append_results"] = "SELECT o_orderkey AS item_id, o_orderstatus AS status, CAST(year(o_orderdate) AS INT) AS year FROM orders"


def io8_write_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usable bars written by split and read again: bars, songs and events of each split."""
    path = scratch.new_folder(spark, "subset")
    io.write_subset(ts.select_subset(ad.labels(spark, sf_dir))[0], path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("bars"), F.countDistinct("song").alias("songs"), F.sum(F.size("beats")).cast("long").alias("events"))


# A usable label has an event of each of its lineitems.
SQL["io8_write_subset"] = f"WITH {LABELS.strip().rstrip(',')}, c AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT split, count(*) AS bars, count(DISTINCT song) AS songs, CAST(sum(n) AS BIGINT) AS events FROM rs JOIN c USING (k) WHERE len(reasons) = 0 GROUP BY split"
QUERIES |= {f.__name__: f for f in (pr3_delete_students, pr6_upsert_resets, mf11_reconciliation_report, io6_append_results, io8_write_subset)}
QUERIES |= {"io1_read_labels": io1_read_labels, "io3_read_scores": io3_read_scores}
