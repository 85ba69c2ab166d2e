"""Queries on names, manifests, audits, results, actions and boxes, each with its DuckDB twin beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwise.operators import boxes as bx
from tickwise.operators import evaluation as ev
from tickwise.operators import exercises as ex
from tickwise.operators import manifest as mf
from tickwise.operators import practice as pr
from tickwise.operators import subset as ts
from tickwise.operators import text_checks as tx
from tickwise.plans import adapters as ad
from tickwise.plans.sql import EVENTS, pick
from tickwise.plans.sql_more import BOXES, LABELS, PRACTICE, USAGE, _re

QUERIES, SQL = {}, {}


def query(ctes: str, body: str):
    """Register a query, and its twin where there is one."""

    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if body:
            SQL[fn.__name__] = f"WITH {ctes.strip()}\n{body.strip()}"
        return fn

    return wrap


def _stem(n, song):
    """Names of crops: most end in _bar and a number."""
    end = ad.pick(("_bar007", "_bar12", "_bar", "_BAR3", "_bar5x", "_bar001_bar2"), n % 6)
    return F.concat(F.lit("song "), song.cast("string"), F.when(n % 4 < 3, F.concat(F.lit("_bar"), F.lpad((n % 120).cast("string"), 3, "0"))).otherwise(end))


_STEM = "'song ' || {song} || CASE WHEN {n} % 4 < 3 THEN '_bar' || lpad(CAST({n} % 120 AS VARCHAR), 3, '0') ELSE " + pick(("_bar007", "_bar12", "_bar", "_BAR3", "_bar5x", "_bar001_bar2"), "{n} % 6") + " END"


@query(
    f"st AS (SELECT DISTINCT {_STEM.format(n='p_partkey', song='p_size')} AS stem FROM part)",
    r"SELECT stem, CASE WHEN regexp_matches(stem, '^.+_bar[0-9]+$') THEN regexp_extract(stem, '^(.+)_bar[0-9]+$', 1) END AS song, CASE WHEN regexp_matches(stem, '^.+_bar[0-9]+$') THEN CAST(regexp_extract(stem, '_bar([0-9]+)$', 1) AS INT) END AS bar FROM st",
)
def mf4_parse_bar_name(spark, sf_dir):
    stems = ad.table(spark, sf_dir, "part").select(_stem(F.col("p_partkey"), F.col("p_size")).alias("stem")).distinct()
    return stems.select("stem", mf.parse_bar_name(F.col("stem")).alias("p")).select("stem", "p.song", "p.bar")


def _pair_sides(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    stem = _stem(n, F.col("p_size")).alias("stem")
    return p.where(n % 7 != 0).select(stem), p.where(n % 11 != 0).select(stem)


_SIDES = f"im AS (SELECT DISTINCT {_STEM.format(n='p_partkey', song='p_size')} AS stem FROM part WHERE p_partkey % 7 <> 0), la AS (SELECT DISTINCT {_STEM.format(n='p_partkey', song='p_size')} AS stem FROM part WHERE p_partkey % 11 <> 0)"


@query(_SIDES, "SELECT stem, 'image has no label' AS problem FROM im ANTI JOIN la USING (stem) UNION ALL SELECT stem, 'label has no image' FROM la ANTI JOIN im USING (stem)")
def mf5_missing_partners(spark, sf_dir):
    return mf.missing_partners(*_pair_sides(spark, sf_dir))


@query("", "")
def mf7_split_songs_seeded(spark, sf_dir):
    rows = ad.packaging(spark, sf_dir)[0].withColumn("image_name", F.concat(F.col("song").cast("string"), F.lit("/"), F.col("bar").cast("string")))
    return mf.split_songs(rows, seed=7, exact=True).select("song", "bar", "split")


_MANIFEST = _SIDES + r""", pz AS (SELECT stem, regexp_extract(stem, '^(.+)_bar[0-9]+$', 1) AS song, TRY_CAST(regexp_extract(stem, '_bar([0-9]+)$', 1) AS INT) AS bar, regexp_matches(stem, '^.+_bar[0-9]+$') AS ok FROM im JOIN la USING (stem)),
so AS (SELECT DISTINCT 'song ' || p_size AS song, p_size FROM part),
fu AS (SELECT stem, pz.song, bar, coalesce(p_size % 5 <> 0, false) AS has_source, p_size IS NOT NULL AND bar % 9 <> 0 AS has_raw, coalesce(p_size % 8 <> 0, false) AS has_split, CASE WHEN p_size % 2 = 0 THEN 'test' ELSE 'train' END AS split FROM pz LEFT JOIN so USING (song) WHERE ok)"""


def _manifest(spark, sf_dir):
    images, labels = _pair_sides(spark, sf_dir)
    songs = ad.table(spark, sf_dir, "part").select("p_size", F.concat(F.lit("song "), F.col("p_size").cast("string")).alias("song")).distinct()
    sources = songs.where("p_size % 5 <> 0").select(F.col("song").alias("source_song"), F.lit("gp7").alias("source_kind"), F.concat("song", F.lit(".gp")).alias("source_file"))
    raw = songs.select(F.col("song").alias("source_song"), F.explode(F.sequence(F.lit(0), F.lit(130))).alias("bar_number")).where("bar_number % 9 <> 0").withColumn("source_label_path", F.concat_ws("/", "source_song", "bar_number"))
    splits = songs.where("p_size % 8 <> 0").select("song", F.when(F.col("p_size") % 2 == 0, "test").otherwise("train").alias("split"))
    path = lambda kind: F.concat(F.lit(f"{kind}/"), "stem")
    return mf.build_manifest(images.distinct().withColumn("image_path", path("i")), labels.distinct().withColumn("label_path", path("l")), sources, raw, splits)


@query(_MANIFEST, "SELECT split, song, bar AS bar_number, 'i/' || stem AS image_path, 'l/' || stem AS label_path, song || '.gp' AS source_file FROM fu WHERE has_source AND has_raw AND has_split")
def mf9_build_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir)[0].select("split", "song", "bar_number", "image_path", "label_path", "source_file")


@query(_MANIFEST, "SELECT stem, 'no source file' AS problem FROM fu WHERE NOT has_source UNION ALL SELECT stem, 'no source label' FROM fu WHERE NOT has_raw UNION ALL SELECT stem, 'no split' FROM fu WHERE NOT has_split UNION ALL SELECT stem, 'name has no bar' FROM pz WHERE NOT ok UNION ALL SELECT stem, 'image has no label' FROM im ANTI JOIN la USING (stem) UNION ALL SELECT stem, 'label has no image' FROM la ANTI JOIN im USING (stem)")
def mf9_manifest_errors(spark, sf_dir):
    return _manifest(spark, sf_dir)[1]


@query("", "")
def mf12_sample_pairs(spark, sf_dir):
    return mf.sample_pairs(_manifest(spark, sf_dir)[0], "image_path", n=50, seed=7).select("image_path", "song", "bar_number")


@query(
    "m AS (SELECT o_orderkey AS k, o_orderkey % 400 AS source, CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE o_orderkey END AS bar, o_orderkey % 17 = 0 AND o_orderkey <> 0 AS other, o_orderkey % 19 = 0 AS no_image, o_orderkey % 23 = 0 AS wrong, o_orderkey % 29 = 0 AS bad FROM orders), d AS (SELECT source, bar FROM m GROUP BY ALL HAVING count(*) > 1)",
    "SELECT 'i/' || k || '.png' AS image_path, unnest(list_filter([CASE WHEN d.bar IS NOT NULL THEN 'identity repeats' END, CASE WHEN other THEN 'stems differ' END, CASE WHEN no_image THEN 'image is missing' END, CASE WHEN wrong THEN 'label is of another bar' END, CASE WHEN bad THEN 'split is unknown' END], lambda x : x IS NOT NULL)) AS problem FROM m LEFT JOIN d USING (source, bar)",
)
def ts4_audit_pairs(spark, sf_dir):
    k = F.col("o_orderkey")
    o = ad.table(spark, sf_dir, "orders").select(k, (k % 400).cast("string").alias("source_song"), F.when(k % 13 == 0, 1).otherwise(k).alias("bar_number"), F.concat(F.lit("i/"), k.cast("string"), F.lit(".png")).alias("image_path"), F.concat(F.lit("l/"), F.when(k % 17 == 0, -k).otherwise(k).cast("string"), F.lit(".json")).alias("label_path"), F.when(k % 29 == 0, "later").otherwise("train").alias("split"))
    files = o.select(F.explode(F.array_compact(F.array(F.when(k % 19 != 0, F.col("image_path")), F.col("label_path")))).alias("path"))
    labels = o.select("label_path", F.col("source_song").alias("song"), (F.col("bar_number") + F.when(k % 23 == 0, 1).otherwise(0)).alias("bar"))
    return ts.audit_pairs(o.drop("o_orderkey"), files, labels)


@query("", "SELECT 1")
def ts5_verify_hashes(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "doc_id")
    stored = d.select("path", F.when(F.col("doc_id") % 7 == 0, F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return ts.verify_hashes(stored, d.where("doc_id % 11 <> 0").select("path", "sha256")).select("path", "problem")


SQL["ts5_verify_hashes"] = "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 11 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 0"


@query(LABELS, "SELECT split FROM (VALUES ('train'), ('validation'), ('test')) s(split) WHERE split NOT IN (SELECT split FROM rs WHERE len(reasons) = 0 AND split <> 'test')")
def ts8_require_splits(spark, sf_dir):
    return ts.require_splits(ts.label_issues(ad.labels(spark, sf_dir)).where("split <> 'test'"))


@query(
    "h AS (SELECT o_orderpriority AS phase, o_orderkey AS epoch, floor(o_totalprice / 1000) AS vl, floor(o_totalprice / 2000) AS tl FROM orders)",
    "SELECT phase, arg_min(epoch, {'a': vl, 'b': epoch}) AS epoch, arg_min(tl, {'a': vl, 'b': epoch}) AS train_loss, min(vl) AS validation_loss, min(vl) - arg_min(tl, {'a': vl, 'b': epoch}) AS gap FROM h GROUP BY phase",
)
def ts13_best_epochs(spark, sf_dir):
    loss = lambda over: F.floor(F.col("o_totalprice") / over).cast("double")
    return ts.best_epochs(ad.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("phase"), F.col("o_orderkey").alias("epoch"), loss(2000).alias("train_loss"), loss(1000).alias("validation_loss")))


@query(LABELS, "SELECT song || '/' || bar AS item_id, CAST(slot AS INT) AS position, duration, drum || CASE WHEN ghost THEN '_ghost' ELSE '' END AS drums FROM lb JOIN rs USING (k) WHERE NOT rest AND split = 'test' AND bar % 3 <> 0")
def ev12_heldout_truth(spark, sf_dir):
    labels = ad.labels(spark, sf_dir)
    manifest = labels.select("song", "bar", "split", F.when(F.col("bar") % 3 != 0, "gp7").otherwise("gp5").alias("source_kind"))
    return ev.heldout_truth(manifest, labels.select("song", "bar", "beats")).withColumn("drums", F.array_join("drums", "+"))


_RESULTS = USAGE + ', r AS (SELECT key AS item_id, ts AS "at", request_id, CASE WHEN NOT error THEN request_id % 2 = 0 END AS exact FROM us WHERE key % 3 <> 0)'


def _results(spark, sf_dir):
    u = ad.usage(spark, sf_dir)
    return u.select(F.col("key").alias("item_id")).distinct(), u.where("key % 3 <> 0").select(F.col("key").alias("item_id"), F.col("ts").alias("at"), "request_id", F.when(~F.col("error"), F.col("request_id") % 2 == 0).alias("exact"))


@query(_RESULTS, 'SELECT item_id, max("at") AS "at" FROM r WHERE exact IS NOT NULL GROUP BY 1')
def ev16_latest_results(spark, sf_dir):
    return ev.resume_items(*_results(spark, sf_dir))[0].select("item_id", "at")


@query(_RESULTS, "SELECT DISTINCT key AS item_id FROM us WHERE key NOT IN (SELECT item_id FROM r WHERE exact IS NOT NULL)")
def ev16_items_to_do(spark, sf_dir):
    return ev.resume_items(*_results(spark, sf_dir))[1]


_ARTIFACTS = ("run", "completed", "evaluation", "export", "checkpoint", "config", "benchmark", "model")


@query(
    "o AS (SELECT o_orderkey AS run_id FROM orders)",
    "SELECT run_id, 'smoke run' AS problem FROM o WHERE run_id % 10 = 0 UNION ALL SELECT run_id, 'artifacts disagree on the checkpoint' FROM o WHERE run_id % 6 = 0 UNION ALL SELECT run_id, 'artifacts disagree on the model' FROM o WHERE run_id % 7 = 0 UNION ALL SELECT run_id, 'artifacts disagree on the dataset' FROM o WHERE run_id % 9 = 0",
)
def ev18_release_audit(spark, sf_dir):
    r = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    a = r.select("run_id", F.explode(F.array(*map(F.lit, _ARTIFACTS))).alias("artifact"))
    n, which = F.col("run_id"), F.col("artifact")
    sha = lambda bad: F.when(bad, F.lit("other")).otherwise(F.concat(F.lit("s"), n.cast("string")))
    return ev.release_audit(a.select("run_id", "artifact", sha((n % 6 == 0) & (which == "export")).alias("checkpoint_sha"), F.when(~((n % 7 == 0) & (which == "config")), sha(F.lit(False))).alias("model_sha"), sha((n % 9 == 0) & (which == "run")).alias("dataset_sha"), ((n % 10 == 0) & (which == "run")).alias("smoke")))


@query(
    EVENTS,
    "SELECT score_id, bar_number, CAST(NULL AS INT) AS event_idx, 'a fill must be exactly one bar' AS problem FROM bh WHERE bar_number % 5 = 0 AND n > 4 UNION ALL SELECT score_id, bar_number, NULL, 'bar numbers do not run on' FROM (SELECT *, lag(bar_number) OVER (PARTITION BY score_id ORDER BY bar_number) AS b FROM bh) WHERE b IS NOT NULL AND bar_number <> b + 1",
)
def ex6_validate_fills(spark, sf_dir):
    e = ad.events(spark, sf_dir).where("bar_number % 5 <> 0 or event_idx < 4")
    return ex.validate_fills(e)


@query(
    PRACTICE,
    """, w AS (SELECT min(o_custkey) AS w FROM orders), u AS (SELECT 'students' AS t FROM customer, w WHERE c_custkey = w UNION ALL SELECT 'sessions' FROM ss, w WHERE student_id = w UNION ALL SELECT 'assignments' FROM gg, w WHERE student_id = w UNION ALL SELECT 'resets' FROM rr, w WHERE student_id = w UNION ALL SELECT 'attempts' FROM aa JOIN ss USING (session_id), w WHERE ss.student_id = w) SELECT t AS "table", count(*) AS n FROM u GROUP BY 1""",
)
def pr10_export_student(spark, sf_dir):
    who = ad.table(spark, sf_dir, "orders").agg(F.min("o_custkey")).first()[0]
    return pr.export_student(ad.practice(spark, sf_dir), who).groupBy("table").agg(F.count(F.lit(1)).alias("n"))


@query(
    "",
    r"SELECT doc_id, instr(coalesce(text, ''), 'e') > 0 AND doc_id % 3 = 0 AS hidden, CASE WHEN length(f) > 300 THEN substring(f, 1, 299) || '…' ELSE f END AS short FROM (SELECT doc_id, text, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]', '', 'g'), '[ \t\n\f\r]+', ' ', 'g')) AS f FROM documents)",
)
def tx1_clean_short_text(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    marked = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "e", "e​")).otherwise(F.col("text"))
    return d.select("doc_id", marked.alias("t")).select("doc_id", tx.has_hidden(F.col("t")).alias("hidden"), tx.clean_short_text(F.col("t")).alias("short"))


SQL["tx1_clean_short_text"] = SQL["tx1_clean_short_text"].removeprefix("WITH \n")


@query(
    EVENTS,
    """, q AS (SELECT score_id AS answer_id, score_id, from_bar, to_bar, score_id % 4 = 0 AS part FROM rq), h AS (SELECT DISTINCT answer_id, b.bar_number FROM q JOIN bm b ON b.score_id = q.score_id AND NOT b.reviewed AND (b.bar_number BETWEEN from_bar AND to_bar OR (score_id % 3 = 0 AND b.bar_number BETWEEN 5 AND 9))), t AS (SELECT answer_id, count(*) AS n, string_agg(CAST(bar_number AS VARCHAR), ', ' ORDER BY bar_number) AS l FROM h GROUP BY 1) SELECT q.answer_id, concat_ws(' ', CASE WHEN n = 1 THEN 'Bar ' || l || ' was imported and not checked yet.' WHEN n > 1 THEN 'Bars ' || l || ' were imported and not checked yet.' END, CASE WHEN part THEN 'Only bars 2-50 of 50 were looked at.' END) AS caveats FROM q LEFT JOIN t USING (answer_id)""".replace("score_id % 3 = 0 AND b.", "q.score_id % 3 = 0 AND b."),
)
def tx10_required_caveats(spark, sf_dir):
    n = F.col("score_id")
    q = ad.requests(spark, sf_dir).select(F.col("request_id").alias("answer_id"), "score_id", F.array(F.struct("from_bar", "to_bar")).alias("references"), F.when(n % 3 == 0, 5).alias("scope_from"), F.when(n % 3 == 0, 9).alias("scope_to"), F.lit(50).alias("total_bars"), F.when(n % 4 == 0, 2).otherwise(1).alias("first_bar"), F.lit(50).alias("last_bar"))
    return tx.required_caveats(q, ad.bars(spark, sf_dir))


# Tokens of the texts tx(text_id, text): words and digits, and what is between them, with their neighbours (g: gap, w: word; b: before, a: after).
_TOKENS = r"""
tk AS (SELECT text_id, unnest(l) AS w, unnest(range(CAST(len(l) AS BIGINT))) AS i FROM (SELECT text_id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+') AS l FROM tx)),
nb AS (SELECT *, lag(w, 1, '') OVER o AS gb1, lag(w, 2, '') OVER o AS wb1, lag(w, 3, '') OVER o AS gb2, lag(w, 4, '') OVER o AS wb2, lead(w, 1, '') OVER o AS ga1, lead(w, 2, '') OVER o AS wa1, lead(w, 3, '') OVER o AS ga2, lead(w, 4, '') OVER o AS wa2, coalesce(sum(length(w)) OVER (PARTITION BY text_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM tk WINDOW o AS (PARTITION BY text_id ORDER BY i))"""
# Digits tied by single points are numbers two by two: 1.2.3 is 1.2 and 3.
_CLAIMS = r"""
dg AS (SELECT *, sum(CASE WHEN gb1 = '.' AND regexp_full_match(wb1, '[0-9]+') THEN 0 ELSE 1 END) OVER (PARTITION BY text_id ORDER BY i) AS chain FROM nb WHERE regexp_full_match(w, '[0-9]+')),
hd AS (SELECT *, row_number() OVER (PARTITION BY text_id, chain ORDER BY i) AS n, ga1 = '.' AND regexp_full_match(wa1, '[0-9]+') AS tied FROM dg),
nu AS (SELECT text_id, start, CAST(CASE WHEN tied THEN w || '.' || wa1 ELSE w END AS DOUBLE) AS number, CASE WHEN tied THEN ga2 ELSE ga1 END AS ga, lower(CASE WHEN tied THEN wa2 ELSE wa1 END) AS wa, gb1, lower(wb1) AS wb1, gb2, lower(wb2) AS wb2 FROM hd WHERE n % 2 = 1),
cl AS (SELECT DISTINCT text_id, start, number, CASE WHEN regexp_full_match(ga, '\s*') AND wa IN ('minute', 'minutes', 'min', 'mins') THEN 'minute' WHEN regexp_full_match(ga, '\s*') AND wa IN ('session', 'sessions') THEN 'session' WHEN regexp_full_match(ga, '\s*') AND wa IN ('attempt', 'attempts', 'tries', 'try') THEN 'attempt' WHEN regexp_full_match(ga, '\s*') AND wa = 'bpm' THEN 'bpm' WHEN regexp_full_match(ga, '\s*') AND wa IN ('assignment', 'assignments') THEN 'assignment'
  WHEN regexp_full_match(gb1, '\s*') AND wb1 IN ('bar', 'bars') THEN 'bar' WHEN regexp_full_match(gb1, '\s*[–-]\s*') AND regexp_full_match(wb1, '[0-9]+') AND regexp_full_match(gb2, '\s*') AND wb2 IN ('bar', 'bars') THEN 'bar' END AS unit FROM nu WHERE NOT (regexp_full_match(gb1, '\s*') AND wb1 = 'assignment'))"""
_CAPITALS = ", ".join(f"'{w}'" for w in tx.KNOWN_CAPITALS)
_NAMES = rf"na AS (SELECT DISTINCT text_id, w FROM nb WHERE regexp_full_match(w, '[A-Z][a-z]{{2,}}') AND w NOT IN ({_CAPITALS}) AND NOT (i = 0 OR (i = 1 AND trim(gb1, ' ' || chr(9) || chr(10) || chr(13)) = '') OR regexp_matches(gb1, '[.!?:]\s*$') OR regexp_matches(gb1, '\n\s*$')))"
_TURNS = "SELECT conv_id * 1000 + turn AS text_id, conv_id AS student_id, {} AS text FROM conversations"


def _turns(spark, sf_dir):
    """(text_id, student_id, text): every turn of every conversation."""
    return ad.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), F.col("conv_id").alias("student_id"), "turn", "text")


_SAID = "concat('Bars ', conv_id % 9 + 1, '–', conv_id % 9 + 4, ' went up to ', turn * 7 + 60, ' BPM. ', text, ' They practised ', conv_id % 50, '.5 minutes, with ', turn + 1, ' attempts in assignment 2')"


@query(
    f"tx AS ({_TURNS.format(_SAID)}), {_TOKENS}, {_CLAIMS}",
    """, fa AS (SELECT DISTINCT conv_id AS s, 'minute' AS about, conv_id % 50 + 0.5 AS v FROM conversations WHERE conv_id % 3 <> 0 UNION SELECT conv_id, 'bpm', turn * 7 + 60 FROM conversations WHERE turn % 2 = 0 UNION SELECT conv_id, 'bar', conv_id % 9 + 1 FROM conversations UNION SELECT conv_id, 'attempt', 1 FROM conversations)
SELECT DISTINCT text_id, number, coalesce(unit, '') AS unit FROM cl WHERE NOT EXISTS (SELECT 1 FROM fa WHERE fa.s = cl.text_id // 1000 AND fa.v = cl.number AND (cl.unit IS NULL OR cl.unit = fa.about))""",
)
def tx11_ungrounded_numbers(spark, sf_dir):
    """The numbers of every turn, with sentences around it, that are no fact of the conversation."""
    t = _turns(spark, sf_dir)
    n, turn = F.col("student_id"), F.col("turn")
    facts = lambda text, value, keep=None: (t if keep is None else t.where(keep)).select("student_id", F.lit(text).alias("text"), value.cast("double").alias("value"))
    known = facts("Minutes practised", n % 50 + 0.5, n % 3 != 0).unionByName(facts("best clean BPM", turn * 7 + 60, turn % 2 == 0)).unionByName(facts("range starts at bar", n % 9 + 1)).unionByName(facts("Attempts recorded", F.lit(1))).distinct()
    text = F.expr(_SAID.replace("conv_id", "student_id"))
    return tx.ungrounded_numbers(t.select("text_id", "student_id", text.alias("text")), known).withColumn("unit", F.coalesce("unit", F.lit("")))


@query(
    f"tx AS ({_TURNS.format('text')}), {_TOKENS}, {_NAMES}",
    rf", l AS (SELECT text_id, string_agg(w, ',' ORDER BY w) AS names FROM na WHERE w <> 'Elle' GROUP BY 1) SELECT tx.text_id, regexp_matches(text, '{_re(tx.JUDGEMENT)}') AS judgement, coalesce(names, '') AS names FROM tx LEFT JOIN l USING (text_id)",
)
def tx12_summary_flags(spark, sf_dir):
    """Every turn: words of judgement, and capitalised words inside its sentences but for the student's own name."""
    return _turns(spark, sf_dir).select("text_id", tx.summary_flags(F.col("text"), F.lit("Elle")).alias("f")).select("text_id", "f.judgement", F.array_join(F.array_sort("f.names"), ",").alias("names"))


def _actions(spark, sf_dir):
    n = F.col("doc_id")
    null = F.lit(None)
    kind = ad.pick(("select_bars", "set_loop", "set_tempo", "open_exercise", "dance"), n % 5)
    ranged = F.col("kind").isin("select_bars", "set_loop")
    one = F.struct(F.col("kind").alias("type"), F.when(ranged, n % 20).cast("int").alias("from_bar"), F.when(ranged, n % 20 + 2).cast("int").alias("to_bar"), F.when(F.col("kind") == "set_tempo", n % 250).cast("int").alias("tempo_bpm"), F.when(F.col("kind") == "open_exercise", F.concat(F.lit("ex"), F.lpad((n % 3000).cast("string"), 9, "0"))).otherwise(null.cast("string")).alias("exercise_id"), F.when(n % 7 == 0, "").otherwise("Practise this.").alias("reason"))
    rows = ad.table(spark, sf_dir, "documents").select("doc_id").withColumn("kind", kind).select(n.alias("answer_id"), F.lit(100).alias("tempo_bpm"), F.lit(1).alias("first_bar"), F.lit(16).alias("last_bar"), F.array_repeat(one, (n % 4 + 1).cast("int")).alias("actions"))
    return rows


@query(
    """a AS (SELECT doc_id AS n, CASE doc_id % 5 WHEN 0 THEN 'select_bars' WHEN 1 THEN 'set_loop' WHEN 2 THEN 'set_tempo' WHEN 3 THEN 'open_exercise' ELSE 'dance' END AS kind, least(doc_id % 4 + 1, 3) AS c FROM documents),
p AS (SELECT n, c, CASE WHEN kind = 'dance' THEN 'unknown type' WHEN n % 7 = 0 THEN 'reason is not a short sentence' WHEN kind IN ('select_bars', 'set_loop') AND (n % 20 < 1 OR n % 20 + 2 > 16) THEN 'range is not in the score' WHEN kind = 'set_tempo' AND (n % 250 < 40 OR n % 250 > 220) THEN 'tempo is not 40-220' WHEN kind = 'set_tempo' AND (n % 250 < 60 OR n % 250 > 140) THEN 'tempo is not within 40 % of the score''s' WHEN kind = 'open_exercise' AND n % 3000 NOT IN (SELECT p_partkey FROM part) THEN 'exercise is not in the catalogue' END AS problem FROM a),
e AS (SELECT n, unnest(range(c)) AS idx, problem FROM p)""",
    "SELECT n AS answer_id, CAST(idx AS INT) AS idx, coalesce(problem, CASE WHEN idx > 0 THEN 'action repeats' END) AS problem FROM e WHERE problem IS NOT NULL OR idx > 0 UNION ALL SELECT doc_id, 3, 'too many actions' FROM documents WHERE doc_id % 4 = 3",
)
def tx13_validate_actions(spark, sf_dir):
    exercises = ad.table(spark, sf_dir, "part").select(F.concat(F.lit("ex"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("id"))
    return tx.validate_actions(_actions(spark, sf_dir), exercises)


@query(
    f"""dr AS (SELECT conv_id * 1000 + turn AS draft_id, conv_id AS s, turn, text, concat('The student made ', turn + 1, ' attempts.') AS item, CASE WHEN turn % 3 = 1 THEN ['f9'] WHEN turn % 5 = 4 THEN [] ELSE ['f2'] END AS cited FROM conversations),
tx AS (SELECT draft_id * 10 AS text_id, text FROM dr UNION ALL SELECT draft_id * 10 + 1, item FROM dr), {_TOKENS}, {_CLAIMS}, al AS (SELECT draft_id, 2 AS part, text || chr(10) || item AS text FROM dr),
{_TOKENS.replace("tk AS", "tk2 AS").replace("nb AS", "nb2 AS").replace("FROM tk ", "FROM tk2 ").replace("FROM tx)", "FROM (SELECT draft_id AS text_id, text FROM al))").strip()}, {_NAMES.replace("na AS", "na2 AS").replace("FROM nb ", "FROM nb2 ")}""",
    rf""", fa AS (SELECT DISTINCT conv_id AS s, 'f2' AS f, 'attempt' AS about, conv_id % 4 + 1 AS v FROM conversations UNION SELECT conv_id, 'f3', 'minute', 10 FROM conversations)
SELECT DISTINCT draft_id, problem FROM (
  SELECT draft_id, 'summary is empty or too long' AS problem FROM dr WHERE trim(text) = '' OR length(text) > {tx.LIMITS['summary']}
  UNION ALL SELECT draft_id, 'judges the student' FROM al WHERE regexp_matches(text, '{_re(tx.JUDGEMENT)}')
  UNION ALL SELECT text_id, 'names somebody' FROM na2 WHERE w <> 'Elle'
  UNION ALL SELECT draft_id, 'an item cites nothing' FROM dr WHERE len(cited) = 0
  UNION ALL SELECT draft_id, 'cites an unknown fact' FROM dr WHERE list_contains(cited, 'f9')
  UNION ALL SELECT text_id // 10, 'a number is no cited fact''s value' FROM cl WHERE text_id % 10 = 0 AND NOT EXISTS (SELECT 1 FROM fa WHERE fa.s = cl.text_id // 10000 AND fa.v = cl.number AND (cl.unit IS NULL OR cl.unit = fa.about))
  UNION ALL SELECT text_id // 10, 'a number is no cited fact''s value' FROM cl JOIN dr ON dr.draft_id = cl.text_id // 10 WHERE text_id % 10 = 1 AND len(cited) > 0 AND NOT EXISTS (SELECT 1 FROM fa WHERE fa.s = dr.s AND list_contains(dr.cited, fa.f) AND fa.v = cl.number AND (cl.unit IS NULL OR cl.unit = fa.about)))""",
)
def tx15_check_summaries(spark, sf_dir):
    """Every turn of every conversation as the summary of a student, with an item that cites facts."""
    t = _turns(spark, sf_dir)
    turn = F.col("turn")
    item = F.struct(F.concat(F.lit("The student made "), (turn + 1).cast("string"), F.lit(" attempts.")).alias("text"), F.when(turn % 3 == 1, F.array(F.lit("f9"))).when(turn % 5 == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("f2"))).alias("fact_ids"))
    d = t.select(F.col("text_id").alias("draft_id"), "student_id", F.col("text").alias("summary"), F.array(item).alias("highlights"), F.array().cast("array<struct<text:string,fact_ids:array<string>>>").alias("next_steps"), F.array().cast("array<string>").alias("caveats"))
    who = t.select("student_id").distinct()
    n = F.col("student_id")
    facts = who.select(n, F.lit("f2").alias("fact_id"), F.lit("Attempts recorded").alias("text"), (n % 4 + 1).cast("double").alias("value")).unionByName(who.select(n, F.lit("f3").alias("fact_id"), F.lit("Minutes practised").alias("text"), F.lit(10.0).alias("value")))
    return tx.check_summaries(d, facts, who.withColumn("display_name", F.lit("Elle")))


@query(
    BOXES,
    ", r AS (SELECT *, box_id % 3 = 0 AS stale, box_id % 4 = 0 AS absent, box_id % 5 = 0 AS failed FROM bx) SELECT doc_id, count(*) FILTER (NOT absent AND NOT stale AND NOT failed) AS done, count(*) FILTER (NOT absent AND NOT stale AND failed) AS failed, count(*) FILTER (absent OR stale) AS pending FROM r GROUP BY 1",
)
def bx3_pending_counts(spark, sf_dir):
    return bx.pending_boxes(ad.boxes(spark, sf_dir), _box_results(spark, sf_dir), "omr")[1]


def _box_results(spark, sf_dir):
    n = F.col("box_id")
    keyed = bx.pending_boxes(ad.boxes(spark, sf_dir), ad.boxes(spark, sf_dir).select("doc_id", "box_id", F.lit("").alias("key"), F.lit("").alias("status")).limit(0), "omr")[0]
    return keyed.where(n % 4 != 0).select("doc_id", "box_id", F.when(n % 3 == 0, F.sha2("key", 256)).otherwise(F.col("key")).alias("key"), F.when(n % 5 == 0, "failed").otherwise("done").alias("status"))


@query(BOXES, "SELECT doc_id, box_id FROM bx WHERE box_id % 3 = 0 OR box_id % 4 = 0")
def bx3_pending_boxes(spark, sf_dir):
    return bx.pending_boxes(ad.boxes(spark, sf_dir), _box_results(spark, sf_dir), "omr")[0].select("doc_id", "box_id")


