"""DuckDB twins of the queries on labels, evaluation, practice, playback, text, boxes and streams."""

from __future__ import annotations

from tickwise.functions.notation import DRUMS, DURATIONS, GM_NOTES, PITCH_DRUMS
from tickwise.operators import manifest as mf
from tickwise.operators import text_checks as tx
from tickwise.plans.sql import EVENTS, SQL, pick

LABELS = f"""
lb AS (SELECT l_orderkey AS k, (l_partkey + 4 * l_linenumber) % 36 AS slot, {pick((*DURATIONS, 'sixty_fourth', 'quintuplet_eighth'), 'CAST(l_quantity AS BIGINT) % 12')} AS duration, {pick((*DRUMS, 'cowbell', 'midi99'), 'l_partkey % 16')} AS drum, l_suppkey % 6 = 0 AS ghost, l_tax >= 0.075 AS rest, l_linenumber = 7 AS flam FROM lineitem),
rs AS (SELECT k, 'song' || (k // 50) AS song, k % 50 + 1 AS bar, CASE WHEN k // 50 % 10 < 8 THEN 'train' WHEN k // 50 % 10 = 8 THEN 'validation' ELSE 'test' END AS split, list_sort([x FOR x IN [
  CASE WHEN k % 6 = 5 THEN 'invalid_time_signature' END, CASE WHEN k % 6 = 3 THEN 'measure_beyond_grid' END, CASE WHEN k % 20 = 0 THEN 'context_dependent_simile' END,
  CASE WHEN bool_or(NOT rest AND drum IN ('cowbell', 'midi99')) THEN 'unsupported_drum' END, CASE WHEN bool_or(NOT rest AND duration IN ('sixty_fourth', 'quintuplet_eighth')) THEN 'unsupported_duration' END,
  CASE WHEN bool_or(NOT rest AND flam) THEN 'unsupported_flam' END, CASE WHEN bool_or(NOT rest AND slot > 31) THEN 'beat_outside_grid' END,
  CASE WHEN count(DISTINCT slot) FILTER (NOT rest) < count(*) FILTER (NOT rest) THEN 'duplicate_onset' END] IF x IS NOT NULL]) AS reasons FROM lb GROUP BY k),
sp AS (SELECT DISTINCT k, slot, list_position({list(DRUMS)}, drum) - 1 AS drum_idx, list_position({list(DURATIONS)}, duration) - 1 AS duration_idx FROM lb JOIN rs USING (k) WHERE len(reasons) = 0 AND NOT rest)"""

NOTES = f"""
tr AS (SELECT l_orderkey AS item_id, CAST((l_partkey + 4 * l_linenumber) % 31 AS INT) AS position, min({pick(DURATIONS, 'CAST(l_quantity AS BIGINT) % 10')}) AS duration, list_sort(list(DISTINCT {pick(DRUMS, 'l_partkey % 14')})) AS drums FROM lineitem GROUP BY 1, 2),
pr AS (SELECT l_orderkey AS item_id, CAST((l_partkey + 4 * l_linenumber) % 31 + CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS INT) AS position, min({pick(DURATIONS, '(CAST(l_quantity AS BIGINT) % 10 + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END) % 10')}) AS duration, list_sort(list(DISTINCT {pick(DRUMS, '(l_partkey % 14 + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END) % 14')})) AS drums FROM lineitem WHERE l_partkey % 17 <> 0 GROUP BY 1, 2),
th AS (SELECT item_id, position, unnest(drums) AS drum FROM tr), ph AS (SELECT item_id, position, unnest(drums) AS drum FROM pr),
it AS (SELECT item_id FROM tr UNION SELECT item_id FROM pr),
hm AS (SELECT item_id, count(*) AS c FROM th JOIN ph USING (item_id, position, drum) GROUP BY 1),
om AS (SELECT item_id, count(*) AS c, count(*) FILTER (t.duration = p.duration) AS d FROM tr t JOIN pr p USING (item_id, position) GROUP BY 1),
sq AS (SELECT item_id, string_agg(array_to_string(drums, '+') || '/' || duration, '|' ORDER BY position) AS s, string_agg(position || ':' || array_to_string(drums, '+') || '/' || duration, '|' ORDER BY position) AS f, count(*) AS n, sum(len(drums)) AS h FROM tr GROUP BY 1),
sr AS (SELECT item_id, string_agg(array_to_string(drums, '+') || '/' || duration, '|' ORDER BY position) AS s, string_agg(position || ':' || array_to_string(drums, '+') || '/' || duration, '|' ORDER BY position) AS f, count(*) AS n, sum(len(drums)) AS h FROM pr GROUP BY 1),
cp AS (SELECT item_id, coalesce(sq.s, '') = coalesce(sr.s, '') AS same, coalesce(sq.f, '') = coalesce(sr.f, '') AS exact, coalesce(sq.n, 0) AS tn, coalesce(sr.n, 0) AS pn, coalesce(sq.h, 0) AS hn, coalesce(sr.h, 0) AS rn, coalesce(hm.c, 0) AS hc, coalesce(om.c, 0) AS oc, coalesce(om.d, 0) AS od FROM it LEFT JOIN sq USING (item_id) LEFT JOIN sr USING (item_id) LEFT JOIN hm USING (item_id) LEFT JOIN om USING (item_id))"""

PRACTICE = """
ss AS (SELECT o_orderkey AS session_id, o_custkey AS student_id, o_orderkey % 2 AS score_id, o_orderdate AS started_at, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + INTERVAL 30 MINUTE END AS ended_at, CAST(o_orderkey % 40 + 5 AS DOUBLE) AS minutes, CAST(o_custkey % 3 * 4 + 1 AS INT) AS from_bar, CAST(o_custkey % 3 * 4 + 4 AS INT) AS to_bar, CAST(60 + o_custkey % 100 AS INT) AS target_bpm, CASE WHEN o_orderkey % 8 <> 0 THEN CAST(substring(o_orderpriority, 1, 1) AS INT) END AS self_rating FROM orders),
aa AS (SELECT l_orderkey AS session_id, o_orderdate + to_minutes(CAST(l_linenumber AS BIGINT)) AS "at", CAST(50 + l_quantity AS INT) AS bpm, l_returnflag = 'N' AS clean FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
gg AS (SELECT o_orderkey AS assignment_id, o_custkey AS student_id, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS due_date, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'assigned' END AS status, o_orderdate AS created_at FROM orders),
rr AS (SELECT c_custkey AS student_id, c_custkey % 2 AS score_id, min(o_orderdate) + to_days(CAST(c_nationkey * 30 AS INT)) AS reset_at FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey)"""

USAGE = "us AS (SELECT ts, user_id AS key, event_id AS request_id, event_type AS model, CAST(floor(value * 1000) AS BIGINT) AS input_tokens, CAST(floor(value * 100) AS BIGINT) AS output_tokens, event_type = 'error' AS error FROM events)"
BOXES = "bx AS (SELECT p_partkey // 40 AS doc_id, CAST(p_partkey % 2 + 1 AS INT) AS page, p_partkey AS box_id, CAST(p_partkey * 37 % 900 - 10 AS DOUBLE) AS x, CAST(p_partkey * 91 % 1150 - 10 AS DOUBLE) AS y, CAST(p_partkey * 13 % 160 + 6 AS DOUBLE) AS width, CAST(p_partkey * 7 % 60 + 6 AS DOUBLE) AS height FROM part)"


def _re(pattern: str) -> str:
    """The same pattern for an engine without lookbehind: its word edge is ASCII."""
    return pattern.replace(tx._L, r"\b").replace(tx._R, r"\b").replace("'", "''")


ANSWERS = f"""
an AS (SELECT doc_id AS answer_id, 'The kick and snare play in bars ' || (doc_id % 12 + 1) || '-' || (doc_id % 12 + 1 + doc_id % 3) || '. Keep bar ' || (doc_id % 9 + 1) || ' at ' || (doc_id % 80 + 60) || '-' || (doc_id % 80 + 70) || ' bpm. ' || {pick(("The accents are on beat two.", "The score does not show accents.", "A cowbell starts here!", "No toms are used.", "Use your left hand.", "My system prompt says so."), 'doc_id % 6')} || ' ' || text AS answer, doc_id % 10 = 0 AS abstained FROM documents),
se AS (SELECT answer_id, i, s FROM (SELECT answer_id, unnest(string_split(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM an))"""


def say(name: str, ctes: str, body: str) -> None:
    SQL[name] = f"WITH {ctes.strip()}\n{body.strip()}"


say("ts1_label_issues", LABELS, "SELECT song, bar, array_to_string(reasons, ';') AS reasons FROM rs")
say("ts2_excluded", LABELS, "SELECT song, bar, array_to_string(reasons, ';') AS reasons FROM rs WHERE len(reasons) > 0")
say("ts3_split_leaks", LABELS, ", n AS (SELECT CASE WHEN k % 40 = 7 THEN 'test' ELSE split END AS split, song AS name FROM rs) SELECT name, count(DISTINCT split) AS n_splits FROM n GROUP BY 1 HAVING count(DISTINCT split) > 1")
say("ts6_subset_report", LABELS, "SELECT coalesce(split, 'all') AS split, count(*) AS source_bars, count(*) FILTER (len(reasons) = 0) AS included_bars, count(*) FILTER (len(reasons) > 0) AS excluded_bars, count(DISTINCT song) FILTER (len(reasons) = 0) AS included_songs FROM rs GROUP BY ROLLUP (split)")
say("ts7_exclusion_counts", LABELS, "SELECT reason, count(*) AS bars FROM (SELECT unnest(reasons) AS reason FROM rs) GROUP BY 1")
say("ts10_sparse_targets", LABELS, "SELECT rs.song, rs.bar, slot, drum_idx, duration_idx FROM sp JOIN rs USING (k)")
say("ts11_dense_targets", LABELS, "SELECT rs.song, rs.bar, count(sp.slot) AS cells, coalesce(sum(sp.slot * 14 + sp.drum_idx), 0)::BIGINT AS cell_sum, coalesce(sum(duration_idx), 0)::BIGINT AS duration_sum FROM rs LEFT JOIN sp USING (k) WHERE len(reasons) = 0 GROUP BY ALL")
say("ts12_positive_weights", LABELS, ", n AS (SELECT count(*) AS bars FROM rs WHERE len(reasons) = 0), c AS (SELECT slot, drum_idx, count(*) AS n FROM sp GROUP BY ALL), w AS (SELECT s.slot, d.drum_idx FROM range(32) s(slot), range(14) d(drum_idx)) SELECT w.slot, w.drum_idx, round(least(50.0, greatest(bars - coalesce(c.n, 0), 1) / greatest(coalesce(c.n, 0), 1)), 9) AS weight FROM w LEFT JOIN c USING (slot, drum_idx), n")
say("ev2_evaluate", NOTES, "SELECT count(*) AS bars, count(*) FILTER (pn > 0) AS nonempty_bars, round(count(*) FILTER (same) / count(*), 9) AS sequence_accuracy, round(count(*) FILTER (hn = hc AND rn = hc) / count(*), 9) AS exact_bar_accuracy, round(1 - sum(hn + rn - 2 * hc) / (count(*) * 448), 9) AS cell_accuracy, round(sum(od) / sum(tn), 9) AS duration_accuracy FROM cp")
say("ev6_drum_scores", NOTES, f", t AS (SELECT DISTINCT item_id, drum FROM th), p AS (SELECT DISTINCT item_id, drum FROM ph), j AS (SELECT coalesce(t.drum, p.drum) AS drum, count(*) FILTER (t.drum IS NOT NULL AND p.drum IS NOT NULL) AS tp, count(*) FILTER (t.drum IS NULL) AS fp, count(*) FILTER (p.drum IS NULL) AS fn FROM t FULL JOIN p ON t.item_id = p.item_id AND t.drum = p.drum GROUP BY 1) SELECT d.drum, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, coalesce(tp, 0) + coalesce(fn, 0) AS support FROM (SELECT unnest({list(DRUMS)}) AS drum) d LEFT JOIN j USING (drum)")
say("ev7_duration_scores", NOTES, f", j AS (SELECT t.duration, count(*) AS support, count(*) FILTER (p.duration = t.duration) AS correct FROM tr t LEFT JOIN pr p USING (item_id, position) GROUP BY 1) SELECT d.duration, coalesce(support, 0) AS support, coalesce(correct, 0) AS correct, round(correct / nullif(support, 0), 9) AS accuracy FROM (SELECT unnest({list(DURATIONS)}) AS duration) d LEFT JOIN j USING (duration)")
say("ev9_model_agreement", NOTES, "SELECT count(*) AS bars, count(*) FILTER (tn > 0) AS bars_with_notes, count(*) FILTER (exact) AS sequence_match, round(count(*) FILTER (exact) / count(*), 4) AS sequence_match_rate, round(sum(hn + rn - 2 * hc) / (count(*) * 448), 6) AS slot_disagreement_rate, count(*) FILTER (tn > 0) >= greatest(1, count(*) // 10) AS meaningful FROM cp")
say("ev11_latency_summary", USAGE, ", r AS (SELECT model, input_tokens AS ms FROM us), s AS (SELECT model, list_sort(list(ms)) AS v, count(*) AS n, avg(ms) AS m FROM r GROUP BY 1) SELECT model, n AS runs, round(m, 3) AS mean_ms, " + ", ".join(f"round(CAST(v[CAST(least(floor(n * CAST({p} AS DOUBLE)), n - 1) AS BIGINT) + 1] AS DOUBLE), 3) AS p{int(p * 100)}_ms" for p in (0.5, 0.95, 0.99)) + ", round(CAST(v[1] AS DOUBLE), 3) AS min_ms, round(CAST(v[n] AS DOUBLE), 3) AS max_ms FROM s")
say("ev13_bar_to_truth", EVENTS, "SELECT score_id, bar_number, CAST(onset_ticks // 6 + CASE WHEN onset_ticks % 6 >= 3 THEN 1 ELSE 0 END AS BIGINT) AS position, CASE n WHEN 8 THEN 'eighth' WHEN 16 THEN 'sixteenth' ELSE 'triplet_eighth' END AS duration, array_to_string(drums, '+') AS drums FROM ev WHERE NOT is_rest")
say("ev14_compare_bars", NOTES, "SELECT item_id, exact, tn AS onsets_truth, pn AS onsets_predicted, oc AS onsets_matched, hn::BIGINT AS hits_truth, rn::BIGINT AS hits_predicted, hc AS hits_matched, oc AS durations_compared, od AS durations_matched FROM cp")
say("ev15_benchmark_summary", NOTES, """, r AS (SELECT 'set' || item_id % 2 AS "set", 'p' || item_id % 3 AS provider, item_id % 1000 + 1 AS ms, item_id % 13 <> 0 AS ok, cp.* FROM cp), a AS (SELECT "set", provider, count(*) AS bars, count(*) FILTER (ok) AS answered, count(*) FILTER (ok AND exact) AS ne, sum(tn) FILTER (ok) AS tn, sum(pn) FILTER (ok) AS pn, sum(oc) FILTER (ok) AS oc, sum(hn) FILTER (ok) AS hn, sum(rn) FILTER (ok) AS rn, sum(hc) FILTER (ok) AS hc, sum(od) FILTER (ok) AS od, quantile_disc(ms, 0.5) FILTER (ok) AS p50_ms, quantile_disc(ms, 0.95) FILTER (ok) AS p95_ms FROM r GROUP BY ALL) SELECT "set", provider, bars, answered, bars - answered AS errors, floor((bars - answered) * 1000.0 / bars + 0.5) / 10.0 AS error_rate, floor(ne * 1000.0 / bars + 0.5) / 10.0 AS exact_bars, floor(2000.0 * oc / (tn + pn) + 0.5) / 10.0 AS onset_f1, floor(2000.0 * hc / (hn + rn) + 0.5) / 10.0 AS drum_hit_f1, floor(od * 1000.0 / oc + 0.5) / 10.0 AS duration_accuracy, CAST(p50_ms AS DOUBLE) AS p50_ms, CAST(p95_ms AS DOUBLE) AS p95_ms FROM a""")
say("ev17_segmentation", BOXES, ", p AS (SELECT 's' || doc_id % 2 AS source, doc_id, page, count(*) FILTER (width >= 30) AS expected, count(*) AS found FROM bx GROUP BY doc_id, page) SELECT source, count(*) AS pages, count(*) FILTER (found = expected) AS exact, sum(expected)::BIGINT AS expected, sum(found)::BIGINT AS found, sum(abs(found - expected))::BIGINT AS abs_error FROM p WHERE expected <> 0 GROUP BY 1")
say("pr2_late_attempts", PRACTICE, "SELECT session_id, bpm, clean, CASE WHEN \"at\" < started_at THEN 'before the session' ELSE 'after the session' END AS problem FROM (SELECT a.session_id, a.\"at\" + CASE WHEN bpm % 7 = 0 THEN INTERVAL 40 MINUTE WHEN bpm % 7 = 1 THEN -INTERVAL 40 MINUTE ELSE INTERVAL 0 MINUTE END AS \"at\", bpm, clean, started_at, ended_at FROM aa a JOIN ss USING (session_id)) WHERE \"at\" < started_at OR \"at\" > ended_at")
say("pr4_session_summary", PRACTICE, ", x AS (SELECT session_id, count(*) AS n FROM aa GROUP BY 1), p AS (SELECT student_id, count(*) AS sessions, sum(minutes) AS minutes, coalesce(sum(n), 0)::BIGINT AS attempts FROM ss LEFT JOIN x USING (session_id) GROUP BY 1), d AS (SELECT student_id, count(*) AS c FROM gg WHERE status = 'done' GROUP BY 1) SELECT c_custkey AS student_id, coalesce(sessions, 0) AS sessions, coalesce(minutes, 0) AS minutes, coalesce(attempts, 0) AS attempts, coalesce(d.c, 0) AS completed_assignments FROM customer LEFT JOIN p ON c_custkey = p.student_id LEFT JOIN d ON c_custkey = d.student_id")
say("pr4_ranges", PRACTICE, "SELECT student_id, score_id, from_bar, to_bar, count(bpm) AS attempts, coalesce(max(bpm) FILTER (clean), 0) AS best_clean_bpm FROM ss LEFT JOIN aa USING (session_id) GROUP BY ALL")
say("pr5_assignments", PRACTICE, "SELECT assignment_id, student_id, row_number() OVER (PARTITION BY student_id ORDER BY due_date NULLS LAST, created_at, assignment_id) AS place FROM gg")
say("pr7_difficulty", PRACTICE, """, s AS (SELECT ss.*, reset_at, exp(-greatest(0.0, (epoch_us(TIMESTAMP '2000-01-01') - epoch_us(started_at)) / 86400e6) / 30) AS w FROM ss LEFT JOIN rr USING (student_id, score_id) WHERE reset_at IS NULL OR started_at >= reset_at),
bs AS (SELECT student_id, score_id, from_bar, to_bar, count(*) AS sessions, count(self_rating) AS rated, sum(w * (5 - self_rating) / 4) FILTER (self_rating IS NOT NULL) AS hard, sum(w) FILTER (self_rating IS NOT NULL) AS rw FROM s GROUP BY ALL),
a AS (SELECT s.student_id, s.score_id, s.from_bar, s.to_bar, s.target_bpm, bpm, clean, exp(-greatest(0.0, (epoch_us(TIMESTAMP '2000-01-01') - epoch_us("at")) / 86400e6) / 30) AS w FROM aa JOIN s USING (session_id) WHERE reset_at IS NULL OR "at" >= reset_at),
ba AS (SELECT student_id, score_id, from_bar, to_bar, count(*) AS attempts, sum(w) AS w, sum(CASE WHEN clean THEN 0 ELSE w END) AS uw, max(least(1.0, bpm / target_bpm)) FILTER (clean) AS best FROM a GROUP BY ALL)
SELECT student_id, score_id, from_bar, to_bar, sessions, coalesce(attempts, 0) AS attempts, sessions >= 3 AND coalesce(attempts, 0) >= 6 AS enough_data, CASE WHEN sessions >= 3 AND coalesce(attempts, 0) >= 6 THEN round(0.40 * (uw / w) + 0.35 * (1 - coalesce(best, 0)) + 0.25 * (CASE WHEN rated > 0 THEN hard / rw ELSE 0.5 END), 3) ELSE -1 END AS difficulty FROM bs LEFT JOIN ba USING (student_id, score_id, from_bar, to_bar)""")
say("pr13_cloud_allowed", PRACTICE, "SELECT c_custkey AS student_id FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 6 = 0")
say("pb3_playback_hits", EVENTS, ", q AS (SELECT score_id AS request_id, score_id, from_bar, to_bar, tempo_bpm, 60.0::DOUBLE / (tempo_bpm * 48) AS tick_s FROM rq JOIN sc USING (score_id)) SELECT request_id, 192 + (bar_number - from_bar) * 192 + onset AS ticks, round((192 + (bar_number - from_bar) * 192 + onset) * tick_s, 6) AS time, drum, bar_number FROM ht JOIN q USING (score_id) WHERE bar_number BETWEEN from_bar AND to_bar")
say("pb4_playback_clicks", EVENTS, ", q AS (SELECT score_id AS request_id FROM sc) SELECT request_id, b * 48 AS ticks, b % 4 = 0 AS accent, b < 4 AS count_in FROM q, range(20) r(b)")
say("pb6_position_at", EVENTS, ", q AS (SELECT score_id, tempo_bpm, from_bar, to_bar FROM rq JOIN sc USING (score_id)), p AS (SELECT q.*, i, i * 101 + 200 AS t FROM q, range(12) r(i)), z AS (SELECT *, (t - 192) // 768 AS pass, (t - 192) % 768 AS inside FROM p), y AS (SELECT *, from_bar + inside // 192 AS bar_number, inside % 192 AS in_bar FROM z) SELECT score_id AS request_id, i, y.bar_number, max(event_idx) AS event_idx, any_value(pass) AS pass FROM y JOIN ev USING (score_id, bar_number) WHERE onset_ticks <= in_bar GROUP BY ALL")
say("pb7_midi_events", EVENTS, f", n AS (SELECT e.score_id, ((e.bar_number - 1) * 192 + onset_ticks) * 10 AS t, duration_ticks * 10 AS d, CASE drum {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in GM_NOTES.items())} END AS note FROM (SELECT *, unnest(drums) AS drum FROM ev) e), m AS (SELECT score_id, t AS time, 1 AS kind, note FROM n UNION ALL SELECT score_id, t + greatest(1, d - 1), 0, note FROM n) SELECT score_id, time, kind, note, time - lag(time, 1, 0) OVER (PARTITION BY score_id ORDER BY time, kind, note) AS delta FROM m")
say("tx2_sentences", ANSWERS, "SELECT answer_id, count(*) AS n, sum(length(s))::BIGINT AS chars FROM se GROUP BY 1")
say("tx3_unsupported_claims", ANSWERS, f"SELECT answer_id, string_agg(s, ' | ' ORDER BY i) AS claims FROM se WHERE regexp_matches(s, '{_re(tx.UNSUPPORTED)}') AND NOT regexp_matches(s, '{_re(tx.UNAVAILABLE)}') GROUP BY 1")
say("tx4_ungrounded_drums", ANSWERS, f"SELECT answer_id, string_agg(s, ' | ' ORDER BY i) AS sentences FROM se WHERE NOT regexp_matches(s, '{_re(tx.NEGATED)}') AND (regexp_matches(s, '{_re(tx.NOT_IN_SCORES)}') OR {' OR '.join(f'''regexp_matches(s, '{_re(p)}')''' for p, d in tx.DRUM_WORDS if 'kick' not in d)}) GROUP BY 1")
say("tx5_safety_flags", ANSWERS, f"SELECT answer_id, regexp_matches(answer, '{_re(tx.UNSAFE)}') AS unsafe, regexp_matches(answer, '{_re(tx.LEAK)}') AS leak, NOT abstained AND NOT regexp_matches(answer, '{_re(tx.ON_TOPIC)}') AS off_topic FROM an")
say("bx1_clamp_boxes", BOXES, ", c AS (SELECT *, greatest(0.0, least(x, 850.0 - 12)) AS cx, greatest(0.0, least(y, 1100.0 - 12)) AS cy FROM bx) SELECT doc_id, page, box_id, cx AS x, cy AS y, greatest(12.0, least(width, 850.0 - cx)) AS width, greatest(12.0, least(height, 1100.0 - cy)) AS height FROM c")
say("bx1_validate_boxes", BOXES, "SELECT doc_id, box_id, 'too small' AS problem FROM bx WHERE width < 12 OR height < 12 UNION ALL SELECT doc_id, box_id, 'past the edge' FROM bx WHERE x < 0 OR y < 0 OR x + width > 850 OR y + height > 1100")
say("st1_monthly_spend", USAGE, ", p AS (SELECT *, CASE model WHEN 'click' THEN 0.2 WHEN 'view' THEN 0.1 ELSE 0.5 END AS pi, CASE model WHEN 'click' THEN 1.2 WHEN 'view' THEN 0.4 ELSE 2.0 END AS po FROM us WHERE NOT error) SELECT date_trunc('month', ts)::TIMESTAMP AS month, sum(round(input_tokens * pi + output_tokens * po))::BIGINT AS spent_micros, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(round(input_tokens * pi + output_tokens * po)) >= 1000000 AS over_limit FROM p GROUP BY 1")
say("st3_health", USAGE, ", l AS (SELECT key, max(ts) FILTER (error) AS bad, max(ts) FILTER (NOT error) AS good FROM us GROUP BY 1) SELECT key, CASE WHEN bad IS NULL AND good IS NULL THEN 'unknown' WHEN bad IS NOT NULL AND (good IS NULL OR bad > good) THEN 'problem' ELSE 'ok' END AS health FROM l")
say("st4_progress", PRACTICE, "SELECT student_id, score_id, from_bar, to_bar, count(*) AS attempts, coalesce(max(bpm) FILTER (clean), 0) AS best_clean_bpm FROM aa JOIN ss USING (session_id) WHERE \"at\" >= started_at AND (ended_at IS NULL OR \"at\" <= ended_at) GROUP BY ALL")
PACKAGING = "k AS (SELECT l_orderkey // 50 AS song, CAST(l_orderkey % 50 + 1 AS INT) AS bar, bool_or(l_linestatus = 'O') AS open FROM lineitem GROUP BY l_orderkey), pk AS (SELECT song, bar FROM k WHERE open), ps AS (SELECT DISTINCT song FROM pk), rc AS (SELECT k.song, k.bar, CASE WHEN song % 4 = 3 THEN CASE WHEN song IN (SELECT song FROM ps) THEN 'packaged_dataset_incomplete_no_matching_pdf' ELSE 'no_matching_pdf' END WHEN song % 3 > 0 THEN CASE WHEN song IN (SELECT song FROM ps) THEN 'packaged_dataset_incomplete_ambiguous_pdf_match' ELSE 'ambiguous_pdf_match' END WHEN song % 5 <> 0 THEN CASE WHEN song IN (SELECT song FROM ps) THEN 'packaged_dataset_incomplete_crop_mismatch' ELSE 'crop_label_count_mismatch' END WHEN song IN (SELECT song FROM ps) THEN 'packaged_dataset_incomplete' ELSE 'packaged_dataset_not_regenerated' END AS reason FROM k ANTI JOIN pk USING (song, bar))"
say("mf10_reconcile", PACKAGING, "SELECT song, bar, reason FROM rc")
say("mf11_reconciliation_summary", PACKAGING, "SELECT reason, count(*) AS bars, count(DISTINCT song) AS songs FROM rc GROUP BY 1")
say("mf6_duplicate_keys", "x AS (SELECT 1)", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
say("mf3_pair_crops", "c AS (SELECT l_suppkey AS song, l_orderkey AS o FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey AS song, l_orderkey AS o FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE NOT (s_acctbal < 5000 AND l_returnflag = 'R') GROUP BY ALL), n1 AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY o) AS n, count(*) OVER (PARTITION BY song) AS total FROM c), n2 AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY o) AS n, count(*) OVER (PARTITION BY song) AS total FROM b)", "SELECT n1.song, n1.n, n1.o AS crop, n2.o AS label FROM n1 JOIN n2 USING (song, n, total)")
_PITCH = "CASE midi " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PITCH_DRUMS.items()) + " ELSE 'midi' || midi END"
RAW = f"""
rb AS (SELECT DISTINCT l_suppkey AS song, l_suppkey % 2 = 1 AS gp5, l_orderkey AS bar, l_linenumber % 2 AS voice, l_linenumber * 10000000 + l_partkey AS ord, {pick((1, 2, 4, 8, 16, 32), 'l_partkey % 6')} AS v, l_partkey % 5 = 0 AS dotted, l_partkey % 7 = 0 AS tri, l_discount >= 0.085 AS rest, l_partkey % 19 = 0 AS grace, 31 + l_partkey % 70 AS midi, l_tax >= 0.065 AS ghost FROM lineitem),
ro AS (SELECT *, coalesce(sum(CASE WHEN (80640 * (CASE WHEN dotted THEN 3 ELSE 2 END) * (CASE WHEN tri THEN 2 ELSE 1 END)) % (v * 2 * (CASE WHEN tri THEN 3 ELSE 1 END)) = 0 THEN (80640 * (CASE WHEN dotted THEN 3 ELSE 2 END) * (CASE WHEN tri THEN 2 ELSE 1 END)) // (v * 2 * (CASE WHEN tri THEN 3 ELSE 1 END)) END) OVER (PARTITION BY song, bar, voice ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS onset FROM rb),
ra AS (SELECT *, row_number() OVER (PARTITION BY song, bar, onset ORDER BY voice, ord) AS arrival FROM ro),
rd AS (SELECT *, (CASE WHEN dotted THEN 'dotted_' ELSE '' END) || (CASE WHEN tri THEN 'triplet_' ELSE '' END) || {pick(('whole', 'half', 'quarter', 'eighth', 'sixteenth', 'thirty_second'), 'CAST(log2(v) AS INT)')} AS name, {_PITCH} || CASE WHEN ghost THEN '_ghost' ELSE '' END AS drum FROM ra),
rm AS (SELECT song, bar, onset, arg_min(name, -v * 1000 + arrival) FILTER (gp5 OR NOT rest OR arrival = 1) AS duration, bool_and(rest) AS is_rest, bool_or(grace) AS flam, coalesce(list_sort(list(DISTINCT drum) FILTER (NOT rest)), []) AS drums, arg_min(v, -v * 1000 + arrival) FILTER (gp5 OR NOT rest OR arrival = 1) AS v FROM rd GROUP BY ALL)"""
say("lb8_bar_labels", RAW, "SELECT song, bar, count(*) AS n_beats, string_agg(duration || ':' || array_to_string(drums, '+') || CASE WHEN flam THEN '!' ELSE '' END, ' ' ORDER BY onset) AS beats, bool_and(is_rest AND v = 1) AS simile FROM rm GROUP BY ALL")
say("lb10_unmapped_pitches", RAW, f"SELECT song, bar, midi, count(*) AS n FROM rb WHERE NOT rest AND midi NOT IN ({', '.join(map(str, PITCH_DRUMS))}) GROUP BY ALL")


def _title(name: str) -> str:
    step = lambda x, pattern, to="": f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    s = f"lower(translate({step(name, r'[0-9]{2}-[0-9]{2}-[0-9]{4}')}, '_-', '  '))"
    s = f"split_part(split_part({s}, 'songsterr', 1), 'drum tab', 1)"
    s = step(s, rf"\b(?:{mf._MONTH})\.?\s*[0-9]{{0,2}},?\s*[0-9]{{4}}\b|\b20[0-9]{{2}}\b")
    s = step(step(s, r"\b[0-9]{1,4}\b"), r"\bby\s+(?:" + "|".join(mf.BANDS) + r")\b")
    for band in sorted(mf.BANDS, key=len, reverse=True):
        s = step(s, rf"^\s*{band}\s+")
    return f"trim({step(step(s, '[,.' + chr(39) * 2 + ']'), r'\s+', ' ')})"


say("mf1_normalise_title", f"t AS (SELECT p_partkey AS doc, {pick(('Rush ', 'AC_DC-', '', 'The Eagles '), 'p_partkey % 4')} || p_name || {pick((' Drum Tab', '-05-30-2024', ' by Rush', ' songsterr full', ' Jan. 3, 2021'), 'p_partkey % 5')} AS name FROM part)", f"SELECT doc, {_title('name')} AS title FROM t")


_GOALS = ("triplets", "syncopation", "kick independence", "tom movement", "reading rests")
CATALOGUE = f"""ca AS (SELECT p_partkey AS n, 'ex' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, {pick(("exercise", "fill"), 'p_partkey % 2')} AS kind, p_partkey % 3 AS level, {pick(("rock", "jazz", "funk"), 'p_partkey % 3')} AS style, {pick(_GOALS, 'p_partkey % 5')} AS g1, {pick(_GOALS, 'p_partkey % 3')} AS g2, CASE WHEN p_partkey % 3 = 1 THEN 3 ELSE 2 END AS depth, 50 + p_partkey % 40 AS lo, 80 + p_partkey % 60 AS target, 100 + p_partkey % 90 AS hi FROM part)"""
say("ex1_search_exercises", CATALOGUE, f""", q AS (SELECT n_nationkey AS n, {pick(("triplets", "syncopation", "tom movement"), 'n_nationkey % 3')} AS goal FROM nation), r AS (SELECT q.n AS query_id, id, 10 * (1 + (q.n % 2 = 0)::INT + (q.n % 3 = 0)::INT + (q.n % 4 = 0)::INT + (q.n % 5 = 0)::INT) AS score FROM q JOIN ca ON (q.n % 2 <> 0 OR ca.level = q.n % 3) AND (q.n % 3 <> 0 OR kind = 'fill') AND (q.n % 4 <> 0 OR hi <= 120) AND (q.n % 5 <> 0 OR style = 'rock') AND goal IN (g1, g2)) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r""")
say("ex5_recommend_fills", EVENTS + "," + CATALOGUE, """, r AS (SELECT score_id AS request_id, id, CASE WHEN style = CASE score_id % 2 WHEN 0 THEN 'rock' ELSE 'jazz' END THEN 100 ELSE 0 END + greatest(0, 50 - abs(target - tempo_bpm)) AS score FROM sc JOIN ca ON kind = 'fill' AND level <= score_id % 3 AND level >= score_id % 3 - 1 AND tempo_bpm BETWEEN lo AND hi AND depth <= 2 + score_id % 2), k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS rank FROM r) SELECT * FROM k WHERE rank <= 3""")
say("pr3_orphans", PRACTICE, """, s AS (SELECT c_custkey AS student_id FROM customer WHERE c_custkey % 3 <> 2), q AS (SELECT * FROM ss WHERE self_rating IS NOT NULL), u AS (SELECT 'sessions' AS t FROM q ANTI JOIN s USING (student_id) UNION ALL SELECT 'assignments' FROM gg ANTI JOIN s USING (student_id) UNION ALL SELECT 'resets' FROM rr ANTI JOIN s USING (student_id) UNION ALL SELECT 'attempts' FROM aa ANTI JOIN q USING (session_id)) SELECT t AS "table", count(*) AS n FROM u GROUP BY 1""")
say("pb5_events_between", EVENTS, """, q AS (SELECT score_id, from_bar, to_bar, 60.0::DOUBLE / (tempo_bpm * 48) AS s, ((to_bar - from_bar + 1) * 192) * (60.0::DOUBLE / (tempo_bpm * 48)) AS loop_s FROM rq JOIN sc USING (score_id)), h AS (SELECT score_id AS request_id, bar_number, onset, drum, (192 + (bar_number - from_bar) * 192 + onset) * s AS t, loop_s FROM ht JOIN q USING (score_id) WHERE bar_number BETWEEN from_bar AND to_bar), x AS (SELECT *, unnest(range(0, 30)) AS pass FROM h) SELECT request_id, round(t + pass * loop_s, 5) AS time, drum, bar_number, pass FROM x WHERE t + pass * loop_s >= 5.0 AND t + pass * loop_s < 25.0""")

# Titles of documents and of groups; a group links where it has the title, or is the only one that begins with it or the other way.
say("mf2_link_by_title", f"t0 AS (SELECT p_partkey AS doc, {pick(('Rush ', 'AC_DC-', '', 'The Eagles '), 'p_partkey % 4')} || p_name || {pick((' Drum Tab', '-05-30-2024', ' by Rush', ' songsterr full', ' Jan. 3, 2021'), 'p_partkey % 5')} AS name FROM part), t AS (SELECT doc, {_title('name')} AS title FROM t0)", """, k AS (SELECT DISTINCT CASE WHEN doc % 2 = 0 THEN array_to_string(string_split(title, ' ')[1:2], ' ') ELSE title END AS found FROM t), g AS (SELECT found FROM k WHERE found <> ''), n AS (SELECT doc, count(*) AS n, min(found) AS near FROM t JOIN g ON starts_with(found, title) OR starts_with(title, found) WHERE title <> '' GROUP BY 1)
SELECT t.doc, t.title, coalesce(g.found, CASE WHEN n.n = 1 THEN near END) AS "group", CASE WHEN g.found IS NOT NULL THEN 'exact' WHEN n.n = 1 THEN 'prefix' ELSE 'none' END AS how FROM t LEFT JOIN g ON g.found = t.title LEFT JOIN n ON n.doc = t.doc""")
say("pb1_validate_predictions", NOTES, f""", q AS (SELECT item_id, position AS idx, CASE WHEN item_id % 7 = 0 AND position % 5 = 0 THEN position - 40 ELSE position END AS position, item_id % 11 = 0 AS odd, CASE WHEN item_id % 13 = 0 THEN 1 WHEN item_id % 17 = 0 THEN 0 ELSE len(drums) END AS n_drums FROM pr), b AS (SELECT *, lag(position) OVER (PARTITION BY item_id ORDER BY idx) AS before FROM q)
SELECT item_id, idx, unnest(list_filter([CASE WHEN position NOT BETWEEN 0 AND 31 THEN 'position is off the grid' END, CASE WHEN position <= before THEN 'position is out of order' END, CASE WHEN odd THEN 'unknown duration' END, CASE WHEN n_drums < 1 THEN 'no drums' END, CASE WHEN item_id % 13 = 0 THEN 'unknown drum' END], lambda x : x IS NOT NULL)) AS problem FROM b""")
say("pr1_validate_practice", PRACTICE, """, u AS (
 SELECT 'students' AS t, c_custkey AS id, unnest(list_filter([CASE WHEN c_custkey % 17 = 0 THEN 'level is unknown' END, CASE WHEN c_custkey % 19 = 0 OR length(c_name) > 120 THEN 'name is empty or too long' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 <> 0 THEN 'cloud help needs a guardian''s consent' END], lambda x : x IS NOT NULL)) AS problem FROM customer
 UNION ALL SELECT 'sessions', session_id, unnest(list_filter([CASE WHEN session_id % 23 = 0 THEN 'bar range is not ordered' END, CASE WHEN session_id % 29 = 0 THEN 'target tempo is not 1-400' END, CASE WHEN session_id % 31 = 0 THEN 'rating is not 1-5' END, CASE WHEN session_id % 37 = 0 THEN 'minutes are negative' END], lambda x : x IS NOT NULL)) FROM ss
 UNION ALL SELECT 'attempts', session_id, 'tempo is not 1-400' FROM aa WHERE bpm = 60 AND session_id % 5 = 0
 UNION ALL SELECT 'assignments', assignment_id, unnest(list_filter([CASE WHEN assignment_id % 41 = 0 THEN 'status is unknown' END, CASE WHEN assignment_id % 43 = 0 THEN 'title is empty or too long' END], lambda x : x IS NOT NULL)) FROM gg)
SELECT t AS "table", CAST(id AS VARCHAR) AS id, problem, count(*) AS n FROM u GROUP BY ALL""")
PASSAGE = EVENTS + """,
pe AS (SELECT score_id, bar_number, n, bool_or(is_rest) AS rests, bool_or(len(list_intersect(drums, ['kick', 'hi_hat_pedal'])) > 0 AND len([x FOR x IN drums IF x NOT IN ('kick', 'hi_hat_pedal')]) > 0) AS foot, bool_or(len(list_intersect(drums, ['tom_hi', 'tom_mid', 'floor_tom_1', 'floor_tom_2'])) > 0) AS toms, count(*) FILTER (NOT is_rest AND onset_ticks % 48 NOT IN (0, 24)) AS off FROM ev GROUP BY ALL),
pa AS (SELECT q.request_id, p.*, CASE n WHEN 16 THEN '16th' WHEN 12 THEN 'triplet 8th' ELSE '8th' END AS small, CASE n WHEN 16 THEN 3 ELSE 2 END AS depth FROM rq q JOIN pe p ON p.score_id = q.score_id AND p.bar_number BETWEEN q.from_bar AND q.to_bar),
pf AS (SELECT request_id, arg_max(small, {'d': depth, 'b': -bar_number}) AS finest FROM pa GROUP BY 1),
pg AS (SELECT request_id, finest, bar_number, unnest(list_filter([CASE WHEN small = finest THEN 'subdivision' END, CASE WHEN n = 12 THEN 'triplets' END, CASE WHEN rests THEN 'reading rests' END, CASE WHEN foot THEN 'kick independence' END, CASE WHEN off >= 2 THEN 'syncopation' END, CASE WHEN toms THEN 'tom movement' END], lambda x : x IS NOT NULL)) AS goal FROM pa JOIN pf USING (request_id))"""
say("ex3_passage_facts", PASSAGE, "SELECT request_id, goal, string_agg(CAST(bar_number AS VARCHAR), ',' ORDER BY bar_number) AS bars, CASE WHEN goal = 'subdivision' THEN any_value(finest) END AS detail FROM pg GROUP BY request_id, goal")
# A fold over the queries of a passage, in their order: the larger of the score so far and the query's, plus 3 for each goal in common.
say("ex4_exercises_for_passage", PASSAGE + "," + CATALOGUE, """, rg AS (SELECT request_id, max(finest) AS sub, list_sort(list(DISTINCT goal) FILTER (goal <> 'subdivision')) AS goals FROM pg GROUP BY 1),
cc AS (SELECT id, CASE n % 3 WHEN 0 THEN '8th' WHEN 1 THEN '16th' ELSE 'triplet 8th' END AS sub, list_distinct([g1, g2]) AS has FROM ca),
co AS (SELECT DISTINCT sub, goals FROM rg),
hi AS (SELECT co.sub, co.goals, id, len(list_intersect(coalesce(co.goals, []), has)) AS k, has FROM co JOIN cc USING (sub)),
fo AS (SELECT sub, goals, id, CASE WHEN k = 0 THEN 10 ELSE greatest(10 + 3 * k, 20) + 3 * k + 3 * k * (k - 1) END AS score FROM hi),
rk AS (SELECT *, row_number() OVER (PARTITION BY sub, goals ORDER BY score DESC, id) AS rank FROM fo)
SELECT request_id, id, CAST(score AS INT) AS score, rank FROM rg JOIN rk ON rg.sub = rk.sub AND rg.goals IS NOT DISTINCT FROM rk.goals WHERE rank <= 3""")
say("st5_results", USAGE, """, r AS (SELECT key AS item_id, ts AS "at", request_id % 2 = 0 AS exact, request_id, row_number() OVER (PARTITION BY key ORDER BY ts, request_id % 2 = 0, request_id) AS n FROM us WHERE NOT error) SELECT item_id, "at", exact, request_id FROM r WHERE n = 1""")
say("ev1_decode_logits", "e AS (SELECT vec_id, embedding[1:24] AS d, embedding[25:64] AS u FROM embeddings)", f""", k AS (SELECT *, len(d) = 24 AND len(u) = 40 AND len(list_filter(d || u, lambda x : x IS NULL OR NOT isfinite(x))) = 0 AS ok FROM e)
SELECT vec_id AS item_id, CASE WHEN ok THEN CAST(to_json(list_filter([{{'position': i, 'duration': ({list(DURATIONS)})[list_position(u[i * 10 + 1:i * 10 + 10], list_max(u[i * 10 + 1:i * 10 + 10]))], 'drums': [({list(DRUMS[:6])})[j] FOR j IN range(1, 7) IF d[i * 6 + j] > 0]}} FOR i IN range(4)], lambda n : len(n.drums) > 0)) AS VARCHAR) END AS notes FROM k""")
# Progress facts: the bodies of three other twins as tables, then their rows in order.
_BODY = {k: SQL[k].removeprefix(f"WITH {PRACTICE.strip()}").lstrip() for k in ("pr4_session_summary", "pr4_ranges", "pr7_difficulty")}
_NESTED = {k: f"(WITH {v[1:]})" if v.startswith(",") else f"({v})" for k, v in _BODY.items()}
FACTS = PRACTICE + f""",
pe AS {_NESTED["pr4_session_summary"]}, ra AS {_NESTED["pr4_ranges"]}, dd AS {_NESTED["pr7_difficulty"]},
oa AS (SELECT a.*, p.place, row_number() OVER (PARTITION BY a.student_id ORDER BY p.place) AS k FROM (SELECT o_orderkey AS assignment_id, o_custkey AS student_id, 'Piece ' || o_orderkey AS title, CAST(o_custkey % 3 * 4 + 1 AS INT) AS lo, CAST(o_custkey % 3 * 4 + 4 AS INT) AS hi, CAST(60 + o_custkey % 100 AS INT) AS bpm FROM orders WHERE o_orderstatus <> 'F') a JOIN (SELECT assignment_id, row_number() OVER (PARTITION BY student_id ORDER BY due_date NULLS LAST, created_at, assignment_id) AS place FROM gg) p USING (assignment_id)),
rx AS (SELECT ra.*, nullif(dd.difficulty, -1) AS difficulty, CAST(score_id AS VARCHAR) || '/' || lpad(CAST(from_bar AS VARCHAR), 6, '0') || '/' || lpad(CAST(to_bar AS VARCHAR), 6, '0') AS key, chr(CAST(64 + dense_rank() OVER (PARTITION BY student_id ORDER BY CAST(score_id AS VARCHAR)) AS INT)) AS letter FROM ra LEFT JOIN dd USING (student_id, score_id, from_bar, to_bar)),
fa AS (SELECT student_id, 1 AS part, '' AS o1, unnest([0, 1, 2, 3]) AS o2, unnest(['Sessions practised', 'Attempts recorded', 'Minutes practised', 'Assignments completed']) AS text, NULL AS safe, unnest([CAST(sessions AS DOUBLE), attempts, minutes, completed_assignments]) AS value FROM pe
 UNION ALL SELECT student_id, 2, lpad(CAST(place AS VARCHAR), 9, '0'), o2, 'Open assignment "' || title || '" ' || tail, 'Open assignment assignment ' || k || ' ' || tail, value FROM (SELECT *, unnest([0, 1, 2]) AS o2, unnest(['starts at bar', 'ends at bar', 'target BPM']) AS tail, unnest([CAST(lo AS DOUBLE), hi, bpm]) AS value FROM oa)
 UNION ALL SELECT student_id, 3, key, o2, 'Score ' || score_id || ' ' || tail, 'score ' || letter || ' ' || tail, value FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS o2, unnest(['range starts at bar', 'range ends at bar', 'range attempts', 'best clean BPM', 'difficulty']) AS tail, unnest([CAST(from_bar AS DOUBLE), to_bar, attempts, nullif(best_clean_bpm, 0), difficulty]) AS value FROM rx) WHERE value IS NOT NULL),
fn AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY part, o1, o2) AS n FROM fa)"""
say("pr9_progress_facts", FACTS, "SELECT student_id, n, 'f' || n AS fact_id, text, value FROM fn")
say("pr11_pseudonymise", FACTS, "SELECT student_id, n, 'f' || n AS fact_id, coalesce(safe, text) AS text, value FROM fn")
say("pr12_offline_summary", FACTS, """, li AS (SELECT student_id, string_agg('Score ' || score_id || ', bars ' || from_bar || '-' || to_bar || ': ' || CASE WHEN best_clean_bpm > 0 THEN best_clean_bpm || ' BPM best clean tempo' ELSE 'no clean BPM recorded' END || ' across ' || attempts || ' attempts.', ' ' ORDER BY score_id, from_bar, to_bar) AS lines FROM ra GROUP BY 1)
SELECT c_custkey AS student_id, concat_ws(' ', c_name || ' practised ' || CAST(minutes AS BIGINT) || ' minutes across ' || sessions || ' sessions and made ' || attempts || ' attempts. ' || completed_assignments || ' assignments were completed.', lines) AS summary FROM customer JOIN pe ON pe.student_id = c_custkey LEFT JOIN li ON li.student_id = c_custkey""")
