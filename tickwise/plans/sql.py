"""DuckDB twins: the adapters as common table expressions, and one statement for each registered query."""

from __future__ import annotations

from tickwise.functions.notation import DRUMS, DURATIONS


def pick(values, index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for i, v in enumerate(values)) + " END"


R2 = lambda x: f"floor(({x}) * 100 + 0.5) / 100.0"
NUMBERS = lambda x, order: f"coalesce(string_agg(CAST({x} AS VARCHAR), ',' ORDER BY {order}), '')"
COUNT_LABEL = lambda o: f"(CAST({o} // 48 + 1 AS VARCHAR) || CASE WHEN {o} % 48 = 0 THEN '' WHEN {o} % 48 = 12 THEN 'e' WHEN {o} % 48 = 24 THEN '&' WHEN {o} % 48 = 36 THEN 'a' WHEN {o} % 48 = 16 THEN 'trip' WHEN {o} % 48 = 32 THEN 'let' WHEN {o} % 6 = 0 THEN ' (32nd)' ELSE ' (triplet 16th)' END)"

EVENTS = f"""
g AS (SELECT DISTINCT l_orderkey AS k, {pick((8, 16, 12), 'l_orderkey % 3')} AS n FROM lineitem),
st AS (SELECT k, n, unnest(range(n)) AS step FROM g),
h0 AS (SELECT l_orderkey AS k, l_linenumber % 8 AS step, {pick(("tom_hi", "crash", "snare", "kick", "floor_tom_1"), 'l_suppkey % 5')} AS drum FROM lineitem
 UNION SELECT k, step, 'hi_hat_closed' FROM st WHERE k % 4 <> 0
 UNION SELECT k, step, 'kick' FROM st WHERE k % 4 <> 0 AND step * (192 // n) IN (0, 96)
 UNION SELECT k, step, 'snare' FROM st WHERE k % 4 <> 0 AND step * (192 // n) IN (48, 144)),
ht AS (SELECT k // 50 AS score_id, k % 50 + 1 AS bar_number, step * (192 // n) AS onset, drum FROM h0 JOIN g USING (k)),
ev AS (SELECT st.k // 50 AS score_id, st.k % 50 + 1 AS bar_number, step AS event_idx, step * (192 // n) AS onset_ticks, 192 // n AS duration_ticks, CASE n WHEN 16 THEN '16' ELSE '8' END AS written, n = 12 AS triplet, n,
  coalesce(drums, []) AS drums, drums IS NULL AS is_rest FROM st LEFT JOIN (SELECT k, step, list_sort(list(drum)) AS drums FROM h0 GROUP BY k, step) d USING (k, step)),
sc AS (SELECT DISTINCT l_orderkey // 50 AS score_id, CAST(l_orderkey // 50 % 150 + 60 AS INT) AS tempo_bpm, l_orderkey // 50 % 5 AS revision FROM lineitem),
rq AS (SELECT score_id AS request_id, score_id, score_id % 45 + 1 AS from_bar, score_id % 45 + 4 AS to_bar FROM sc),
bm AS (SELECT k // 50 AS score_id, k % 50 + 1 AS bar_number, 'b' || k AS bar_id, k % 7 <> 0 AS reviewed, k % 3 AS warning_count FROM g),
lab AS (SELECT *, CASE n WHEN 16 THEN '16th' WHEN 12 THEN 'triplet 8th' ELSE '8th' END AS small FROM (SELECT DISTINCT score_id, bar_number, n FROM ev)),
ct AS (SELECT score_id, bar_number, string_agg(CASE WHEN is_rest THEN '(' || w || ')' ELSE w END, ' ' ORDER BY event_idx) AS counting FROM (
  SELECT *, CASE WHEN lag(onset_ticks // 48) OVER (PARTITION BY score_id, bar_number ORDER BY event_idx) = onset_ticks // 48 THEN trim(regexp_replace({COUNT_LABEL('onset_ticks')}, '^[0-9]+', '')) ELSE {COUNT_LABEL('onset_ticks')} END AS w FROM ev) GROUP BY ALL),
pt AS (SELECT score_id, bar_number, string_agg(lpad(CAST(onset AS VARCHAR), 3, '0') || ':' || drum, '|' ORDER BY lpad(CAST(onset AS VARCHAR), 3, '0') || ':' || drum) AS pattern, count(*) AS n_keys FROM ht GROUP BY ALL),
bh AS (SELECT score_id, bar_number, n, count(*) FILTER (NOT is_rest) AS hits, count(*) AS n_events, sum(len(drums)) AS strokes, count(*) FILTER (len(drums) > 1) AS chords FROM ev GROUP BY ALL)"""

# Similarity of two bars by their hits.
_SIM = "(SELECT count(*) FROM ht x JOIN ht y ON x.onset = y.onset AND x.drum = y.drum WHERE x.score_id = {a}.score_id AND x.bar_number = {an} AND y.score_id = {a}.score_id AND y.bar_number = {bn})"

SQL: dict[str, str] = {}


def say(name: str, body: str, ctes: str = EVENTS) -> None:
    SQL[name] = f"WITH {ctes.strip()}{',' if body.lstrip()[:6].upper() != 'SELECT' else ''}\n{body.strip()}"


say("sc2_score_events", "SELECT score_id, bar_number, event_idx, onset_ticks, duration_ticks, written AS written_duration, triplet, array_to_string(drums, '+') AS drums, is_rest FROM ev")
say("sc3_bar_fill", "SELECT score_id, bar_number, CAST(sum(duration_ticks) AS BIGINT) AS filled_ticks, CASE WHEN sum(duration_ticks) > 192 THEN 'overfull' WHEN sum(duration_ticks) < 192 THEN 'incomplete' ELSE 'full' END AS state FROM ev GROUP BY ALL")
say("sc4_triplet_groups", "SELECT score_id, bar_number, CASE WHEN n = 12 THEN 4 ELSE 0 END AS triplet_groups FROM bh")
say("sc6_validate_events", "SELECT score_id, bar_number, 'bar numbers do not run on' AS problem FROM (SELECT *, lag(bar_number) OVER (PARTITION BY score_id ORDER BY bar_number) AS b FROM bh) WHERE b IS NOT NULL AND bar_number <> b + 1")
say("sc7_slice_bars", "l AS (SELECT score_id, max(bar_number) AS last FROM bh GROUP BY ALL) SELECT q.request_id, e.score_id, e.bar_number, e.event_idx, q.from_bar > 1 OR least(q.to_bar, l.last) < l.last AS truncated FROM rq q JOIN l USING (score_id) JOIN ev e ON e.score_id = q.score_id AND e.bar_number BETWEEN q.from_bar AND least(q.to_bar, l.last)")
say("sc8_score_hash", "b AS (SELECT score_id, bar_number, sha256(string_agg(concat_ws(':', bar_number, event_idx, onset_ticks, duration_ticks, written, 'false', CAST(triplet AS VARCHAR), array_to_string(drums, '+')), '|' ORDER BY event_idx)) AS h FROM ev GROUP BY ALL) SELECT score_id, sha256(string_agg(h, '|' ORDER BY bar_number)) AS content_hash FROM b GROUP BY ALL")
say("sc9_review_summary", f"SELECT score_id, count(*) FILTER (NOT reviewed) AS unreviewed, count(*) AS total, CAST(coalesce(sum(warning_count) FILTER (NOT reviewed), 0) AS BIGINT) AS warnings, coalesce(string_agg(CAST(bar_number AS VARCHAR), ',' ORDER BY bar_number) FILTER (NOT reviewed), '') AS bars FROM bm GROUP BY ALL")
say("sc9_next_unreviewed", "n AS (SELECT score_id, count(*) AS n FROM bm GROUP BY ALL) SELECT q.score_id, q.from_bar, arg_min(b.bar_number, ((b.bar_number - q.from_bar - 1) % n.n + n.n) % n.n) AS next_bar FROM rq q JOIN n USING (score_id) LEFT JOIN (SELECT * FROM bm WHERE NOT reviewed) b USING (score_id) GROUP BY ALL")
say("sc10_describe_bars", "f AS (SELECT score_id, bar_number, drum, min(event_idx * 100 + i) AS o FROM (SELECT score_id, bar_number, event_idx, unnest(drums) AS drum, generate_subscripts(drums, 1) AS i FROM ev) GROUP BY ALL), d AS (SELECT score_id, bar_number, string_agg(replace(drum, '_', ' '), ', ' ORDER BY o) AS names FROM f GROUP BY ALL) SELECT score_id, bar_number, 'Bar ' || bar_number || ': ' || CASE WHEN hits = 0 THEN 'rests only' ELSE hits || CASE WHEN hits = 1 THEN ' note - ' ELSE ' notes - ' END || names END AS line FROM bh LEFT JOIN d USING (score_id, bar_number)")
say("an2_counting", "SELECT * FROM ct")
say("an3_overview", f"o AS (SELECT score_id, count(*) AS total_bars, CAST(sum(strokes) AS BIGINT) AS drum_hits, CAST(sum(chords) AS BIGINT) AS chords, CAST(sum(n_events - hits) AS BIGINT) AS rests, CAST(sum(CASE WHEN n = 12 THEN 4 ELSE 0 END) AS BIGINT) AS triplet_groups, min(192 // n) AS least, coalesce(string_agg(CAST(bar_number AS VARCHAR), ',' ORDER BY bar_number) FILTER (hits = 0), '') AS empty_bars FROM bh GROUP BY ALL), m AS (SELECT b.score_id, string_agg(CAST(b.bar_number AS VARCHAR), ',' ORDER BY b.bar_number) AS smallest_bars, any_value(small) AS smallest_note FROM bh b JOIN o USING (score_id) JOIN lab USING (score_id, bar_number) WHERE 192 // b.n = o.least GROUP BY ALL), u AS (SELECT score_id, string_agg(drum || ':' || c, ',' ORDER BY c DESC, drum) AS drums_used FROM (SELECT score_id, drum, count(*) AS c FROM ht GROUP BY ALL) GROUP BY ALL) SELECT score_id, total_bars, drum_hits, chords, rests, triplet_groups, smallest_note, smallest_bars, empty_bars, '' AS incomplete_bars, drums_used, tempo_bpm, {R2('total_bars * 240.0 / tempo_bpm')} AS duration_seconds FROM o JOIN m USING (score_id) JOIN u USING (score_id) JOIN sc USING (score_id)")
_CHANGE = "string_agg(drum || ' on ' || " + COUNT_LABEL("onset") + ", ', ' ORDER BY lpad(CAST(onset AS VARCHAR), 3, '0') || ':' || drum)"
say("an4_inspect_bars", f"pv AS (SELECT a.score_id, a.bar_number, b.bar_number IS NOT NULL AS has FROM bh a LEFT JOIN bh b ON a.score_id = b.score_id AND b.bar_number = a.bar_number - 1), ad AS (SELECT score_id, bar_number, {_CHANGE} AS s FROM (SELECT a.* FROM ht a ANTI JOIN ht b ON a.score_id = b.score_id AND b.bar_number = a.bar_number - 1 AND a.onset = b.onset AND a.drum = b.drum) GROUP BY ALL), rm AS (SELECT score_id, bar_number, {_CHANGE} AS s FROM (SELECT a.score_id, a.bar_number + 1 AS bar_number, onset, drum FROM ht a ANTI JOIN ht b ON a.score_id = b.score_id AND b.bar_number = a.bar_number + 1 AND a.onset = b.onset AND a.drum = b.drum) GROUP BY ALL) SELECT b.score_id, b.bar_number, counting, small AS smallest_note, hits AS n_hits, n_events - hits AS n_rests, CASE WHEN b.n = 12 THEN 4 ELSE 0 END AS triplet_groups, CASE WHEN has THEN coalesce(ad.s, '') END AS added, CASE WHEN has THEN coalesce(rm.s, '') END AS removed FROM bh b JOIN ct USING (score_id, bar_number) JOIN lab USING (score_id, bar_number) JOIN pv USING (score_id, bar_number) LEFT JOIN ad USING (score_id, bar_number) LEFT JOIN rm USING (score_id, bar_number)")
_UNION = "(SELECT count(*) FROM (SELECT onset, drum FROM ht WHERE score_id = p.score_id AND bar_number IN (p.bar_a, p.bar_b) GROUP BY ALL))"
say("an5_compare_passages", f"p AS (SELECT a.score_id, a.bar_number AS bar_a, b.bar_number AS bar_b, a.hits AS ha, b.hits AS hb, a.n AS na, b.n AS nb FROM bh a JOIN bh b ON a.score_id = b.score_id AND b.bar_number = a.bar_number + 2), m AS (SELECT p.score_id, p.bar_a, p.bar_b, x.onset, x.drum, bool_or(x.bar_number = p.bar_a) AS ina, bool_or(x.bar_number = p.bar_b) AS inb FROM p JOIN ht x ON x.score_id = p.score_id AND x.bar_number IN (p.bar_a, p.bar_b) GROUP BY ALL), s AS (SELECT score_id, bar_a, bar_b, count(*) FILTER (ina AND inb) / count(*) AS j FROM m GROUP BY ALL), d AS (SELECT score_id, bar_a, bar_b, drum, bool_or(ina) AS ina, bool_or(inb) AS inb FROM m GROUP BY ALL), e AS (SELECT score_id, bar_a, bar_b, coalesce(string_agg(drum, ',' ORDER BY drum) FILTER (inb AND NOT ina), '') AS drums_added, coalesce(string_agg(drum, ',' ORDER BY drum) FILTER (ina AND NOT inb), '') AS drums_removed FROM d GROUP BY ALL) SELECT p.score_id, p.bar_a, p.bar_b, CASE WHEN j IS NULL THEN 1.0 ELSE {R2('j')} END AS similarity, hb - ha AS density_delta, coalesce(drums_added, '') AS drums_added, coalesce(drums_removed, '') AS drums_removed, na <> nb AS subdivision_changed FROM p LEFT JOIN s USING (score_id, bar_a, bar_b) LEFT JOIN e USING (score_id, bar_a, bar_b)")
say("an6_exact_repeats", "SELECT score_id, count(*) AS n_bars, string_agg(CAST(bar_number AS VARCHAR), ',' ORDER BY bar_number) AS bars, any_value(n_keys) AS n_hits FROM pt GROUP BY score_id, pattern HAVING count(*) > 1")
_PAIRS = "c AS (SELECT {s} r.id AS a, q.id AS b, count(*) AS common FROM kt r JOIN kt q ON {j} r.onset = q.onset AND r.drum = q.drum AND r.id < q.id GROUP BY ALL)"
say("an7_near_repeats", f"rp AS (SELECT score_id, min(bar_number) AS id, any_value(n_keys) AS n_keys FROM pt GROUP BY score_id, pattern), kt AS (SELECT rp.score_id, rp.id, ht.onset, ht.drum FROM rp JOIN ht ON ht.score_id = rp.score_id AND ht.bar_number = rp.id), {_PAIRS.format(s='r.score_id,', j='r.score_id = q.score_id AND')} SELECT c.score_id, c.a AS bar_a, c.b AS bar_b, {R2('common / (x.n_keys + y.n_keys - common)')} AS similarity FROM c JOIN rp x ON x.score_id = c.score_id AND x.id = c.a JOIN rp y ON y.score_id = c.score_id AND y.id = c.b WHERE {R2('common / (x.n_keys + y.n_keys - common)')} >= 0.75")
say("an8_corpus_patterns", "SELECT sha256(pattern) AS pattern, count(*) AS n_bars, count(DISTINCT score_id) AS n_scores, min({'s': score_id, 'b': bar_number}).s AS first_score, min({'s': score_id, 'b': bar_number}).b AS first_bar, any_value(n_keys) AS n_hits FROM pt GROUP BY pattern HAVING count(*) > 1")
say("an9_fill_candidates", f"""
ft AS (SELECT b.score_id, b.bar_number, b.hits, b.strokes, coalesce(t.toms, 0) AS toms, coalesce(t.keeps, false) AS keeps, coalesce(t.crash, false) AS crash FROM bh b LEFT JOIN (SELECT score_id, bar_number, count(*) FILTER (drum IN ('tom_hi', 'tom_mid', 'floor_tom_1', 'floor_tom_2')) AS toms, bool_or(drum IN ('hi_hat_closed', 'hi_hat_open_half', 'hi_hat_open_full', 'hi_hat_pedal', 'crash', 'ride', 'ride_bell')) AS keeps, bool_or(drum = 'crash' AND onset = 0) AS crash FROM ht GROUP BY ALL) t USING (score_id, bar_number)),
np AS (SELECT a.score_id, a.bar_number, b.bar_number AS other, b.hits, b.keeps FROM ft a JOIN ft b ON a.score_id = b.score_id AND abs(a.bar_number - b.bar_number) <= 2 AND a.bar_number <> b.bar_number),
cm AS (SELECT np.score_id, np.bar_number, np.other, count(*) AS c FROM np JOIN ht x ON x.score_id = np.score_id AND x.bar_number = np.bar_number JOIN ht y ON y.score_id = np.score_id AND y.bar_number = np.other AND x.onset = y.onset AND x.drum = y.drum GROUP BY ALL),
sm AS (SELECT np.*, CASE WHEN coalesce(p.n_keys, 0) + coalesce(q.n_keys, 0) = 0 THEN 1.0 ELSE coalesce(c, 0) / (coalesce(p.n_keys, 0) + coalesce(q.n_keys, 0) - coalesce(c, 0)) END AS j FROM np LEFT JOIN cm USING (score_id, bar_number, other) LEFT JOIN pt p ON p.score_id = np.score_id AND p.bar_number = np.bar_number LEFT JOIN pt q ON q.score_id = np.score_id AND q.bar_number = np.other),
nb AS (SELECT score_id, bar_number, 1 - max(j) AS novelty, median(hits) AS typical, count(*) FILTER (keeps) > count(*) / 2 AS most FROM sm GROUP BY ALL),
sg AS (SELECT f.score_id, f.bar_number, coalesce(novelty, 0) AS novelty, CASE WHEN f.strokes > 0 THEN f.toms / f.strokes ELSE 0.0 END AS tom_share, coalesce(x.crash, false) AS cymbal_after, NOT f.keeps AND coalesce(most, false) AS timekeeping_drop, CASE WHEN coalesce(typical, 0) > 0 THEN greatest(0.0, least(1.0, (f.hits - typical) / typical)) ELSE 0.0 END AS density_rise FROM ft f LEFT JOIN nb USING (score_id, bar_number) LEFT JOIN ft x ON x.score_id = f.score_id AND x.bar_number = f.bar_number + 1),
sv AS (SELECT *, {R2("0.35 * novelty + 0.25 * tom_share + 0.2 * (CASE WHEN cymbal_after THEN 1.0 ELSE 0.0 END) + 0.1 * (CASE WHEN timekeeping_drop THEN 1.0 ELSE 0.0 END) + 0.1 * density_rise")} AS score FROM sg)
SELECT score_id, bar_number, score, {R2('novelty')} AS novelty, {R2('tom_share')} AS tom_share, cymbal_after, timekeeping_drop, {R2('density_rise')} AS density_rise FROM sv WHERE score >= 0.5""")
COMPLEX = f"""
dr AS (SELECT score_id, bar_number, count(DISTINCT drum) AS drums FROM ht GROUP BY ALL),
mv AS (SELECT score_id, bar_number, count(*) FILTER (d <> p) AS moves FROM (SELECT score_id, bar_number, array_to_string(drums, ',') AS d, lag(array_to_string(drums, ',')) OVER (PARTITION BY score_id, bar_number ORDER BY event_idx) AS p FROM ev WHERE NOT is_rest) GROUP BY ALL),
tg AS (SELECT score_id, bar_number, count(*) FILTER (len(list_intersect(drums, ['kick', 'hi_hat_pedal'])) > 0 AND len([x FOR x IN drums IF x NOT IN ('kick', 'hi_hat_pedal')]) > 0) AS together, count(*) FILTER (onset_ticks % 48 NOT IN (0, 24)) AS off FROM ev WHERE NOT is_rest GROUP BY ALL),
cs AS (SELECT b.score_id, b.bar_number, CASE WHEN hits > 0 THEN (least(1.0, hits / 16) + CASE b.n WHEN 16 THEN 0.75 WHEN 12 THEN 0.6 ELSE 0.4 END) / 2 ELSE 0.0 END AS subdivision_density, CASE WHEN hits > 0 THEN together / hits ELSE 0.0 END AS coordination, CASE WHEN hits > 0 THEN off / hits ELSE 0.0 END AS syncopation, CASE WHEN b.n = 12 THEN 0.34 ELSE 0.0 END AS rhythm_changes, CASE WHEN hits > 1 THEN (least(1.0, (drums - 1) / 5) + moves / (hits - 1)) / 2 ELSE 0.0 END AS drum_movement, greatest(0.0, least(1.0, (tempo_bpm - 60) / 140)) AS tempo FROM bh b JOIN sc USING (score_id) LEFT JOIN dr USING (score_id, bar_number) LEFT JOIN mv USING (score_id, bar_number) LEFT JOIN tg USING (score_id, bar_number)),
cx AS (SELECT *, CAST(floor(100 * (CAST(0.30 AS DOUBLE) * subdivision_density + CAST(0.25 AS DOUBLE) * coordination + CAST(0.15 AS DOUBLE) * syncopation + CAST(0.15 AS DOUBLE) * rhythm_changes + CAST(0.10 AS DOUBLE) * drum_movement + CAST(0.05 AS DOUBLE) * tempo) + 0.5) AS INT) AS score FROM cs),
cr AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY score DESC, bar_number) AS rank FROM cx)"""
say("an10_complexity", f"SELECT score_id, bar_number, score, rank, {', '.join(f'{R2(c)} AS {c}' for c in ('subdivision_density', 'coordination', 'syncopation', 'rhythm_changes', 'drum_movement', 'tempo'))} FROM cr", EVENTS + "," + COMPLEX)
say("an11_complex_passages", "SELECT score_id, min(bar_number) AS from_bar, max(bar_number) AS to_bar, max(score) AS score FROM (SELECT *, bar_number - row_number() OVER (PARTITION BY score_id ORDER BY bar_number) AS i FROM cr WHERE rank <= 3) GROUP BY score_id, i", EVENTS + "," + COMPLEX)
say("flagship", "r AS (SELECT score_id, bar_number, count(*) OVER (PARTITION BY score_id, pattern) AS copies FROM pt) SELECT score_id, bar_number, score, rank, coalesce(copies, 0) AS copies FROM cr LEFT JOIN r USING (score_id, bar_number) WHERE rank <= 3", EVENTS + "," + COMPLEX)
say("an13_practice_plan", """x AS (SELECT q.request_id FROM rq q JOIN bh b ON b.score_id = q.score_id AND b.bar_number BETWEEN q.from_bar AND q.to_bar GROUP BY ALL HAVING count(*) = 4)
SELECT request_id, score_id, step, title, CASE WHEN f IS NULL THEN 0 ELSE greatest(40, least(tempo_bpm, CAST(floor(tempo_bpm * f + 0.5) AS INT))) END AS bpm FROM rq JOIN x USING (request_id) JOIN sc USING (score_id), (VALUES (1, 'Count it', NULL), (2, 'Slow', CAST(0.6 AS DOUBLE)), (3, 'Loop', 0.8), (4, 'Connect', 0.8), (5, 'Full tempo', 1.0)) s(step, title, f)""")
say("an15_resolve_citations", "c AS (SELECT k AS citation_id, k // 50 AS score_id, k % 5 AS revision, 'b' || k AS f, 'b' || (k + 1) AS t FROM g) SELECT citation_id, c.score_id, CASE WHEN c.revision <> sc.revision THEN 'score has changed' WHEN a.bar_number IS NULL OR b.bar_number IS NULL THEN 'bars are gone' ELSE 'ok' END AS status, CASE WHEN c.revision = sc.revision AND b.bar_number IS NOT NULL THEN least(a.bar_number, b.bar_number) ELSE 0 END AS from_bar, CASE WHEN c.revision = sc.revision AND b.bar_number IS NOT NULL THEN greatest(a.bar_number, b.bar_number) ELSE 0 END AS to_bar FROM c JOIN sc USING (score_id) LEFT JOIN bm a ON a.score_id = c.score_id AND a.bar_id = f LEFT JOIN bm b ON b.score_id = c.score_id AND b.bar_id = t")
say("an16_bar_ranges", "SELECT score_id, min(bar_number) AS from_bar, max(bar_number) AS to_bar FROM (SELECT *, bar_number - row_number() OVER (PARTITION BY score_id ORDER BY bar_number) AS i FROM bm) GROUP BY score_id, i")
