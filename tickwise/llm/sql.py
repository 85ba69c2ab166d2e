"""DuckDB twins of the queries that SQL can express on whole tables."""

from __future__ import annotations

from tickwise.llm.url_filter import ALPHABET, ORDER

# The rules of the registered query.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_WORDS = r"[x FOR x IN regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']"

DECONTAM_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(text="text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, unnest([array_to_string(w[i : i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS gram FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM g),
p AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, unnest([array_to_string(w[i : i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS gram FROM d, sizes WHERE len(w) >= size),
h AS (SELECT p.doc_id, p.i, p.size, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.size = g.size),
k AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(k.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def url_sql(rules=URL_RULES) -> str:
    longest_last = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in reversed(longest_last)) + " END"
    ctes = [
        "u0 AS (SELECT page_id, CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "u1 AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM u0)",
        "u2 AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(h) + 1), '^[^?#]*') AS path FROM u1)",
        f"u AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS act, host || path AS txt FROM u2)",
        "t AS (SELECT txt, count(*) FILTER (act = 'allow') AS a, count(*) FILTER (act = 'block') AS r, substring(md5(txt), 1, 1) IN ('0', '1', '2') AS held FROM u WHERE txt <> '' GROUP BY txt)",
        f"e AS (SELECT txt, a, r, held, unnest([substring(repeat(chr(2), {ORDER - 1}) || txt || chr(3), i, {ORDER}) FOR i IN range(1, length(txt) + 2)]) AS gram FROM t)",
        f"c{ORDER} AS (SELECT gram, sum(CASE WHEN held THEN 0 ELSE a END) AS a, sum(CASE WHEN held THEN 0 ELSE r END) AS r FROM e GROUP BY gram)",
    ]
    for k in range(ORDER - 1, 0, -1):
        ctes.append(f"c{k} AS (SELECT substring(gram, 2) AS gram, sum(a) AS a, sum(r) AS r FROM c{k + 1} GROUP BY 1)")
    for k in range(1, ORDER + 1):
        ctes.append(f"x{k} AS (SELECT substring(gram, 1, {k - 1}) AS ctx, sum(a) AS na, count(*) FILTER (a > 0) AS ta, sum(r) AS nr, count(*) FILTER (r > 0) AS tr FROM c{k} GROUP BY 1)")
        low = (f"{1 / ALPHABET!r}", f"{1 / ALPHABET!r}", "") if k == 1 else ("q.pa", "q.pr", f"JOIN p{k - 1} q ON q.gram = substring(c.gram, 2)")
        ctes.append(f"p{k} AS (SELECT c.gram, CASE WHEN na = 0 THEN {low[0]} ELSE (c.a + ta * {low[0]}) / (na + ta) END AS pa, CASE WHEN nr = 0 THEN {low[1]} ELSE (c.r + tr * {low[1]}) / (nr + tr) END AS pr FROM c{k} c JOIN x{k} x ON x.ctx = substring(c.gram, 1, {k - 1}) {low[2]})")
    ctes += [
        f"s AS (SELECT txt, any_value(e.a) AS a, any_value(e.r) AS r, any_value(held) AS held, round(avg(ln(pa) - ln(pr)), 9) AS score FROM e JOIN p{ORDER} p USING (gram) GROUP BY txt)",
        "m AS (SELECT sum(a * score) / nullif(sum(a), 0) AS ma, sum(r * score) / nullif(sum(r), 0) AS mr, sum(a * score * score) / nullif(sum(a), 0) AS qa, sum(r * score * score) / nullif(sum(r), 0) AS qr FROM s WHERE held)",
        "v AS (SELECT ma, mr, sqrt(greatest(qa - ma * ma, 0)) AS sa, sqrt(greatest(qr - mr * mr, 0)) AS sr FROM m)",
        "h AS (SELECT CASE WHEN ma IS NULL OR mr IS NULL THEN 0 WHEN sa + sr > 0 THEN round((ma * sr + mr * sa) / (sa + sr), 6) ELSE round((ma + mr) / 2, 6) END AS threshold FROM v)",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT u.page_id, u.host, u.path, u.rule, coalesce(u.act, CASE WHEN s.score IS NULL OR s.score >= (SELECT threshold FROM h) THEN 'allow' ELSE 'block' END) AS verdict FROM u LEFT JOIN s USING (txt)"


def merkle_sql(height: int = 11) -> str:
    """The trees level by level, `height` of them: enough for 8 ** height rows of one language."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # CRC-32 of the digits of doc_id: eight steps for the bits of each byte, folded over lists.
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, (s & 1) * 3988292384))))"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"l AS (SELECT doc_id, coalesce(':' || lang, '') AS tree, {leaf('text')} AS leaf, {leaf(f'CASE WHEN {crc} % 3 = 0 THEN {low} ELSE text END')} AS fake FROM documents)",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM l)",
        "t0 AS (SELECT tree, place, n, leaf AS d FROM n0)",
    ]

    def climb(name: str) -> None:
        for k in range(1, height + 1):
            ctes.append(f"{name}{k} AS (SELECT tree, place // 8 AS place, any_value((n + 7) // 8) AS n, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY place)) END AS d FROM {name}{k - 1} GROUP BY tree, place // 8)")
            # the siblings before and after a node, where the level above is another one
            ctes.append(f"s{name}{k - 1} AS (SELECT tree, place, CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(d, '') OVER (PARTITION BY tree, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS p, CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(d, '') OVER (PARTITION BY tree, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS q, n FROM {name}{k - 1})")

    climb("t")
    ctes.append(f"r0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY t{height}.tree) - 1 AS place, count(*) OVER () AS n, d FROM t{height})")
    ctes.append(f"names AS (SELECT tree AS name, row_number() OVER (ORDER BY tree) - 1 AS top, d AS subroot FROM t{height})")
    climb("r")
    ctes.append(f"f0 AS (SELECT n0.doc_id, n0.tree, n0.place, names.top, n0.leaf, names.subroot, (SELECT d FROM r{height}) AS root, '' AS proof, fake AS x FROM n0 JOIN names ON n0.tree = names.name)")
    step = 0
    for name, key in (("t", "f.tree"), ("r", "''")):
        for k in range(height):
            spot = f"f.{'place' if name == 't' else 'top'} // {8**k}"
            ctes.append(f"f{step + 1} AS (SELECT f.* REPLACE (f.proof || s.p || s.q AS proof, CASE WHEN s.n = 1 THEN f.x ELSE sha256(s.p || f.x || s.q) END AS x) FROM f{step} f JOIN s{name}{k} s ON s.tree = {key} AND s.place = {spot})")
            step += 1
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified FROM f{step}"


def phrases_sql(support: int = 100, most: int = 2000) -> str:
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, unnest([array_to_string(w[i : i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size),
c AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS a FROM g GROUP BY lang, phrase HAVING count(*) >= {support}),
k AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS w FROM c WHERE size > 1),
x AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(w[1 : size - 1], ' ') AS phrase, a FROM k WHERE size > 2 UNION ALL SELECT lang, array_to_string(w[2 : size], ' '), a FROM k WHERE size > 2) GROUP BY lang, phrase),
q AS (SELECT k.lang, k.phrase, k.a, unnest(range(1, size)) AS cutting, w, size FROM k LEFT JOIN x USING (lang, phrase) WHERE x.longer IS NULL OR 100 * x.longer < 100 * k.a),
s AS (SELECT q.lang, q.phrase, q.a, q.cutting, l.a AS l, r.a AS r, n.n, (1000 * q.a::HUGEINT * n.n) // (l.a::HUGEINT * r.a) AS score FROM q JOIN c l ON l.lang = q.lang AND l.phrase = array_to_string(q.w[1 : q.cutting], ' ') JOIN c r ON r.lang = q.lang AND r.phrase = array_to_string(q.w[q.cutting + 1 : q.size], ' ') JOIN n ON n.lang = q.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cutting) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= {most}
"""
