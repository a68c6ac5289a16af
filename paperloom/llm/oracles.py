"""DuckDB SQL for the rows of the operators' queries, where SQL can express them."""

from __future__ import annotations

from paperloom.llm import secrets

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def flat_windows(n: int) -> str:
    """flat: the words of docs by place; windows: the n words from each place that has so many, joined by spaces."""
    ahead = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))])
    return f"""
flat AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM docs),
windows AS (SELECT * FROM (SELECT doc_id, pos AS s, {ahead} AS text FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE text IS NOT NULL)"""


WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), d AS (
  SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
         CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first_page
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to, TRUE AS verified
FROM d
"""

WINDOWS = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS words FROM documents),
{flat_windows(20)},
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY text ORDER BY doc_id, s) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS pos FROM again),
kept AS (
  SELECT f.doc_id, count(g.pos) AS n_removed, coalesce(string_agg(f.w, ' ' ORDER BY f.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.pos = g.pos GROUP BY f.doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

def jaccard(n: int, num: int, more: str = "") -> str:
    """Components of documents whose n-word shingles are alike by num hundredths."""
    return rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
),
{flat_windows(n)},
shingles AS (SELECT DISTINCT doc_id, text FROM windows UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM docs WHERE len(words) BETWEEN 1 AND {n - 1}),
sets AS (SELECT d.doc_id, coalesce(s.items, []) AS items FROM docs d LEFT JOIN (SELECT doc_id, list(text ORDER BY text) AS items FROM shingles GROUP BY doc_id) s ON d.doc_id = s.doc_id),
nodes AS (SELECT items, min(doc_id) AS node, len(items) AS n FROM sets WHERE len(items) > 0 GROUP BY items),
held AS (SELECT node, n, unnest(items) AS item FROM nodes),
pairs AS (
  SELECT a.node AS a, b.node AS b FROM held a JOIN held b ON a.item = b.item AND a.node < b.node AND 100 * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {num} * (a.n + b.n - count(*))
),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, root) AS (SELECT node, node FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.root = e.a),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, coalesce(r.root, s.doc_id) AS component_id{more}
FROM sets s LEFT JOIN nodes n ON s.items = n.items LEFT JOIN roots r ON n.node = r.node
"""


CHARS = r"""
  length(t0) - length(t1) AS letters, length(t1) - length(t2) AS digits, length(t2) - length(t3) AS spaces,
  length(t3) - length(t4) AS symbols, length(t4) - length(t5) AS marks, length(t5) AS others
"""
QUALITY = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS t0, lang, {WORDS} AS words FROM documents),
s1 AS (SELECT *, regexp_replace(t0, '\p{{L}}+', '', 'g') AS t1 FROM docs),
s2 AS (SELECT *, regexp_replace(t1, '\p{{N}}+', '', 'g') AS t2 FROM s1),
s3 AS (SELECT *, regexp_replace(t2, '[ \t\n\x0B\f\r]+', '', 'g') AS t3 FROM s2),
s4 AS (SELECT *, regexp_replace(t3, '[#*$%&|<>{{}}\[\]=^~_\\/+]+', '', 'g') AS t4 FROM s3),
s5 AS (SELECT *, regexp_replace(t4, '\p{{P}}+', '', 'g') AS t5 FROM s4),
chars AS (SELECT doc_id, lang, words, t0, [letters, digits, spaces, symbols, marks, others] AS c FROM (SELECT doc_id, lang, words, t0, {CHARS} FROM s5)),
short AS (SELECT doc_id, lang, lower(w) AS w FROM (SELECT doc_id, lang, unnest(words) AS w FROM docs) WHERE length(w) <= 4),
langs AS (SELECT DISTINCT lang, lang AS own FROM docs WHERE lang IS NOT NULL UNION ALL SELECT DISTINCT lang, NULL FROM docs),
ref_chars AS (
  SELECT l.own, list_transform([sum(c[1]), sum(c[2]), sum(c[3]), sum(c[4]), sum(c[5]), sum(c[6])], lambda x: x / greatest(sum(c[1] + c[2] + c[3] + c[4] + c[5] + c[6]), 1.0)) AS ref,
         CAST(sum(len(words)) AS DOUBLE) AS n
  FROM chars d JOIN langs l ON d.lang IS NOT DISTINCT FROM l.lang GROUP BY l.own
),
counted AS (SELECT l.own, w, count(*) AS v FROM short d JOIN langs l ON d.lang IS NOT DISTINCT FROM l.lang WHERE regexp_full_match(w, '\p{{L}}+') GROUP BY l.own, w),
common AS (SELECT own, w, v, row_number() OVER (PARTITION BY own ORDER BY v DESC, w) AS k FROM counted QUALIFY k <= 24),
refs AS (
  SELECT r.own, r.ref, coalesce(list(c.w ORDER BY c.k) FILTER (WHERE c.w IS NOT NULL), []) AS common, coalesce(list(c.v / greatest(r.n, 1.0) ORDER BY c.k) FILTER (WHERE c.w IS NOT NULL), []) AS q
  FROM ref_chars r LEFT JOIN common c ON r.own IS NOT DISTINCT FROM c.own GROUP BY r.own, r.ref, r.n
),
found AS (
  SELECT doc_id, list(n ORDER BY k) AS hits FROM (
    SELECT d.doc_id, c.k, count(s.w) AS n FROM docs d JOIN common c ON d.lang IS NOT DISTINCT FROM c.own LEFT JOIN short s ON s.doc_id = d.doc_id AND s.w = c.w GROUP BY d.doc_id, c.k
  ) GROUP BY doc_id
),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t0, chr(10))) AS x FROM docs) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
{flat_windows(8)},
twice AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, text) AS n FROM windows) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + 7)) AS pos FROM twice) GROUP BY doc_id),
facts AS (
  SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(length(array_to_string(d.words, '')) AS BIGINT) AS word_chars, length(d.t0) AS n_chars,
         CAST(len(regexp_extract_all(d.t0, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         list_transform(h.c, lambda x: x / length(d.t0)) AS p, r.ref,
         list_transform(coalesce(f.hits, []), lambda x: x / greatest(len(d.words), 1)) AS m, r.q
  FROM docs d JOIN chars h USING (doc_id) JOIN refs r ON d.lang IS NOT DISTINCT FROM r.own
  LEFT JOIN found f USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN cover c USING (doc_id)
),
shares AS (
  SELECT *, list_append(m, 1 - coalesce(list_sum(m), 0)) AS m1, list_append(q, 1 - coalesce(list_sum(q), 0)) AS q1 FROM facts
),
far AS (
  SELECT *, CASE WHEN n_chars >= 200 THEN sqrt(greatest(list_sum(list_transform(list_zip(p, ref), lambda x:
           (CASE WHEN x[1] > 0 THEN x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) ELSE 0 END + CASE WHEN x[2] > 0 THEN x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) ELSE 0 END) / 2)), 0)) END AS char_distance,
         CASE WHEN n_words >= 50 THEN sqrt(greatest(list_sum(list_transform(list_zip(m1, q1), lambda x:
           (CASE WHEN x[1] > 1e-12 THEN x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) ELSE 0 END + CASE WHEN x[2] > 1e-12 THEN x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) ELSE 0 END) / 2)), 0)) END AS word_distance
  FROM shares
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(char_distance, 0) <= 0.3 AND coalesce(word_distance, 0) <= 0.45 AS kept,
       round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM far
"""


def spans(kind: int, pattern: str, group: int = 0, least: int = 0, test: str = "TRUE") -> str:
    """Spans of one pattern: what lies between matches is what a split leaves."""
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {kind} AS k, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, length(hits[i]) AS n
FROM (SELECT doc_id, hits, parts, pieces, unnest(generate_series(1, len(hits))) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {group}) AS parts, string_split_regex(text, '{p}') AS pieces FROM docs) WHERE len(hits) > 0)
WHERE length(parts[i]) >= {least} AND {test}"""


SECRETS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (
{" UNION ALL ".join([
    spans(0, secrets.ASSIGN, 2, 6), spans(1, secrets.ACCESS, 0, 20), spans(2, secrets.HEX), spans(3, secrets.IDENT), spans(4, secrets.KEY),
    spans(5, secrets.RUN, test="regexp_full_match(hits[i], '" + secrets.TOKEN + "') AND regexp_matches(hits[i], '[0-9]') AND regexp_matches(hits[i], '[a-z]') AND regexp_matches(hits[i], '[A-Z]')"),
    spans(6, secrets.ENDPOINT),
])}
),
parts AS (SELECT doc_id, k, s, s + n AS e, CASE WHEN k IN (1, 3) THEN 'ident' WHEN k = 6 THEN 'endpoint' ELSE 'secret' END AS role FROM found),
base AS (SELECT * FROM parts WHERE k < 3),
weak AS (SELECT * FROM parts w WHERE k >= 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND w.s < b.e AND b.s < w.e)),
near AS (
  SELECT w.doc_id, w.k, w.s, w.e, w.role, bool_or(o.role = 'ident') AS ident, bool_or(o.role = 'secret') AS secret
  FROM weak w JOIN (SELECT * FROM base UNION ALL SELECT * FROM weak) o ON o.doc_id = w.doc_id AND o.role <> w.role AND o.s - w.e <= 400 AND w.s - o.e <= 400
  GROUP BY w.doc_id, w.k, w.s, w.e, w.role
),
said AS (
  SELECT doc_id, k, s, e FROM base
  UNION ALL SELECT doc_id, k, s, e FROM near WHERE CASE role WHEN 'ident' THEN secret WHEN 'secret' THEN ident ELSE ident AND secret END
),
named AS (SELECT *, [{", ".join(f"'{n}'" for n in (*secrets.BASE, *secrets.WEAK))}][k + 1] || ':' || s || ':' || e AS name FROM said)
SELECT d.doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
       sha256(coalesce(string_agg(name, ',' ORDER BY s, k, e) FILTER (WHERE k < 3), '')) AS base_sha256, coalesce(string_agg(name, ',' ORDER BY s, k, e), '') AS spans
FROM docs d LEFT JOIN named n ON d.doc_id = n.doc_id GROUP BY d.doc_id
"""

NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
  FROM rows a JOIN rows r ON len(a.x) = len(r.x) WHERE a.vec_id % 100 = 0 AND NOT (a.vec_id = r.vec_id AND a.label = r.label)
),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM scored WHERE same) WHERE k <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT * FROM ranked WHERE rank <= 5
"""

ORACLE: dict[str, str] = {
    "op3_warc_chain": WARC,
    "op5_secret_links": SECRETS,
    "op6_window_dedup": WINDOWS,
    "op7_quality_divergence": QUALITY,
    "op9_jaccard_join": jaccard(3, 90),
    "op11_hard_negatives": NEGATIVES,
    "op13_minhash_near": jaccard(5, 85, ", s.doc_id = coalesce(r.root, s.doc_id) AS kept"),
}
