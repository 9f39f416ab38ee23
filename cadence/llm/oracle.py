"""DuckDB SQL of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

OP1 = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
         (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0 AS coin
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE rk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
         sum(weight) OVER (ORDER BY cap / weight, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open_weight,
         sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS want
  FROM (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS rn FROM w)
), lv AS (
  SELECT coalesce(arg_min((want - taken) / open_weight, rn) FILTER (WHERE (want - taken) / open_weight * weight <= cap), max(cap / weight)) AS level FROM o
), t AS (
  SELECT source, source_size, CASE WHEN cap < level * weight THEN cap ELSE level * weight END AS target FROM w, lv
), r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

OP4 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(words[p:p + 19], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM w WHERE len(words) >= 20)
), late AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS rn FROM win) WHERE rn > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS pos FROM late
), each AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w
), kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.pos) AS kept, count(*) AS n
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP5 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), m AS (
  SELECT k.doc_id, k.pos, k.line, (f.key IS NOT NULL AND k.doc_id <> f.first_doc) AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


OP6 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), g AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND list_dot_product(x, x) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98
), r AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION
  SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a
), c AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
), n AS (
  SELECT a, count(*) AS n FROM e GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON vec_id = node LEFT JOIN n ON n.a = vec_id
"""

OP10 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(words[p:p + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS p FROM w WHERE len(words) >= 8)
), dup AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - p, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM dup) GROUP BY doc_id
), each AS (
  SELECT doc_id, line, length(line) AS chars, lower(line) AS low,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]')) AS ink,
         len(regexp_extract_all(line, '[#*$%&|<>!?=_~^\\]')) AS marks,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         len(regexp_extract_all(line, '[|»›•→]')) AS bars,
         len(regexp_extract_all(line, '\p{L}')) AS letters,
         len(regexp_extract_all(line, '\p{Lu}')) AS upper
  FROM (SELECT doc_id, unnest(lines) AS line FROM w)
), bad AS (
  SELECT doc_id, sum(chars) AS all_chars, coalesce(sum(chars) FILTER (WHERE
           NOT regexp_matches(line, '[\p{L}\p{N}]') OR marks * 100 > ink * 15 OR (n >= 5 AND upper * 100 > letters * 80)
           OR (bars >= 2 AND bars * 5 >= n)
           OR (n <= 40 AND (contains(low, 'all rights reserved') OR contains(low, 'cookie policy') OR contains(low, 'privacy policy')
               OR contains(low, 'terms of service') OR contains(low, 'terms of use') OR contains(low, 'enable javascript')
               OR contains(low, 'lorem ipsum') OR contains(low, 'click here') OR contains(low, 'sign up for our newsletter')))), 0) AS lost_chars
  FROM each GROUP BY doc_id
), c AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(all_chars, 0) AS all_chars, coalesce(lost_chars, 0) AS lost_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN bad USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (lost_chars * 100 > all_chars * 40) AS kept
FROM c
"""


OP12 = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(words) AS term FROM d) SEMI JOIN kept USING (lang, term)
  GROUP BY lang, source, term
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), gn AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0)::BIGINT AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source
), l AS (
  SELECT lang, term, sum(c)::BIGINT AS lc FROM c GROUP BY lang, term
), ln AS (
  SELECT lang, sum(lc)::BIGINT AS ln FROM l GROUP BY lang
), p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (n + 2 * v) AS p
  FROM gn JOIN kept k ON k.lang = gn.lang JOIN v ON v.lang = gn.lang
  LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term
), pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM (SELECT p.lang, source, p.term, p, 1 + (1000000000 * (lc + 2)) // (ln + 2 * v) AS q
        FROM p JOIN l ON l.lang = p.lang AND l.term = p.term JOIN ln ON ln.lang = p.lang JOIN v ON v.lang = p.lang WHERE c > 0)
  WHERE p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM terms
)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": OP1, "op4_substring_dedup": OP4, "op5_line_dedup": OP5, "op6_embedding_dedup": OP6, "op10_quality_rules": OP10, "op12_source_divergence": OP12}
