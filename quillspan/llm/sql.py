"""DuckDB SQL for the operators that SQL can express, over the whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALPHABET = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

WARC = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) ELSE page_id END AS owner FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN owner = page_id THEN NULL ELSE owner END AS refers_to FROM g
"""

TOPK_SEARCH = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT k, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS h FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 34)) AS i)
), again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT k, list_distinct(flatten(list(generate_series(i, i + 34)))) AS gone FROM win SEMI JOIN again USING (h) GROUP BY k),
kept AS (
  SELECT k, doc_id, len(w) AS n, coalesce(len(gone), 0) AS g,
    array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_sort(list_where(range(1, len(w) + 1), list_transform(range(1, len(w) + 1), lambda x: x NOT IN gone)))) END, ' ') AS t
  FROM d LEFT JOIN hit USING (k)
)
SELECT doc_id, n::BIGINT AS n_words, g::BIGINT AS n_removed, sha256(t) AS kept_sha256 FROM kept
"""

URL_FILTERS = f"""
WITH cut AS (
  SELECT page_id, row_number() OVER () AS k, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, k, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_ALPHABET[0]}', '{_ALPHABET[1]}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(h, p, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), met AS (
  SELECT k, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS n
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM met WHERE n = 1) m USING (k)
"""

MIXING = f"""
WITH t AS (SELECT doc_id, source, len({_WORDS}) AS size, md5(coalesce(text, '')) AS h FROM documents
), d AS (
  SELECT *, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || h), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM t
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         2.0 * sum(size)::DOUBLE AS cap FROM d GROUP BY source
), lev AS (
  SELECT *, cap / w AS r,
    (1.5 * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM s
), wat AS (SELECT arg_min(level, r) AS water FROM lev WHERE level <= r), g AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, w * water) END AS target FROM lev, wat
), f AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g
), q AS (
  SELECT *, target - whole * source_size AS rest FROM f
), tried AS (
  SELECT source, size, (rest - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(n * size * sqrt(size)) OVER (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING) AS lv
  FROM (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size) c JOIN (SELECT source AS k, rest FROM q) ON source IS NOT DISTINCT FROM k
), lam AS (SELECT source, arg_max(lv, size) AS lv FROM tried WHERE lv * sqrt(size) <= 1 GROUP BY source
), odds AS (
  SELECT d.*, q.source_size, q.target, q.whole, q.rest, least(1.0, coalesce(lam.lv, 0.0) * sqrt(size)) AS p
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN lam ON d.source IS NOT DISTINCT FROM lam.source
), ranked AS (
  SELECT *, CASE WHEN p >= 1 THEN 0.0 WHEN p <= 0 THEN 1.0 ELSE u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS v FROM odds
), sums AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY v, u, size, h, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked
), inside AS (
  SELECT *, size > 0 AND before + size / 2.0 <= rest AS more FROM sums
), open AS (
  SELECT *, rest - coalesce(sum(CASE WHEN more THEN size END) OVER (PARTITION BY source), 0) AS gap FROM inside
), near AS (
  SELECT *, row_number() OVER (PARTITION BY source, more OR size = 0 ORDER BY abs(gap - size), v, u, size, h, doc_id NULLS FIRST) AS place FROM open
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  CASE WHEN size > 0 THEN (least(whole + (more OR (place = 1 AND gap > 0 AND abs(gap - size) < gap))::INT, 2) * size)::BIGINT ELSE 0 END AS taken
FROM near
"""

QUALITY_RULES = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, -9223372036854775808) AS id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text,
         {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 2)) AS i)
), twice AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM grams) WHERE n > 1
), rep AS (
  SELECT k, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) o(j) GROUP BY k
), each_line AS (
  SELECT k, id, host, text, unnest(list_transform(lines, lambda x: trim(regexp_replace(lower(x), '[\\x20\\x09-\\x0D]+', ' ', 'g')))) AS line FROM d
), over_limit AS (
  SELECT host, line, min(id) AS first_id FROM each_line JOIN (SELECT host, count(DISTINCT text) AS n_host FROM d GROUP BY host) USING (host)
  GROUP BY host, line HAVING count(DISTINCT text) > 5 AND count(DISTINCT text) > 0.02 * any_value(n_host)
), lost AS (
  SELECT k, sum(len(string_split(line, ' '))) AS n FROM each_line JOIN over_limit USING (host, line) WHERE id <> first_id GROUP BY k
), st AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_line_words_removed
  FROM d LEFT JOIN rep USING (k) LEFT JOIN lost USING (k)
)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_line_words_removed >= 0.5 * n_words AS kept
FROM st
"""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n_chars DESC, doc_id NULLS LAST)
"""

ORACLES = {"op3_warc": WARC, "op4_topk_search": TOPK_SEARCH, "op6_substring_dedup": SUBSTRING_DEDUP, "op8_url_filters": URL_FILTERS, "op9_mixing": MIXING, "op10_quality_rules": QUALITY_RULES, "op12_exact_dedup": EXACT_DEDUP}
