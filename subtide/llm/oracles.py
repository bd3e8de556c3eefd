"""DuckDB statements of the queries that SQL can express; constants are stated here again on purpose."""

from __future__ import annotations

_MEASURES = """
words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS x
  FROM documents
),
windows AS (
  SELECT r, i, array_to_string(w[i : i + 4], ' ') AS s FROM words, unnest(range(1, len(w) - 3)) AS u(i)
),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
covered AS (
  SELECT r, sum(least(5, coalesce(next - i, 5))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM twice) GROUP BY r
),
measured AS (
  SELECT doc_id, stratum, len(w) AS n_words,
    CAST(list_sum(list_transform(w, lambda v: length(v))) AS BIGINT) AS word_chars_or_null,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    len(x) AS n_lines, len(x) - len(list_distinct(x)) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered USING (r)
),
features AS (
  SELECT *, coalesce(word_chars_or_null, 0) AS word_chars,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM measured
),
rules(rule, cutoff) AS (
  VALUES (1, 0.01), (1, 0.02), (1, 0.05), (1, 0.1), (1, 0.2), (1, 0.3),
    (2, 0.05), (2, 0.1), (2, 0.2), (2, 0.3), (2, 0.5), (3, 0.02), (3, 0.05), (3, 0.1), (3, 0.15),
    (4, 8.0), (4, 9.0), (4, 10.0), (4, 12.0), (4, 15.0), (4, 20.0)
),
valued AS (
  SELECT *, [coalesce(n_symbols / nullif(word_chars, 0), 0.0), coalesce(n_dup_lines / nullif(n_lines, 0), 0.0),
    coalesce(n_repeat_words / nullif(n_words, 0), 0.0), coalesce(word_chars / nullif(n_words, 0), 0.0)] AS v
  FROM features
),
marked AS (
  SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
),
counts AS (
  SELECT stratum, rule, CAST(cutoff AS DOUBLE) AS cutoff,
    count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad,
    count(*) FILTER (good AND v[rule] > cutoff) AS good, count(*) FILTER (NOT good AND v[rule] > cutoff) AS bad
  FROM valued JOIN marked USING (doc_id), rules WHERE NOT base_failed GROUP BY ALL
),
bounded AS (
  SELECT *, CASE WHEN good >= n_good * 0.005 THEN 1.0 ELSE list_sum(list_transform(range(0, good + 1), lambda j:
      exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln(0.005) + (n_good - j) * ln(0.995)))) END AS cdf,
    0.05 / ((SELECT count(DISTINCT stratum) FROM counts) * 21) AS level
  FROM counts
),
chosen AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM bounded
  WHERE cdf <= level AND bad * n_good > good * n_bad GROUP BY stratum, rule
),
picked AS (SELECT stratum, map(list(rule), list(cutoff)) AS c FROM chosen GROUP BY stratum)
"""

QUALITY = f"""
WITH {_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(v[1] > c[1], false) OR coalesce(v[2] > c[2], false)
    OR coalesce(v[3] > c[3], false) OR coalesce(v[4] > c[4], false)) AS kept
FROM valued LEFT JOIN picked USING (stratum)
"""

REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT r, doc_id, i, substring(h, 2 * i + 1, 100) AS s
  FROM d, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS u(i)
),
gone AS (SELECT r, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
marked AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 50, true) AS begins FROM gone),
numbered AS (SELECT r, i, sum(CAST(begins AS INT)) OVER (PARTITION BY r ORDER BY i) AS span FROM marked),
spans AS (SELECT r, span, min(i) AS lo, max(i) + 50 AS hi FROM numbered GROUP BY r, span),
gaps AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM spans),
kept AS (
  SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last,
    string_agg(substring(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head
  FROM gaps JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

CHAT = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
sized AS (
  SELECT *, 23 + length(role) + length(text)
    + len(regexp_extract_all(role, '[<\[]\\*(?:\||/?s>|/?INST\]|</?SYS>>)'))
    + len(regexp_extract_all(text, '[<\[]\\*(?:\||/?s>|/?INST\]|</?SYS>>)')) AS n
  FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def sharding(limit: int = 33554432) -> str:
    """Shards of buckets that bits can split down to the limit."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS m FROM documents
),
b AS (
  SELECT r, doc_id, n_bytes, array_to_string(list_transform(range(1, 16),
    lambda i: lpad(bin(CAST('0x' || substr(m, i, 1) AS INT)), 4, '0')), '') AS bits FROM d
),
n AS (SELECT r, doc_id, n_bytes, depth, substr(bits, 1, depth) AS prefix, bits FROM b, unnest(range(0, 41)) AS u(depth)),
s AS (
  SELECT *, sum(n_bytes) OVER (PARTITION BY depth, prefix) AS total, count(*) OVER (PARTITION BY depth, prefix) AS docs FROM n
)
SELECT doc_id, n_bytes, prefix, CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS page,
  CAST(total AS BIGINT) AS shard_bytes, docs AS shard_docs, n_bytes > {limit} AS oversize
FROM s WHERE total <= {limit} QUALIFY row_number() OVER (PARTITION BY r ORDER BY depth) = 1
"""


URLS = """
WITH RECURSIVE rested AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html,
    CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
),
given AS (
  SELECT r, page_id, html, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM rested
),
rules(suffix, start, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
),
ruled AS (
  SELECT r, page_id, host, path, suffix || start AS rule, verdict
  FROM given LEFT JOIN rules ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, start)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(suffix || start) DESC NULLS LAST, length(suffix) DESC) = 1
),
named AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html,
    '[ \\t\\n\\f\\r"''/](?:[hH][rR][eE][fF]|[sS][rR][cC])[ \\t\\n\\f\\r]*=[ \\t\\n\\f\\r]*["'']?(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"''<> \\t\\n\\f\\r]+)',
    1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM given
),
links AS (SELECT src, dst, count(*) AS w FROM named WHERE src <> '' AND src <> dst GROUP BY ALL),
both_ways AS (SELECT 'onward' AS way, src, dst, w FROM links UNION ALL SELECT 'back', dst, src, w FROM links),
arcs AS (SELECT *, sum(w) OVER (PARTITION BY way, src) AS total FROM both_ways),
seeds AS (
  SELECT host, count(*) AS pages, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'block') AS blocked
  FROM ruled WHERE host <> '' GROUP BY host
),
flow(k, way, host, marked, pages) AS (
  SELECT 0, 'onward', host, CAST(allowed * 1000000 AS HUGEINT), CAST(pages * 1000000 AS HUGEINT) FROM seeds
  UNION ALL SELECT 0, 'back', host, CAST(blocked * 1000000 AS HUGEINT), CAST(pages * 1000000 AS HUGEINT) FROM seeds
  UNION ALL
  SELECT k + 1, flow.way, dst, CAST(sum(marked * w * 85 // (total * 100)) AS HUGEINT), CAST(sum(pages * w * 85 // (total * 100)) AS HUGEINT)
  FROM flow JOIN arcs ON flow.way = arcs.way AND flow.host = arcs.src
  WHERE k < 32 AND pages > 0 GROUP BY k, flow.way, dst
),
ranks AS (
  SELECT host, sum(marked) FILTER (way = 'onward') AS t, sum(pages) FILTER (way = 'onward') AS t_all,
    sum(marked) FILTER (way = 'back') AS d, sum(pages) FILTER (way = 'back') AS d_all FROM flow GROUP BY host
)
SELECT page_id, ruled.host, path, rule,
  coalesce(verdict, CASE WHEN 100 * (d * t_all - t * d_all) >= 50 * (d_all * t_all) AND t_all > 0 AND d_all > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN ranks ON ruled.host = ranks.host
"""

DIVERGENCE = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
terms AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY ALL HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
sources AS (SELECT DISTINCT lang, source FROM d),
groups AS (SELECT lang, source, coalesce(total, 0) AS total FROM sources LEFT JOIN sums USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + 1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT) // (g.total + 5 * l.v) AS BIGINT) AS p,
    CAST(1 + 1000000000 * CAST(k.n + 5 AS HUGEINT) // (l.total + 5 * l.v) AS BIGINT) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((
    SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y USING (lang, term)
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
),
above AS (
  SELECT lang, source, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank
  FROM shares WHERE n > 0 AND p > q QUALIFY rank <= 50
)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT), CAST(rank AS INTEGER) FROM above
"""

ORACLES = {
    "op2_quality_rules": QUALITY,
    "op4_suffix_dedup": REPEATS,
    "op7_chat_format": CHAT,
    "op10_sharding": sharding(),
    "op11_source_divergence": DIVERGENCE,
    "op12_url_filter": URLS,
}
