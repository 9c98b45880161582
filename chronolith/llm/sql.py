"""DuckDB SQL for the queries that SQL can express."""

#: Rules of each text; shared with the pipeline's SQL.
RULES = r"""
SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines
FROM (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
      FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM {docs}))
"""

REPEATS = r"""
SELECT doc_id, count(*)::BIGINT AS n_repeat_words FROM (
  SELECT DISTINCT doc_id, p + o AS place
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
          SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(w[:-3]) AS a, unnest(w[2:-2]) AS b, unnest(w[3:]) AS c
          FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}) WHERE len(w) >= 3)),
       (VALUES (0), (1), (2)) AS off(o)
  WHERE n >= 2) GROUP BY doc_id
"""

#: The verdict needs the hosts' rates with the fitted prior: see quality_rules.host_rates.
OP10 = f"""
WITH base AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS suspect
  FROM (SELECT r.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM ({RULES.format(docs="documents")}) r LEFT JOIN ({REPEATS.format(docs="documents")}) x USING (doc_id))),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR suspect)::DOUBLE AS f FROM base GROUP BY source),
sums AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS h, sum(f * f / n) AS ffn, sum(n * n) AS nn,
           least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) AS m FROM hosts),
excess AS (SELECT m, CASE WHEN n - nn / n > 0 THEN (ffn - n * power(f / n, 2) - (h - 1) * m * (1 - m)) / (n - nn / n) ELSE 0 END AS e FROM sums),
prior AS (SELECT m, CASE WHEN e > 0 THEN least(greatest(m * (1 - m) / e - 1, 2.0), 1000.0) ELSE 1000.0 END AS s FROM excess),
rates AS (SELECT source, (f + m * s) / (n + s) AS rate, n + s AS k FROM hosts, prior),
sure AS (SELECT source, rate - 3 * sqrt(rate * (1 - rate) / (k + 1)) AS rate FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, suspect,
  NOT base_failed AND rate <= 0.5 AND NOT (suspect AND rate > 0.05) AS kept
FROM base JOIN sure ON sure.source IS NOT DISTINCT FROM base.source
"""

#: With :share, :weights and :docs for the pipeline's SQL; equal rows of a table would tie here.
MIX = """
WITH sized AS (
  SELECT doc_id, source, size,
    -ln((('0x' || left(md5('8:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(t)), 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)
      / ((size + 1)::DOUBLE / (size + len(regexp_extract_all(t, '[#*$%&|<>]')) + 1)) AS key
  FROM (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {docs})),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS i FROM sources),
weighed AS (SELECT *, ([5.0, 2.0, 1.0])[((i - 1) % 3 + 1)::INTEGER]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM ranked),
levels AS (SELECT *, cap / w AS ratio,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
chosen AS (SELECT arg_min(level, (ratio, i)) AS level FROM levels WHERE level <= ratio),
targets AS (SELECT source, source_size, coalesce(least(cap, c.level * w), cap) AS target,
    CASE WHEN source_size > 0 THEN least(floor(coalesce(least(cap, c.level * w), cap) / source_size), 3)::BIGINT ELSE 0 END AS epochs FROM levels, chosen c),
runs AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
gaps AS (SELECT source, max(rest) - coalesce(max(upto) FILTER (upto <= rest), 0) AS gap FROM runs GROUP BY source),
last AS (SELECT r.source, arg_min(doc_id, (abs(size - gap), key)) AS doc_id, min(abs(size - gap)) AS off, any_value(gap) AS gap
  FROM runs r JOIN gaps g ON r.source IS NOT DISTINCT FROM g.source WHERE upto > rest AND size > 0 GROUP BY r.source),
mixed AS (SELECT r.*, epochs + (upto <= rest OR coalesce(l.off < l.gap, false))::BIGINT AS copies
  FROM runs r LEFT JOIN last l ON r.source IS NOT DISTINCT FROM l.source AND r.doc_id = l.doc_id)
"""

OP8 = MIX.format(docs="documents") + "SELECT doc_id, source, size, source_size, target, (size * copies)::BIGINT AS taken FROM mixed"

#: Base 32 from SHA-1: of every 5 hexadecimal digits, 4 groups of 5 bits.
OP3 = """
WITH heads AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(sha1(coalesce(html, '')), 1 + 5 * (i // 4)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest
  FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS original FROM heads GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > original THEN original END AS refers_to
FROM heads JOIN firsts USING (payload_digest)
"""

OP4 = """
WITH turns AS (SELECT conv_id, turn, regexp_replace(coalesce(role, 'unknown'), '[<>|\\r\\n]', '_', 'g') AS speaker,
    replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS body FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
headed AS (SELECT t.*, perspective, speaker = perspective AS own,
    CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END AS header
  FROM turns t JOIN who w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
parts AS (SELECT *, '<|im_start|>' || header || chr(10) || body || '<|im_end|>' || chr(10) AS segment FROM headed),
placed AS (SELECT *, (sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(body) ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM parts)
SELECT conv_id, perspective, turn, speaker, segment, e - length(segment) AS "start", e AS "end",
  CASE WHEN own THEN e - length(segment) + 12 + length(header) + 1 END AS mask_start, CASE WHEN own THEN e - 1 END AS mask_end
FROM placed
"""
