"""DuckDB SQL for those corpus operators that SQL can express."""

from __future__ import annotations

from sluice.llm import mixing, quality

SPACE = r"[\x20\x09-\x0D]+"

WORDS = rf"""
words AS (
  SELECT d.rowid_, d.doc_id, w.word, w.i
  FROM docs d, LATERAL (
    SELECT unnest(l) AS word, generate_subscripts(l, 1) AS i
    FROM (SELECT list_filter(string_split_regex(d.text, '{SPACE}'), lambda x: x <> '') AS l)) w)
"""

DOCS = "docs AS (SELECT row_number() OVER () AS rowid_, doc_id, coalesce(text, '') AS text FROM documents)"

QUALITY_CTES = rf"""
{DOCS},
{WORDS},
hashed AS (
  SELECT rowid_, doc_id, i, word,
         list_reduce(list_prepend(0::BIGINT, list_transform(string_split(word, ''), lambda c: unicode(c)::BIGINT)),
                     lambda a, b: (a * {quality.BASE} + b) % 4294967296) AS h
  FROM words),
grams AS (
  SELECT rowid_, doc_id, h % {quality.BUCKETS} AS bucket FROM hashed
  UNION ALL
  SELECT rowid_, doc_id, (h * 1000003 + nxt * 7 + 1) % {quality.BUCKETS}
  FROM (SELECT rowid_, doc_id, h, lead(h) OVER (PARTITION BY rowid_ ORDER BY i) AS nxt FROM hashed) WHERE nxt IS NOT NULL),
trusted AS (
  SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id IS NOT NULL
  ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {quality.TARGET_ROWS}),
counts AS (
  SELECT bucket, count(*) AS raw, count(t.doc_id) AS target
  FROM grams g LEFT JOIN trusted t ON g.doc_id = t.doc_id GROUP BY bucket),
totals AS (SELECT sum(raw) + {quality.BUCKETS} AS raw_all, sum(target) + {quality.BUCKETS} AS target_all, sum(target) > 0 AS fitted FROM counts),
weights AS (
  SELECT bucket, CASE WHEN fitted THEN round(ln(((target + 1) / target_all) / ((raw + 1) / raw_all)) * 1e6)::BIGINT ELSE 0 END AS weight
  FROM counts, totals),
llr AS (SELECT rowid_, sum(weight)::BIGINT AS llr_sum_u, count(*) AS n_grams FROM grams JOIN weights USING (bucket) GROUP BY rowid_),
windows3 AS (
  SELECT rowid_, i, word || ' ' || b || ' ' || c AS win
  FROM (SELECT rowid_, i, word, lead(word, 1) OVER w AS b, lead(word, 2) OVER w AS c FROM words WINDOW w AS (PARTITION BY rowid_ ORDER BY i))
  WHERE c IS NOT NULL),
twice AS (SELECT rowid_, i FROM (SELECT rowid_, i, count(*) OVER (PARTITION BY rowid_, win) AS n FROM windows3) WHERE n > 1),
covered AS (
  SELECT rowid_, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT rowid_, i + unnest([0, 1, 2]) AS j FROM twice) GROUP BY rowid_),
base AS (
  SELECT d.rowid_, d.doc_id, d.text,
         coalesce((SELECT count(*) FROM words w WHERE w.rowid_ = d.rowid_), 0) AS n_words,
         length(regexp_replace(d.text, '{SPACE}', '', 'g')) AS word_chars,
         length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(d.text, chr(10)), lambda x: regexp_replace(x, '{SPACE}', '', 'g') <> ''))
           - len(list_distinct(list_filter(string_split(d.text, chr(10)), lambda x: regexp_replace(x, '{SPACE}', '', 'g') <> ''))) AS n_dup_lines
  FROM docs d),
verdicts AS (
  SELECT b.rowid_, b.doc_id, n_words, word_chars, n_symbols, n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
         coalesce(llr_sum_u, 0) AS llr_sum_u, coalesce(n_grams, 0) AS n_grams
  FROM base b LEFT JOIN covered c USING (rowid_) LEFT JOIN llr l USING (rowid_))
"""



def raking(docs: str, prefix: str = "m") -> str:
    """CTEs from rows (doc_id, source, lang, text) of `docs` to {prefix}_chances: doc_id, cell, tokens, probability, sampled."""
    d, T = mixing.DIMENSIONS, mixing.TEMPER
    out = f"""
{prefix}_docs AS (
  SELECT *, list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS ws FROM {docs}),
{prefix}_rows AS (
  SELECT doc_id, source, lang, greatest(len(ws), 1) AS tokens,
         (('0x' || substr(md5(coalesce(list_max(list_transform(ws, lambda w: {{'n': length(w), 'word': w}})).word, '')), 1, 8))::BIGINT % {mixing.TOPICS})::INTEGER AS topic
  FROM {prefix}_docs),
{prefix}_cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM {prefix}_rows GROUP BY ALL),
{prefix}_w AS (SELECT *, {", ".join(f"pow(sum(tokens) OVER (PARTITION BY {x}), {T}) / count(*) OVER (PARTITION BY {x}) AS w_{x}" for x in d)} FROM {prefix}_cells),
{prefix}_0 AS (SELECT source, lang, topic, tokens, tokens::DOUBLE AS fitted,
  {", ".join(f"sum(w_{x}) OVER (PARTITION BY {x}) / (SELECT sum(w_{x}) FROM {prefix}_w) * (SELECT sum(tokens) FROM {prefix}_w) AS goal_{x}" for x in d)} FROM {prefix}_w)"""
    body = f"{prefix}_r"
    for x in d:
        scaled = f"fitted * goal_{x} / sum(fitted) OVER (PARTITION BY {x})"
        step = "step + 1 AS step" if x == d[0] else "step"
        body = f"(SELECT {step}, source, lang, topic, tokens, {scaled} AS fitted, goal_source, goal_lang, goal_topic FROM {body if body.startswith('(') else body + f' WHERE step < {mixing.ROUNDS}'})"
    return out + f""",
{prefix}_r AS (SELECT 0 AS step, * FROM {prefix}_0 UNION ALL SELECT * FROM {body}),
{prefix}_last AS (SELECT * FROM {prefix}_r WHERE step = {mixing.ROUNDS}),
{prefix}_p AS (SELECT source, lang, topic, fitted / tokens / (SELECT max(fitted / tokens) FROM {prefix}_last) AS probability FROM {prefix}_last),
{prefix}_chances AS (
  SELECT r.*, p.probability,
         ('0x' || substr(md5(coalesce(r.doc_id::VARCHAR, '') || '#{mixing.SEED}'), 1, 12))::BIGINT::DOUBLE / {16**12}.0 < p.probability AS sampled
  FROM {prefix}_rows r JOIN {prefix}_p p ON r.source IS NOT DISTINCT FROM p.source AND r.lang IS NOT DISTINCT FROM p.lang AND r.topic = p.topic)"""


ORACLES = {
    "op1_quality_rules": f"""
WITH {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND llr_sum_u >= {quality.THRESHOLD_U} * n_grams AS kept, llr_sum_u, n_grams
FROM verdicts
""",
    "op10_source_mixing": f"""
WITH RECURSIVE {raking("documents")}
SELECT doc_id, source, lang, topic, tokens, round(probability, 9) AS probability, sampled FROM m_chances
""",
    "op12_prefix_trie": """
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS l FROM turns GROUP BY conv_id),
cuts AS (
  SELECT conv_id, l, conv_id - conv_id % 100 AS base,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, byte: list_reduce(
             list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 6 AS h
  FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.l, []), 1, h), list_slice(c.l, h + 1, len(c.l))) AS l
  FROM cuts c LEFT JOIN own b ON b.conv_id = c.base),
prefixes AS (
  SELECT conv_id, depth, list_slice(l, 1, depth) AS p, depth = len(l) AS ends
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS depth FROM rebuilt)),
nodes AS (
  SELECT p, depth, list_slice(p, 1, depth - 1) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
  FROM prefixes GROUP BY p, depth),
kids AS (SELECT above AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.p = k.p),
sums AS (
  SELECT p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT list_slice(p, 1, d) AS p, leaf, saved
        FROM (SELECT p, unnest(range(0, depth + 1)) AS d, (n_children = 0)::INT AS leaf,
                     CASE WHEN depth > 0 THEN (n_convs - 1) * length(p[depth].text) ELSE 0 END AS saved FROM counted))
  GROUP BY p)
SELECT n.conv_id, n.depth::BIGINT AS depth, CASE WHEN n.depth > 0 THEN a.conv_id END AS parent_conv_id, n.n_convs, n.n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN sums s ON n.p = s.p LEFT JOIN nodes a ON n.depth > 0 AND a.p = n.above
""",
    "unit_dedup_lines": f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM texts)),
placed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS start_ FROM lines),
units AS (
  SELECT doc_id, n, start_, line, translate(array_to_string(list_filter(string_split_regex(line, '{SPACE}'), lambda w: w <> ''), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key,
         row_number() OVER (PARTITION BY doc_id ORDER BY n) AS unit
  FROM placed WHERE regexp_replace(line, '{SPACE}', '', 'g') <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, n) > 1 AS again FROM units),
runs AS (
  SELECT doc_id, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run, n, (start_ + length(line) - length(regexp_replace(line, '^{SPACE}', '')))::BIGINT AS a, (start_ + length(line))::BIGINT AS b
  FROM ranked WHERE again),
spans AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM runs GROUP BY doc_id, run),
cut AS (SELECT s.*, text, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS before FROM spans s JOIN texts t ON t.doc_id = s.doc_id),
kept AS (
  SELECT doc_id, count(*) AS n, sum(b - a)::BIGINT AS chars, string_agg(a::VARCHAR || ':' || b::VARCHAR, ',' ORDER BY a) AS listed,
         string_agg(substr(text, before + 1, a - before), '' ORDER BY a) || substr(any_value(text), max(b) + 1) AS rest
  FROM cut GROUP BY doc_id)
SELECT t.doc_id, coalesce(n, 0) AS n_spans, coalesce(chars, 0) AS n_removed_chars, coalesce(listed, '') AS removed_spans, sha256(coalesce(rest, text)) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
""",
}
