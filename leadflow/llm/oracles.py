"""DuckDB SQL for the queries that SQL can express, written from the operators' rules."""

from __future__ import annotations

from . import licenses
from .quality_rules import RULES

_UP, _LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WS = r"[\x20\x09-\x0D]"

OP1 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^{_WS}+', ''), '{_WS}+$', ''), '{_UP}', '{_LO}') AS key
  FROM l),
shared AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
f AS (
  SELECT k.doc_id, pos, line, first_doc IS NOT NULL AND k.doc_id <> first_doc AS gone
  FROM k LEFT JOIN shared ON k.key = shared.key),
words AS (
  SELECT doc_id, (pos - 1) // 64 AS word, bit_or(CASE WHEN gone THEN 0::UBIGINT ELSE 1::UBIGINT << ((pos - 1) % 64) END) AS bits
  FROM f GROUP BY 1, 2 HAVING bool_or(gone))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256,
       coalesce((SELECT string_agg(printf('%d:%s', word, lower(lpad(hex(bits), 16, '0'))), ',' ORDER BY word) FROM words
                 WHERE words.doc_id = f.doc_id), '') AS keep_bitmap
FROM f GROUP BY doc_id
"""


def quality_sql(final: str) -> str:
    """Counts of every document, certified cutoffs and verdict; ``final`` reads view ``verdict``."""
    share = 0.05 / len(RULES)
    grid = ", ".join(f"('{r}', {c})" for r, cs in RULES.items() for c in cs)
    rate = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in RULES) + " END"
    return rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i,
         unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j+4], ' '))) AS s
  FROM d WHERE len(w) >= 5),
dup AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS r FROM dup GROUP BY doc_id),
c AS (
  SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper
  FROM d LEFT JOIN rep USING (doc_id)),
m AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_symbols / greatest(word_chars, 1) AS symbol_rate, n_dup_lines / greatest(n_lines, 1) AS dup_line_rate,
         n_repeat_words / greatest(n_words, 1) AS repeat_word_rate, n_upper / greatest(word_chars, 1) AS upper_rate
  FROM c),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT * FROM m JOIN good USING (doc_id) WHERE NOT base_failed),
grid(rule, cutoff) AS (VALUES {grid}),
t AS (
  SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE {rate} > cutoff) AS k
  FROM held CROSS JOIN grid GROUP BY lang, rule, cutoff),
tail AS (
  SELECT *, CASE WHEN k > n * {share} THEN 1.0 ELSE
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                                                      + i * ln({share}) + (n - i) * ln(1 - {share})))) END AS p
  FROM t),
cut AS (
  SELECT lang, rule, min(cutoff) AS cutoff FROM tail
  WHERE p * (SELECT count(*) FROM tail) <= 0.05 GROUP BY lang, rule),
verdict AS (
  SELECT m.*, NOT base_failed AND NOT EXISTS (
    SELECT 1 FROM cut WHERE cut.lang IS NOT DISTINCT FROM m.lang AND {rate} > cutoff) AS kept
  FROM m)
{final}
"""


OP10 = quality_sql("SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept "
                   "FROM verdict")

OP3 = r"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY source),
w AS (SELECT *, CASE WHEN size > 0 THEN pow(size::DOUBLE, 0.7) ELSE 0.0 END AS weight FROM sizes),
r AS (
  SELECT source, size, CASE WHEN size > 0 THEN (SELECT sum(size) FROM w)::DOUBLE * (weight / (SELECT sum(weight) FROM w)) / size
                            ELSE 1.0 END AS rate FROM w),
u AS (
  SELECT d.*, size, rate, ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
terms AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM r, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS t(k) WHERE size > 0),
c AS (
  SELECT u.*, CASE WHEN u.size = 0 THEN 1 ELSE (SELECT count(*) FROM terms
    WHERE terms.source IS NOT DISTINCT FROM u.source AND terms.cdf <= u.u) END AS copies FROM u)
SELECT doc_id, text, lang, source, n_chars, copies::INTEGER AS copies, copy::INTEGER AS copy,
       md5('42|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS shuffle_key
FROM c, unnest(range(1, copies + 1)) AS t(copy)
"""

OP4 = """
WITH n AS (SELECT *, row_number() OVER () AS r FROM embeddings),
v AS (
  SELECT r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM n
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.r, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""

OP12 = """
WITH n AS (SELECT *, row_number() OVER () AS r FROM embeddings),
v AS (
  SELECT r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM n
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT q.r AS a, q.vec_id AS anchor_id, c.r, c.vec_id, q.label = c.label AS same, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
p AS (
  SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r)::INTEGER AS positive_rank
  FROM s WHERE same QUALIFY positive_rank <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, positive_rank ORDER BY score DESC, vec_id, r)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM p JOIN s ON p.a = s.a AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def license_sql() -> str:
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licenses.known_sentences().items())
    steps = []
    for i, (name, seq) in enumerate(licenses.RULES):       # one step per ordered rule
        seq = quoted("".join(f"<{x}>" for x in seq))
        steps.append(f"r{i + 1} AS (SELECT * REPLACE (replace(l, {seq}, '') AS l, CASE WHEN contains(l, {seq}) AND NOT "
                     f"list_contains(found, {quoted(name)}) THEN list_append(found, {quoted(name)}) ELSE found END AS found) FROM r{i})")
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
s AS (
  SELECT doc_id, unnest(a) AS sentence, generate_subscripts(a, 1) AS pos FROM (
    SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '{licenses.SENTENCE_MARK}', '\\1' || chr(10), 'g'), chr(10)) AS a
    FROM documents)),
w AS (
  SELECT s.*, id FROM s LEFT JOIN known
    ON known.sentence = trim(regexp_replace(lower(s.sentence), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))
  WHERE regexp_matches(s.sentence, '{licenses.LICENSE_WORDS}')),
g AS (
  SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (WHERE id IS NULL) AS n_unknown,
         coalesce(string_agg(id, ' ' ORDER BY pos), '') AS sentence_ids,
         coalesce(string_agg('<' || id || '>', '' ORDER BY pos), '') AS l, []::VARCHAR[] AS found
  FROM w GROUP BY doc_id),
r0 AS (SELECT * FROM g),
{", ".join(steps)}
SELECT d.doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids,
       coalesce(array_to_string(found, ' '), '') AS licences,
       coalesce(len(l) - len(replace(l, '<', '')), 0)::BIGINT AS n_left, coalesce(n_unknown, 0)::BIGINT AS n_unknown
FROM documents d LEFT JOIN r{len(steps)} r USING (doc_id)
"""


ORACLES = {"op1_line_dedup": OP1.strip(), "op3_source_mixing": OP3.strip(), "op4_exact_topk": OP4.strip(),
           "op7_license_scan": license_sql().strip(), "op12_hard_negatives": OP12.strip(), "op10_quality_rules": OP10.strip()}
