"""The registered queries of this subpackage and their SQL where SQL expresses them."""

from __future__ import annotations

from veilspark.llm.bytedup import op9_bytes
from veilspark.llm.chat import op10_chat
from veilspark.llm.language import op5_language
from veilspark.llm.leaks import op2_leaks
from veilspark.llm.lines import op8_lines
from veilspark.llm.nearcopies import op6_near
from veilspark.llm.pieces import op3_pieces
from veilspark.llm.pii import op1_pii
from veilspark.llm.quality import op7_quality
from veilspark.llm.spans import op4_spans

QUERIES = {"op1_pii": op1_pii, "op2_leaks": op2_leaks, "op3_pieces": op3_pieces, "op4_spans": op4_spans, "op5_language": op5_language, "op6_near": op6_near, "op7_quality": op7_quality, "op8_lines": op8_lines, "op9_bytes": op9_bytes, "op10_chat": op10_chat}

_FORMATTED = """
WITH said AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, replace(text, '\\', '\\\\') AS a0, replace(role, '\\', '\\\\') AS b0 FROM said),
marked AS (
  SELECT *, regexp_replace(a0, _CONTROL, '\\\\\\1', 'g') AS a1, regexp_replace(b0, _CONTROL, '\\\\\\1', 'g') AS b1 FROM escaped)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(20 + length(a1) + length(b1)) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id, alone
""".replace("_CONTROL", r"'(<s>|</s>|\[ROLE\]|\[/ROLE\]|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<unk>)'")
_LEAKS = """
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
phrases AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
windows AS (
  SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM lowered, (SELECT DISTINCT k FROM phrases))),
hits AS (SELECT doc_id, i, k, item_id FROM windows JOIN phrases USING (phrase, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
owned AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
-- Near: 12 words in a row hold all words of a phrase, each as often; looked for around the phrase's rarest word.
terms AS MATERIALIZED (SELECT phrase, k, w, count(*) AS need FROM (SELECT DISTINCT phrase, k, unnest(string_split(phrase, ' ')) AS w, unnest(range(k)) AS at FROM phrases) GROUP BY phrase, k, w),
placed AS MATERIALIZED (SELECT doc_id, w, i FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM lowered) WHERE w IN (SELECT w FROM terms)),
often AS (SELECT w, count(*) AS n FROM placed GROUP BY w),
rarest AS (SELECT phrase, k, min_by(w, coalesce(n, 0)) AS w FROM terms LEFT JOIN often USING (w) GROUP BY phrase, k),
wanted AS (SELECT phrase, k, list(w) AS words, list(need) AS needs FROM terms GROUP BY phrase, k),
proposed AS MATERIALIZED (
  SELECT doc_id, phrase, k, i, words, needs, ws[greatest(i - 11, 1) : i + 11] AS span, greatest(i - 11, 1) AS lo
  FROM rarest JOIN placed USING (w) JOIN wanted USING (phrase, k) JOIN lowered USING (doc_id)),
possible AS MATERIALIZED (SELECT * FROM proposed WHERE list_has_all(span, words)),
started AS (SELECT doc_id, phrase, k, words, needs, span[s - lo + 1 : s - lo + 12] AS part FROM (SELECT *, unnest(range(lo, i + 1)) AS s FROM possible)),
counted AS (SELECT DISTINCT doc_id, phrase, k FROM started WHERE list_has_all(part, words)
  AND len(list_filter(range(1, len(words) + 1), lambda j: len(list_filter(part, lambda x: x = words[j])) < needs[j])) = 0),
close AS (SELECT doc_id, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near FROM (SELECT DISTINCT doc_id, item_id FROM counted JOIN phrases USING (phrase, k)) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM lowered LEFT JOIN covered USING (doc_id) LEFT JOIN owned USING (doc_id) LEFT JOIN close USING (doc_id)
"""
_SPANS = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM words)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
each_word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM words),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS joined
  FROM each_word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(joined, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
# Bytes as two hexadecimal digits each, so that substr() counts bytes.
_BYTES = """
WITH coded AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
pieces AS (SELECT doc_id, p, substr(h, 2 * p + 1, 698) AS h FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49, 300)) AS p FROM coded)),
strings AS MATERIALIZED (SELECT doc_id, p + i AS i, md5_number(substr(h, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, p, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS i FROM pieces)),
firsts AS (SELECT k, min(doc_id) AS least FROM strings GROUP BY k),
later AS (SELECT doc_id, i FROM strings JOIN firsts USING (k) WHERE least < doc_id),
ends AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM later),
spans AS (SELECT doc_id, sum(CASE WHEN before IS NULL OR i - before > 50 THEN 50 ELSE i - before END) AS n_removed, count(*) FILTER (before IS NULL OR i - before > 50) AS n_spans FROM ends GROUP BY doc_id),
runs AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM ends),
edges AS (SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM runs GROUP BY doc_id, run),
holes AS (SELECT doc_id, hi AS lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY run) AS hi FROM edges
  UNION ALL SELECT doc_id, 0, min(lo) FROM edges GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, CAST(length(h) / 2 AS BIGINT)) - lo)), '' ORDER BY lo) AS h FROM holes JOIN coded USING (doc_id) GROUP BY doc_id)
SELECT c.doc_id, CAST(length(c.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.h, c.h))) AS kept_sha256
FROM coded c LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
_NEAR = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM words UNION SELECT node, b FROM reach JOIN links ON seen = a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id, doc_id = least_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) JOIN (SELECT node, min(seen) AS least_id FROM reach GROUP BY node) ON node = doc_id
"""
_LINES = """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT doc_id, i, line, CAST('0x' || substr(md5(line), 1, 15) AS BIGINT) AS h FROM lines),
rolled AS (SELECT doc_id, i, line, h, xor(h, coalesce(lag(h, 1) OVER (PARTITION BY doc_id ORDER BY i), 0) << 1) AS h2 FROM hashed),
levels AS (
  SELECT doc_id, i, line, lv, ((CASE WHEN lv = 5 THEN h2 ELSE h END) >> (20 + lv)) & 1 = 0 AS ends FROM rolled, (SELECT unnest(range(6)) AS lv)),
numbered AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, lv ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM levels),
chunks AS (SELECT doc_id, min(i) AS place, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, lv, part HAVING count(*) > 1),
judged AS (SELECT doc_id, place, n, dense_rank() OVER (PARTITION BY chunk ORDER BY doc_id, place) > 1 AS gone FROM chunks),
lost AS (SELECT DISTINCT doc_id, unnest(range(place, place + n)) AS i FROM judged WHERE gone),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM lines ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id)
SELECT doc_id, n_lines, CAST(n_lines - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM sizes LEFT JOIN kept USING (doc_id)
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
ORACLE_SQL: dict[str, str] = {"op8_lines": _LINES, "op6_near": _NEAR, "op9_bytes": _BYTES, "op4_spans": _SPANS, "op2_leaks": _LEAKS, "op10_chat": _FORMATTED}
