"""DuckDB SQL of the queries that SQL can express.

The others are held against plain versions in tests/llm: their hash, tokenizer,
regex rules, graph, genetic search or fitted model has no SQL form.
"""

from __future__ import annotations

_LOWER = "translate(COALESCE({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# 20 bits at a time: five hex digits are four base32 digits
_QUAD = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(CAST('0x' || substr(sha, 5 * i + 1, 5) AS BIGINT) >> {s} & 31 "
    f"AS BIGINT), 1)" for s in (15, 10, 5, 0))

ORACLES: dict[str, str] = {
    "op1_warc": f"""
WITH p AS (
  SELECT page_id, strlen(COALESCE(html, '')) AS bytes, sha1(COALESCE(html, '')) AS sha,
         MAX(page_id) OVER (PARTITION BY COALESCE(html, '')) AS kept
  FROM pages)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda i: {_QUAD}), '') AS payload_digest,
       CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < kept THEN kept END AS refers_to
FROM p""",
    "op4_decontamination": f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format('text')} AS w FROM benchmark),
pattern AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS words
  FROM (SELECT item_id, w, LEAST(10, len(w)) AS n, unnest(range(1, len(w) - LEAST(10, len(w)) + 2)) AS s
        FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
place AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, (SELECT DISTINCT n FROM pattern))),
occurrence AS (SELECT doc_id, n, s, item_id FROM place JOIN pattern USING (n, words)),
hit AS (SELECT doc_id, COUNT(DISTINCT spot) AS n_hit
        FROM (SELECT doc_id, unnest(range(s, s + n)) AS spot FROM occurrence) GROUP BY doc_id),
named AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT doc_id, item_id FROM occurrence) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op12_spelling": """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda r, i:
           CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, b)) AS step),
run AS (
  SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS id, translate(
           unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
byte AS (
  SELECT run, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
           CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END)) AS bytes
  FROM run),
hashed AS (
  SELECT run, xor(list_reduce(bytes, lambda h, b: xor(h >> 8, step[(xor(h, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM (SELECT run, list_transform(bytes, lambda b: CAST(b AS BIGINT)) AS bytes FROM byte), crc),
word AS (
  SELECT word, COUNT(*) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
        FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING COUNT(*) >= 2),
cut AS (SELECT word, n, place, word[1:place - 1] || word[place + 1:] AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM word)),
pair AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.place = b.place AND a.rest = b.rest
  WHERE a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN word w ON c.rest = w.word
  UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN word w ON c.rest = w.word),
top AS (
  SELECT word, n, COUNT(*) AS n_near, MAX(near_n) AS near_n, arg_min(near, (-near_n, near)) AS near
  FROM pair GROUP BY word, n),
named AS (
  SELECT w.word, w.n, CASE WHEN t.near_n >= 10 * w.n THEN t.near END AS form,
         CASE WHEN t.near_n >= 10 * w.n THEN t.near_n END AS form_n, COALESCE(t.n_near, 0) AS n_near
  FROM word w LEFT JOIN top t USING (word)),
chain AS (
  SELECT word, word AS root FROM named
  UNION ALL SELECT c.word, f.form FROM chain c JOIN named f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT named.word, form, root, n, n_near, form_n
FROM named JOIN chain ON chain.word = named.word
WHERE root NOT IN (SELECT word FROM named WHERE form IS NOT NULL)""",
    "op8_tool_calls": """
WITH call AS (
  SELECT conv_id, turn, text, length(text) AS size,
         ROW_NUMBER() OVER (PARTITION BY conv_id, turn % 2, turn = 0 ORDER BY turn) AS k
  FROM (SELECT conv_id, turn, role, COALESCE(text, '') AS text FROM conversations) WHERE role = 'assistant'),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, turn % 2, turn = 0, turn // 2 - k ORDER BY turn) - 1 AS depth
  FROM call),
result AS (
  SELECT conv_id, turn, COALESCE(text, '') AS text FROM conversations WHERE role = 'user' AND turn > 0),
told AS (
  SELECT c.*, CASE WHEN c.turn >= 3 THEN 'call-' || (c.turn - 2) END AS after, r.turn IS NOT NULL AS answered,
         c.turn < 3 OR d.turn IS NOT NULL AS based
  FROM ranked c LEFT JOIN result r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
                LEFT JOIN call d ON d.conv_id = c.conv_id AND d.turn = c.turn - 2)
SELECT conv_id, 'call-' || turn AS call_id, 'call' AS kind, turn, CAST(2 * depth AS BIGINT) AS level,
       answered AS linked,
       CASE WHEN size % 2 = 0 AND size NOT BETWEEN 1 AND 1000 THEN '$.limit: out of bounds'
            WHEN NOT answered THEN 'missing result' WHEN NOT based THEN 'missing dependency' END AS error,
       '{"after":' || COALESCE('"' || after || '"', 'null') || ',"role":"assistant","tool_call":{"arguments":{' ||
       CASE WHEN size % 2 = 0 THEN '"limit":' || size || ',"query":' || CAST(to_json(text) AS VARCHAR)
            ELSE '"page":' || size || ',"text":' || CAST(to_json(text) AS VARCHAR) END ||
       COALESCE(',"uses":"' || after || '"', '') || '},"id":"call-' || turn || '","name":"' ||
       CASE WHEN size % 2 = 0 THEN 'search' ELSE 'open' END || '"}}' AS message
FROM told
UNION ALL
SELECT r.conv_id, 'call-' || (r.turn - 1), 'result', r.turn, CAST(2 * c.depth + 1 AS BIGINT), c.turn IS NOT NULL,
       CASE WHEN c.turn IS NULL THEN 'missing call' END,
       '{"content":' || CAST(to_json(r.text) AS VARCHAR) || ',"role":"tool","tool_call_id":"call-' || (r.turn - 1) || '"}'
FROM result r LEFT JOIN ranked c ON c.conv_id = r.conv_id AND c.turn = r.turn - 1
UNION ALL
SELECT conv_id, NULL, 'message', turn, NULL, false, NULL,
       '{"content":' || CAST(to_json(COALESCE(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}'
FROM conversations
WHERE role IS DISTINCT FROM 'assistant' AND NOT (role IS NOT DISTINCT FROM 'user' AND COALESCE(turn > 0, false))""",
}
