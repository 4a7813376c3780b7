"""DuckDB SQL of the queries that SQL can express.

Media and language ID have none: crc32, LZW and a trained model are beyond it; tests hold them against plain versions."""

from __future__ import annotations

import public_tokenizers

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT *, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS chosen FROM p),
e AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('{ALPHABET}', (((('0x' || substr(h, (k // 4) * 5 + 1, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::BIGINT, 1)), '') AS digest FROM d),
r AS (SELECT *, chr(13) || chr(10) AS nl, 'WARC/1.1' || nl || 'WARC-Type: ' || CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END || nl || 'WARC-Record-ID: <urn:record:' || page_id || '>' || nl || 'WARC-Date: 1970-01-01T00:00:00Z' || nl
  || coalesce('WARC-Target-URI: ' || regexp_replace(url, '[\r\n]', '', 'g') || nl, '') || 'WARC-Payload-Digest: sha1:' || digest || nl
  || CASE WHEN page_id = chosen THEN 'Content-Length: ' || strlen(body) ELSE 'WARC-Refers-To: <urn:record:' || chosen || '>' || nl || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || nl || 'Content-Length: 0' END
  || nl || nl || CASE WHEN page_id = chosen THEN body ELSE '' END || nl || nl AS record FROM e)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> chosen THEN chosen END AS refers_to,
  strlen(record)::BIGINT AS record_bytes, sha256(record) AS record_sha256 FROM r"""

OP2 = f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
u AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)"""

OP5 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (h) WHERE lo < doc_id),
one AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM w),
k AS (SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p) AS t FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

OP6 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i : i + 9], ' ') AS h FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS h FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes)),
m AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.h = bw.h),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP7 = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))),
s AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS under,
  sum(12 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;')) + 1 + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + 11)::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(under) AS loss_chars, sha256(under) AS loss_sha256, formatted_chars FROM s"""

# The tokenizer's pattern has a look-ahead: of white space before other text the last character stands apart.  A private-use
# character marks that place; no text of the tables has it.
SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PIECES = rf"''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}\x{{E000}}]+|[{SPACE}]+"


def encoded(texts: str) -> str:
    """CTEs that encode the rows (doc_id, text) of a query: d has the pre-tokens ws, o the hexadecimal ids and decoded bytes."""
    return rf"""WITH RECURSIVE ranks AS (SELECT hex(from_base64(split_part(line, ' ', 1))) AS tok, split_part(line, ' ', 2)::BIGINT AS id FROM (SELECT unnest(string_split(content, chr(10))) AS line FROM read_text('{public_tokenizers.path("byte_bpe_50k.tiktoken")}')) WHERE line <> ''),
cuts AS (SELECT tok, id, unnest(range(1, length(tok) // 2)) AS i FROM ranks WHERE length(tok) > 2),
merges AS (SELECT a.id AS a, b.id AS b, c.id FROM cuts c JOIN ranks a ON a.tok = substr(c.tok, 1, 2 * i) JOIN ranks b ON b.tok = substr(c.tok, 2 * i + 1)),
d AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '([{SPACE}])([^{SPACE}])', chr(57344) || '\1\2', 'g'), '{PIECES}') AS ws FROM ({texts})),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM d),
w AS (SELECT word, hex(encode(word)) AS h, row_number() OVER () AS w FROM (SELECT DISTINCT word FROM p)),
bytes AS (SELECT w.w, u.i - 1 AS pos, substr(h, 2 * u.i - 1, 2) AS byte FROM w, LATERAL (SELECT unnest(range(1, length(h) // 2 + 1)) AS i) u WHERE h NOT IN (SELECT tok FROM ranks)),
s(w, pos, tok, it) AS (
  SELECT b.w, b.pos, r.id, 0 FROM bytes b JOIN ranks r ON r.tok = b.byte
  UNION ALL (
    WITH pairs AS (SELECT q.w, q.pos, q.tok, q.it, m.id, (m.id * 65536 + q.npos) * 65536 + q.pos AS key
      FROM (SELECT w, pos, tok, it, lead(pos) OVER (PARTITION BY w ORDER BY pos) AS npos, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM s) q LEFT JOIN merges m ON m.a = q.tok AND m.b = q.nxt),
    best AS (SELECT w, min(key) AS key FROM pairs WHERE key IS NOT NULL GROUP BY w)
    SELECT pairs.w, pos, CASE WHEN pos = best.key % 65536 THEN id ELSE tok END, it + 1 FROM pairs JOIN best ON best.w = pairs.w WHERE pos <> (best.key // 65536) % 65536)),
last AS (SELECT s.w, s.pos, s.tok AS id FROM s JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) z ON z.w = s.w AND z.it = s.it UNION ALL SELECT w, 0, id FROM w JOIN ranks ON tok = h),
e AS (SELECT w, string_agg(printf('%02X%02X%02X%02X', l.id & 255, (l.id >> 8) & 255, (l.id >> 16) & 255, (l.id >> 24) & 255), '' ORDER BY pos) AS ids, string_agg(r.tok, '' ORDER BY pos) AS decoded FROM last l JOIN ranks r ON r.id = l.id GROUP BY w),
o AS (SELECT doc_id, string_agg(ids, '' ORDER BY place) AS ids, string_agg(decoded, '' ORDER BY place) AS decoded FROM p JOIN w USING (word) JOIN e ON e.w = w.w GROUP BY doc_id)
"""


#: The three edits of each text.
EDITED = """SELECT doc_id, n, substr(t2, 1, n * 2 // 3) || substr(t2, n * 2 // 3 + 41) AS text FROM (
  SELECT doc_id, n, substr(t1, 1, n // 2) || chr(39) || 'll be' || chr(10) || chr(10) || '  replaced 2024' || substr(t1, n // 2 + 13) AS t2 FROM (
    SELECT doc_id, n, substr(t0, 1, n // 3) || ' some words put in' || substr(t0, n // 3 + 1) AS t1 FROM (SELECT doc_id, coalesce(text, '') AS t0, length(coalesce(text, '')) AS n FROM documents)))"""

OP3 = encoded(f"SELECT doc_id * 2 AS doc_id, text FROM documents UNION ALL SELECT doc_id * 2 + 1, text FROM ({EDITED})") + f"""SELECT b.doc_id // 2 AS doc_id, (length(coalesce(x.ids, '')) // 8)::BIGINT AS n_tokens, (length(coalesce(y.ids, '')) // 8)::BIGINT AS n_tokens_after, length(z.text)::BIGINT AS n_chars_after,
  sha256(z.text) AS text_after_sha256, len(a.ws)::BIGINT AS n_leaves FROM d b JOIN d a ON a.doc_id = b.doc_id + 1 AND b.doc_id % 2 = 0 JOIN ({EDITED}) z ON z.doc_id = b.doc_id // 2
LEFT JOIN o x ON x.doc_id = b.doc_id LEFT JOIN o y ON y.doc_id = a.doc_id"""

OP9 = encoded("SELECT doc_id, text FROM documents") + """SELECT d.doc_id, (length(coalesce(ids, '')) // 8)::BIGINT AS n_tokens, sha256(unhex(coalesce(ids, ''))) AS ids_sha256, sha256(unhex(coalesce(decoded, ''))) AS decoded_sha256 FROM d LEFT JOIN o USING (doc_id)"""

OP10 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' '))) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS both_of FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90 GROUP BY ALL),
e AS (SELECT a, b FROM j WHERE 100 * both_of >= 90 * (na + nb - both_of)),
r(n, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.a, r.m FROM r JOIN e ON e.b = r.n WHERE r.m < e.a),
c AS (SELECT n AS doc_id, min(m) AS component_id FROM r GROUP BY n),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links FROM s JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

SQL = {
    "op1_warc_archive": OP1, "op2_url_rules": OP2, "op3_token_counts": OP3, "op5_substring_dedup": OP5, "op6_decontamination": OP6, "op7_chat_format": OP7, "op9_byte_bpe": OP9, "op10_jaccard_join": OP10,
}
