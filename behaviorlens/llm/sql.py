"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_FILTER = rf"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
part AS (
  SELECT page_id, url, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
list AS (SELECT host, coalesce(bool_or(contains(url, 'utm_')), false) AS listed FROM part GROUP BY host),
ruled AS (
  SELECT page_id, host, path, listed,
         CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM part JOIN list USING (host))
SELECT page_id, host, path, rule, listed,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

CHAT_WINDOWS = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
         len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D\x20]')) AS n
  FROM given),
sized AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto,
         i = 1 AND role = 'system' AS system,
         length('[TURN ]') + length('[/TURN]')
         + length(replace(replace(replace(replace(role, '␛', '␛e'), '<', '␛a'), '[', '␛l'), ']', '␛b'))
         + length(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '␛', '␛e'),
             '<s>', '␛as>'), '</s>', '␛a/s>'), '<<SYS>>', '␛a<SYS>>'), '<</SYS>>', '␛a</SYS>>'),
             '[INST]', '␛lINST]'), '[/INST]', '␛l/INST]'), '[TURN ', '␛lTURN '), '[/TURN]', '␛l/TURN]')) AS chars
  FROM numbered),
room AS (
  SELECT conv_id, greatest(1, 256 - 64 - coalesce(sum(n) FILTER (WHERE system), 0)) AS room, bool_or(system)::INT AS first
  FROM sized GROUP BY conv_id),
packed AS (
  SELECT conv_id, i, 0 AS w, CASE WHEN system THEN 0 ELSE n END AS used, room, first
  FROM sized JOIN room USING (conv_id) WHERE i = 1
  UNION ALL
  SELECT p.conv_id, s.i, CASE WHEN p.used + s.n > room AND p.i > first THEN w + 1 ELSE w END,
         CASE WHEN p.used + s.n > room AND p.i > first THEN s.n ELSE p.used + s.n END, room, first
  FROM packed p JOIN sized s ON s.conv_id = p.conv_id AND s.i = p.i + 1),
opened AS (SELECT conv_id, w, min(i) AS i FROM packed GROUP BY conv_id, w),
held AS (
  SELECT conv_id, sum(chars) AS chars FROM (
    SELECT p.conv_id, s.chars FROM packed p JOIN sized s USING (conv_id, i)
    UNION ALL
    SELECT o.conv_id, s.chars FROM opened o JOIN sized f USING (conv_id, i) JOIN sized s ON s.conv_id = o.conv_id AND s.i < o.i
    WHERE s.system OR (f.upto - f.n) - (s.upto - s.n) <= 64) GROUP BY conv_id),
counted AS (SELECT conv_id, count(*) AS windows FROM opened GROUP BY conv_id),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       (chars + 7 * windows)::BIGINT AS formatted_chars
FROM whole JOIN held USING (conv_id) JOIN counted USING (conv_id)
"""

COMPONENTS = """
reach(id, other) USING KEY (id) AS (
  SELECT id, id AS other FROM node
  UNION
  SELECT l.b, min(r.other) FROM reach r JOIN link l ON l.a = r.id JOIN recurring.reach c ON c.id = l.b
  WHERE r.other < c.other GROUP BY l.b)"""

NGRAM_JOIN = rf"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM word WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
node AS (SELECT DISTINCT doc_id AS id FROM documents),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
  WHERE 100 * c >= 90 * (p.n + q.n - c)),
{COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, other AS component_id
FROM documents LEFT JOIN size USING (doc_id) JOIN reach ON reach.id = doc_id
"""

SUBSTRING_DEDUP = r"""
WITH word AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM word WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
hit AS (SELECT doc_id, list(i) AS starts FROM win JOIN first USING (h) WHERE d < doc_id GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM word),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM (SELECT doc_id, unnest(starts) AS i FROM hit)),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text, count(*) AS n
  FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM word LEFT JOIN kept k USING (doc_id)
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE node AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
link AS (
  SELECT x.id AS a, y.id AS b FROM node x JOIN node y ON x.label = y.label AND x.id <> y.id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
degree AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a),
{COMPONENTS}
SELECT node.id AS vec_id, coalesce(n, 0) AS n_links, other AS component_id, node.id = other AS kept
FROM node LEFT JOIN degree USING (id) JOIN reach USING (id)
"""

LINE_DEDUP = rf"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, {LOWER.format(f"trim(line, {WHITE})")} AS key FROM line),
often AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (
  SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

LEXICAL_SEARCH = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
doc AS (SELECT row_number() OVER () AS r, doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
stat AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM doc),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
posting AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM doc)
  SEMI JOIN (SELECT DISTINCT term FROM asked) USING (term) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM posting, stat GROUP BY term),
part AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))) AS part
  FROM posting JOIN weight USING (term), stat),
scored AS (SELECT item_id, r, doc_id, sum(part)::BIGINT AS score FROM asked JOIN part USING (term) GROUP BY ALL HAVING score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored)
WHERE rank <= 10
"""


def crc_table() -> list[int]:
    """Remainders of the bytes under the reflected polynomial of crc32."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


def crc32(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes, folded byte by byte."""
    byte = f"list_transform(range(1, 2 * strlen({text}) + 1, 2), lambda p: ('0x' || substr(hex({text}), p, 2))::BIGINT)"
    step = f"xor(c >> 8, ({crc_table()}::BIGINT[])[xor(c & 255, b) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: {step}), 4294967295::BIGINT)"


SPELLING_VARIANTS = rf"""
WITH RECURSIVE run AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT *, {crc32("(doc_id || ':' || run)")} AS h FROM run),
spelt AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
word AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS (
  SELECT DISTINCT word, n, other, other_n FROM (
    SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM less x JOIN less y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
    UNION ALL SELECT x.word, x.n, y.word, y.n FROM less x JOIN word y ON x.rest = y.word
    UNION ALL SELECT y.word, y.n, x.word, x.n FROM less x JOIN word y ON x.rest = y.word)),
best AS (
  SELECT word, count(*)::BIGINT AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
form AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
         CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM word LEFT JOIN best USING (word)),
up AS (
  SELECT word, word AS last, 0 AS steps FROM form
  UNION ALL SELECT up.word, form.form, steps + 1 FROM up JOIN form ON form.word = up.last WHERE form.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n
FROM form JOIN (SELECT word, arg_max(last, steps) AS root FROM up GROUP BY word) USING (word)
"""

WARC = """
WITH page AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
told AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY h) AS first,
         array_to_string(list_transform(list_transform(range(0, 8), lambda g: ('0x' || substr(h, 5 * g + 1, 5))::BIGINT),
           lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '') AS payload_digest
  FROM page)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM told
"""

SQL = {
    "op3_url_filter": URL_FILTER,
    "op4_chat_windows": CHAT_WINDOWS,
    "op7_ngram_join": NGRAM_JOIN,
    "op8_substring_dedup": SUBSTRING_DEDUP,
    "op9_embedding_dedup": EMBEDDING_DEDUP,
    "op10_line_dedup": LINE_DEDUP,
    "op11_lexical_search": LEXICAL_SEARCH,
    "op12_spelling_variants": SPELLING_VARIANTS,
    "op13_warc": WARC,
}
