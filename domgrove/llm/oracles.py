"""The registered queries in DuckDB's SQL, where SQL can express them."""

WORDS = r"""list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

OP8 = f"""
WITH docs AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents),
words AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM docs),
starts AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 19, 0) + 1)) AS i FROM docs)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM starts)
  WHERE nth > 1),
gone AS (
  SELECT doc_id, i, w, max(hit) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS g
  FROM (SELECT a.doc_id, a.i, a.w, CASE WHEN b.i IS NULL THEN 0 ELSE 1 END AS hit
        FROM words a LEFT JOIN later b ON a.doc_id = b.doc_id AND a.i = b.i))
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(g.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(g.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN (
  SELECT doc_id, sum(g) AS n_removed, string_agg(CASE WHEN g = 0 THEN w END, ' ' ORDER BY i) AS kept
  FROM gone GROUP BY doc_id) g ON d.doc_id = g.doc_id
"""

def _components(size: int, percent: int, more: str) -> str:
    """Components of documents whose sets of shingles are alike."""
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + {size - 1}], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 1}, 1) + 1)) AS i FROM docs WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common >= {percent} * (p.n + q.n - common)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM docs
  UNION
  SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.node AND r.root < e.y)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id{more}
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.node = d.doc_id
GROUP BY d.doc_id, s.n
"""


OP7 = _components(5, 75, ", min(r.root) = d.doc_id AS kept")
OP11 = _components(4, 85, "")

OP2 = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT doc_id, i, md5(substring(h, 2 * i + 1, 200)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS i FROM docs)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM starts)
  WHERE nth > 1),
joined AS (
  SELECT doc_id, i, CASE WHEN lag(i) OVER (PARTITION BY doc_id ORDER BY i) >= i - 100 THEN 0 ELSE 1 END AS new
  FROM later),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS nth FROM joined)
  GROUP BY doc_id, nth),
cuts AS (
  SELECT s.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(substring(h, 2 * coalesce(p, 0) + 1, 2 * (a - coalesce(p, 0))), '' ORDER BY a) AS kept, max(b) AS last
  FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM spans) s JOIN docs USING (doc_id)
  GROUP BY s.doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN cuts c ON c.doc_id = d.doc_id
"""


def _crc32(number: str) -> str:
    """The unsigned CRC-32 of an integer in decimal, bit by bit."""
    byte = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
      list_transform(string_split({number}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), {byte})))"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR)) || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


# g is the language in an order that begins with null.
OP13 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, {_leaf('n_chars')} AS leaf,
    CASE WHEN {_crc32('doc_id')} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS own
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
    count(*) OVER (PARTITION BY g) AS n FROM docs),
tree AS (
  SELECT g, 0 AS level, r AS i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT g, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), max(n + 1) // 2
  FROM tree WHERE n > 1 GROUP BY g, level, i // 2),
langs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS m FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, k AS i, subroot AS h, m AS n FROM langs
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), max(n + 1) // 2
  FROM top WHERE n > 1 GROUP BY level, i // 2),
steps AS (
  SELECT l.g, l.r, s.level AS pos, (l.r >> s.level) & 1 AS bit, coalesce(t.h, '') AS h
  FROM leaves l JOIN (SELECT DISTINCT g, level FROM tree WHERE n > 1) s ON s.g = l.g
  LEFT JOIN tree t ON t.g = l.g AND t.level = s.level AND t.i = xor(l.r >> s.level, 1)
  UNION ALL
  SELECT l.g, l.r, 1000 + s.level, (a.k >> s.level) & 1, coalesce(t.h, '')
  FROM leaves l JOIN langs a ON a.g = l.g, (SELECT DISTINCT level FROM top WHERE n > 1) s
  LEFT JOIN top t ON t.level = s.level AND t.i = xor(a.k >> s.level, 1)),
paths AS (SELECT g, r, list({{'bit': bit, 'h': h}} ORDER BY pos) AS path, string_agg(h, '' ORDER BY pos) AS proof
          FROM steps GROUP BY g, r),
checked AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_concat([{{'bit': 0::BIGINT, 'h': own}}], coalesce(path, [])), lambda a, x: {{'bit': 0::BIGINT,
      'h': sha256(CASE WHEN x.bit = 1 THEN x.h || a.h ELSE a.h || x.h END)}}).h AS folded_root
  FROM leaves JOIN langs USING (g) LEFT JOIN paths USING (g, r))
SELECT *, folded_root = root AS verified FROM checked
"""


_WORDS_OF_TEXT = WORDS.format("text")

OP12 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
marked AS (
  SELECT *, md5(octet_length(encode(role)) || ':' || role || text) AS content, len({_WORDS_OF_TEXT}) AS words FROM turns),
own AS (
  SELECT conv_id, content, words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, content) - 1 AS r FROM marked),
conv AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {_crc32('conv_id')} % 4 AS h FROM turns),
made AS (
  SELECT c.conv_id, 0 AS part, o.r, o.content, o.words FROM conv c JOIN own o ON o.conv_id = c.base AND o.r < c.h
  UNION ALL
  SELECT c.conv_id, 1, o.r, o.content, o.words FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.r >= c.h),
placed AS (
  SELECT conv_id, words, row_number() OVER w AS depth, string_agg(content, '') OVER w AS path
  FROM made WINDOW w AS (PARTITION BY conv_id ORDER BY part, r ROWS UNBOUNDED PRECEDING)),
steps AS (
  SELECT conv_id, depth, words, path AS key, substring(path, 1, length(path) - 32) AS parent FROM placed
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM conv),
last AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS total FROM steps),
nodes AS (
  SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = total), '')) AS ends_sha256
  FROM last GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (key)),
below AS (SELECT DISTINCT a.key AS top, b.key FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
totals AS (
  SELECT top AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM below JOIN known USING (key) GROUP BY top)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens,
  k.ends_sha256
FROM known k JOIN totals t ON t.key = k.key LEFT JOIN nodes p ON p.key = k.parent
"""
