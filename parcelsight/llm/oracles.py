"""DuckDB statements for the operators that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op10_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (
           PARTITION BY bare ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY bare) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM w
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# One row per distinct set: (rep, its documents); links between distinct sets that share a shingle.
ORACLES["op4_minhash"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM words),
hashed AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS h, s FROM sets),
classes AS (
  SELECT h, min(doc_id) AS node, any_value(n) AS n, any_value(s) AS s
  FROM hashed WHERE n > 0 GROUP BY h),
items AS (SELECT node, n, unnest(s) AS item FROM classes),
links AS (
  SELECT a.node AS a, b.node AS b
  FROM items a JOIN items b ON a.item = b.item AND a.node < b.node
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, seen) AS (
  SELECT node, node FROM classes
  UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, d.n AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM hashed d LEFT JOIN classes k ON d.h = k.h AND d.n > 0 LEFT JOIN component c ON c.node = k.node
"""

# Payloads are compared as they are; revisits point at the largest page_id.
ORACLES["op7_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n
  FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
FROM w
"""

ORACLES["op3_vector_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = list_count(embedding)
    AND len(list_filter(embedding, lambda a: NOT isfinite(a))) = 0
    AND len(list_filter(embedding, lambda a: a <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    AND list_cosine_similarity(a.x, b.x) >= 0.93),
reach(node, seen) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.node, e.b FROM reach r JOIN links e ON e.a = r.seen),
component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links,
       least(e.vec_id, coalesce(component_id, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(component_id, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN component c ON c.node = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""

# The checksum goes byte by byte through the table of its generator, worked out in SQL.
ORACLES["op13_spelling"] = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
        FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(1, length(x), 2),
                                             lambda i: ('0x' || x[i:i + 1])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM bytes, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0
      THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
skips AS (
  SELECT word, word[1:i] AS p, word[i + 2:] AS s
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM skips a JOIN skips b USING (p, s) WHERE a.word != b.word
  UNION SELECT word, p || s FROM skips WHERE p || s IN (SELECT word FROM words)
  UNION SELECT p || s, word FROM skips WHERE p || s IN (SELECT word FROM words)),
best AS (
  SELECT near.word, count(*) AS n_near,
         arg_min(other, (-o.n, other)) AS other, max(o.n) AS other_n
  FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= 10 * n THEN other END AS form,
         CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT chain.word, form FROM chain JOIN forms ON forms.word = root
  WHERE form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (
  SELECT chain.word, root FROM chain JOIN forms ON forms.word = root WHERE form IS NULL) c USING (word)
"""
