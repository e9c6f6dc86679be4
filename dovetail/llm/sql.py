"""SQL that DuckDB runs for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
  i AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM benchmark),
  wins AS (SELECT DISTINCT item_id, list_slice(w, k, k + 12) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0) x),
  sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
  grams AS (SELECT doc_id, k, list_slice(w, k, k + n - 1) AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n) x),
  hits AS (SELECT doc_id, k, len(win) AS n, item_id FROM grams JOIN wins USING (win)),
  hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) x GROUP BY doc_id),
  hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) x GROUP BY doc_id),
  item_terms AS (SELECT DISTINCT item_id, unnest(w) AS term FROM i WHERE item_id IS NOT NULL),
  places AS MATERIALIZED (SELECT doc_id, term, p FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS p FROM d) x WHERE term IN (SELECT term FROM item_terms)),
  counted AS (SELECT term, count(*) AS n FROM places GROUP BY term),
  ranked AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n, 0), term) AS k, min(coalesce(n, 0)) OVER (PARTITION BY item_id) AS least FROM item_terms LEFT JOIN counted USING (term)),
  rare AS (SELECT item_id, term, k, count(*) OVER (PARTITION BY item_id) AS n FROM ranked WHERE k <= 3 AND least > 0),
  lists AS MATERIALIZED (SELECT doc_id, item_id, k, n, p FROM places JOIN rare USING (term)),
  close AS (SELECT a.doc_id, a.item_id FROM lists a JOIN lists b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND abs(b.p - a.p) <= 10
    WHERE a.k = 1 GROUP BY a.doc_id, a.item_id, a.p HAVING count(DISTINCT b.k) = any_value(a.n)),
  near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id) LEFT JOIN near USING (doc_id)"""

_CONTROL = r"\[INST\]|\[/INST\]|<s>|</s>|<<SYS>>|<</SYS>>|\[ROLE\]|\[:\]|\[/ROLE\]"

CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 'messages' AS layout FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'response' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'response'),
  e AS (SELECT *, length(replace(text, '\', '\\')) + len(regexp_extract_all(replace(text, '\', '\\'), '{_CONTROL}')) AS body, length(replace(role, '\', '\\')) + len(regexp_extract_all(replace(role, '\', '\\'), '{_CONTROL}')) AS role_body FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE role_body + 20 END) AS BIGINT) AS formatted_chars, any_value(layout) AS layout
FROM e GROUP BY conv_id"""

_SPLIT = r"list_filter(regexp_split_to_array(" + _LOWER.format(t="text") + r", '[\x20\x09-\x0D]+'), lambda x: x <> '')"

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0) x),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
  l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r(node, label) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(label) AS least FROM r GROUP BY node) m USING (doc_id)"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(""" + _LOWER.format(t="text") + r""", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  t AS (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) x GROUP BY ALL),
  kept AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING count(*) >= 30),
  v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
  g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, sum(t.n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
  size AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
  p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 5)) // (size.total + 5 * v.v) AS BIGINT) AS p
    FROM size JOIN v USING (lang) JOIN (SELECT lang, term FROM kept) k USING (lang) LEFT JOIN c USING (lang, source, term)),
  q AS (SELECT lang, term, CAST(1 + (1000000000 * (CAST(n AS HUGEINT) + 5)) // (v.total + 5 * v.v) AS BIGINT) AS q FROM kept JOIN v USING (lang)),
  sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) x)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

REPEATS = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  c AS (SELECT rid, doc_id, z, substr(h, 2 * z + 1, 354) AS h FROM (SELECT rid, doc_id, h, unnest(range(0, len(h) // 2, 128)) AS z FROM d) x),
  w AS (SELECT rid, doc_id, z + i AS i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT rid, doc_id, z, h, unnest(range(1, least(128, len(h) // 2 - 49) + 1)) AS i FROM c WHERE len(h) >= 100) x),
  twice AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
  hit AS (SELECT rid, i FROM w JOIN twice USING (s) WHERE first < doc_id),
  cuts AS (SELECT rid, i, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM hit),
  runs AS (SELECT rid, min(i) AS a, max(i) + 50 AS b FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS g FROM cuts) x GROUP BY rid, g),
  before AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 1) AS z FROM runs),
  pieces AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * z - 1, 2 * (a - z)), '' ORDER BY a) AS kept
    FROM before JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * last - 1) END)) AS kept_sha256
FROM d LEFT JOIN pieces USING (rid)"""

#: CRC-32, bit by bit: a digit is taken in, and eight shifts follow it (-1).
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295)"""

TRIE = f"""
WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, role, text
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) x),
  c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE {_CRC} % 9 END AS h FROM (SELECT DISTINCT conv_id FROM t) x),
  r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE pos < h
    UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h),
  o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, strlen(text) AS size, md5(len(role) || ':' || role || text) AS turn FROM r),
  p AS (SELECT conv_id, depth, size, md5(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM o),
  members AS MATERIALIZED (SELECT conv_id, depth, size, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS parent FROM p
    UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM c),
  ends AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id),
  nodes AS MATERIALIZED (SELECT node, depth, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, any_value(size) AS size FROM members GROUP BY node, depth),
  kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
  closed AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM members JOIN ends USING (conv_id, depth) GROUP BY node),
  paths AS (SELECT DISTINCT a.node AS top, b.node FROM members a JOIN members b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
  below AS (SELECT top, count(*) FILTER (WHERE kids.n IS NULL) AS leaves, sum((nodes.n_convs - 1) * nodes.size) AS saved FROM paths JOIN nodes USING (node) LEFT JOIN kids USING (node) GROUP BY top)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(closed.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes up ON up.node = n.parent LEFT JOIN kids ON kids.node = n.node LEFT JOIN closed ON closed.node = n.node JOIN below ON below.top = n.node"""
