"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import BASE, rules

OP1 = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w FROM s
), c AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS all_w,
    CAST(sum(3 * source_size) OVER o AS BIGINT) AS cap_upto, CAST(sum(w) OVER o AS BIGINT) AS w_upto
  FROM w WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), f AS (
  SELECT *, cap_upto * w + 3 * source_size * (all_w - w_upto) <= total * w AS is_full FROM c
), g AS (
  SELECT *, CAST(sum(CASE WHEN is_full THEN 3 * source_size ELSE 0 END) OVER () AS BIGINT) AS cap_full,
    CAST(sum(CASE WHEN is_full THEN w ELSE 0 END) OVER () AS BIGINT) AS w_full FROM f
), t AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST((total - cap_full) * w AS DOUBLE) / NULLIF(all_w - w_full, 0) END AS target,
    CAST(CAST('0x' || substr(md5('0/' || coalesce(source, '')), 1, 3) AS INTEGER) AS DOUBLE) / 4096 AS u
  FROM g
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, coalesce(((d.doc_id % 64) + 64) % 64, -1), d.doc_id NULLS FIRST) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(u + e * n) - floor(u + e * (n - 1))) * size AS BIGINT) AS taken
FROM r
"""

OP4 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""

OP10 = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS t FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), hit AS (
  SELECT r, i FROM win JOIN (SELECT t FROM win GROUP BY t HAVING count(*) > 1) USING (t)
), word AS (
  SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), seen AS (
  SELECT word.r, p, x, coalesce(max(hit.i) OVER (PARTITION BY word.r ORDER BY p ROWS 34 PRECEDING), 0) > 0 AS gone
  FROM word LEFT JOIN hit ON hit.r = word.r AND hit.i = p
), kept AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (NOT gone) AS t FROM seen GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


OP5 = """
WITH rules(ord, k, also, re, label, p, c) AS (VALUES {rules}),
base(label, phrase) AS (VALUES {base}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'
  ), ' ') AS t FROM documents
), w AS (
  SELECT *, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM d
), place AS (
  SELECT r, b.label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i : i + len(b.phrase) - 1] = b.phrase)) - 1 AS pos
  FROM w, base b WHERE contains(t, array_to_string(b.phrase, ' '))
), bases AS (
  SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM place GROUP BY r
), numbered AS (
  SELECT r, t, array_to_string(list_transform(w, lambda x, i: concat(i - 1, ':', x)), '  ') AS nt FROM w WHERE EXISTS (SELECT 1 FROM rules WHERE contains(t, k) AND contains(t, also))
), match AS (
  SELECT r, ord, label, p, c, trim(unnest(regexp_extract_all(nt, re)), ' ') AS m
  FROM numbered JOIN rules ON contains(t, k) AND contains(t, also)
), hit AS (
  SELECT r, ord, label, p, c, CAST(regexp_extract(m, '^([0-9]+):', 1) AS BIGINT) AS s, CAST(regexp_extract(m, '([0-9]+):[^ ]*$', 1) AS BIGINT) + 1 AS e FROM match
), far AS (
  SELECT *, max(e) OVER o AS e1, max(CASE WHEN p >= 2 THEN e END) OVER o AS e2, max(CASE WHEN p >= 3 THEN e END) OVER o AS e3
  FROM hit WINDOW o AS (PARTITION BY r ORDER BY s, e DESC, p DESC, ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), kept AS (
  SELECT r, list(DISTINCT label) AS labels, min(1.0::DOUBLE - c) AS miss FROM far
  WHERE e > coalesce(CASE p WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END, -1) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ','), '') AS labels,
  CASE WHEN base IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(1.0::DOUBLE - miss, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN bases USING (r) LEFT JOIN kept USING (r)
"""


OP7 = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, CASE WHEN ltrim(coalesce(text, ''), ' ') LIKE '{%' OR turn IS NULL THEN 'message'
    WHEN role = 'assistant' THEN 'call' WHEN turn > 0 THEN 'result' ELSE 'message' END AS kind FROM conversations
), p AS (
  SELECT conv_id, turn, kind, CASE WHEN kind = 'result' THEN 'tool' ELSE role END AS role,
    CASE kind WHEN 'call' THEN concat_ws('-', 'reply', conv_id, turn) WHEN 'result' THEN concat_ws('-', 'reply', conv_id, turn - 1) END AS call_id,
    CASE WHEN kind = 'call' THEN 'reply' END AS name, kind <> 'call' OR text IS NOT NULL AS valid,
    coalesce(to_json(text), 'null') AS text FROM m
), q AS (
  SELECT *, CASE kind WHEN 'message' THEN concat('{"content":', text, ',"role":', coalesce(to_json(role), 'null'), '}')
    WHEN 'result' THEN concat('{"content":', text, ',"role":"tool","tool_call_id":', to_json(call_id), '}')
    ELSE concat('{"role":"assistant","tool_call":{"arguments":{"text":', text, ',"turn":', turn, '},"id":', to_json(call_id), ',"name":"reply"}}') END AS json FROM p
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, kind, call_id ORDER BY turn, json) AS nth FROM q
), c AS (
  SELECT conv_id, turn, call_id FROM n WHERE kind = 'call' AND nth = 1
), depth AS (
  SELECT *, 0 AS depth FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.turn = c.turn - 2)
  UNION ALL SELECT c.*, depth + 2 FROM depth d JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.turn = d.turn + 2
)
SELECT n.conv_id, n.turn, 0 AS item, n.role, n.kind, n.call_id, n.name, n.valid, n.json,
  CASE n.kind WHEN 'message' THEN 0 WHEN 'call' THEN d.depth ELSE coalesce(d.depth + 1, 0) END AS depth,
  CASE WHEN n.kind = 'message' THEN 'message' WHEN n.nth > 1 THEN 'repeated_id'
    WHEN n.kind = 'call' THEN CASE WHEN EXISTS (SELECT 1 FROM n r WHERE r.kind = 'result' AND r.call_id = n.call_id) THEN 'linked' ELSE 'no_result' END
    WHEN d.call_id IS NULL THEN 'no_call' ELSE 'linked' END AS status,
  CASE WHEN n.valid THEN '' ELSE '$.text: not of type string' END AS problems
FROM n LEFT JOIN depth d ON d.call_id = n.call_id
"""

OP11 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
  FROM e a JOIN e ON a.vec_id % 100 = 0 AND e.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


OP13 = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT c, max(pos) AS n, 4294967295 - list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM t GROUP BY c
), m AS (
  SELECT n.c, n.c - n.c % 5 AS base, n.crc % 9 AS h, least(n.crc % 9, coalesce(b.n, 0)) AS given FROM n LEFT JOIN n b ON b.c = n.c - n.c % 5
), r AS (
  SELECT m.c, given + pos - h AS d, role, text FROM m JOIN t ON t.c = m.c WHERE pos > h
  UNION ALL SELECT m.c, pos, role, text FROM m JOIN t ON t.c = m.base WHERE pos <= given
), p AS (
  SELECT c, d, strlen(text) AS bytes, string_agg(concat(len(role), ':', role, len(text), ':', text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS path FROM r
  UNION ALL SELECT c, 0, 0, '' FROM m
), q AS (
  SELECT *, lag(path) OVER (PARTITION BY c ORDER BY d) AS up, lead(d) OVER (PARTITION BY c ORDER BY d) IS NULL AS is_end FROM p
), g AS (
  SELECT d, path, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256 FROM q GROUP BY d, path
), k AS (
  SELECT d - 1 AS d, up AS path, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL
), f AS (
  SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (d, path)
), s AS (
  SELECT q.d, q.path, sum(f.saved) AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves
  FROM f JOIN q e ON e.c = f.conv_id AND e.d = f.d JOIN q ON q.c = f.conv_id AND q.d <= f.d GROUP BY ALL
)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (d, path) LEFT JOIN g u ON u.d = f.d - 1 AND u.path = f.up
"""


def op5_sql() -> str:
    """Every rule over every text that holds its keywords, with intervals compared by windows."""

    def numbered(pattern: str) -> str:
        """For words that are numbered and two spaces apart, of which a match takes one on each side."""
        parts = pattern.replace(".{", "(?:\0|\1){").replace(" ?", "(?:\1)?").replace(" ", "\1")
        return f"(?:^| )[0-9]+:(?:{parts})(?: |$)".replace("\0", "[^ ]").replace("\1", "  [0-9]+:")

    rows = [f"({i}, '{r.keyword}', '{r.also}', '{numbered(r.pattern)}', '{r.label}', {r.priority}, {r.confidence}::DOUBLE)" for i, r in enumerate(rules())]
    base = [f"('{label}', {phrase.split()})" for phrase, label in BASE.items()]
    return OP5.format(rules=",\n".join(rows), base=", ".join(base))


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1, "op4_exact_dedup": OP4, "op5_license_scan": op5_sql(), "op7_chat_format": OP7, "op10_substring_dedup": OP10, "op11_hard_negatives": OP11, "op13_prefix_trie": OP13}
