"""SQL for DuckDB over the same tables, for the operators that SQL can express."""

from __future__ import annotations

from . import chat, sharding

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_ALNUM} AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 5 >= (x.n + y.n - c) * 4),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a),
m AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, c.class_id, CAST(coalesce(m.n_links, 0) AS BIGINT) AS n_links
FROM documents d JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP4 = """
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

# Bytes as pairs of hex digits; a window is 200 digits. A text is cut into rows of bytes once.
OP5 = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS MATERIALIZED (SELECT doc_id, len(h) // 2 AS n, h FROM d),
w AS (SELECT doc_id, s, md5_number(h[2*s+1 : 2*s+200]) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM b WHERE n >= 100)),
f AS MATERIALIZED (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM w),
z AS MATERIALIZED (SELECT doc_id, s, sum(CAST(s > prev + 100 AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s, lag(s, 1, -1000) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM f WHERE nth > 1)),
r AS MATERIALIZED (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS e FROM z GROUP BY doc_id, run),
keep AS (SELECT b.doc_id, b.n, b.h, coalesce(x.starts, []) AS starts, coalesce(x.ends, []) AS ends FROM b LEFT JOIN
  (SELECT doc_id, list(a ORDER BY a) AS starts, list(e ORDER BY a) AS ends FROM r GROUP BY doc_id) x USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(ends), 0) - coalesce(list_sum(starts), 0) AS BIGINT) AS n_removed, CAST(len(starts) AS BIGINT) AS n_spans,
  sha256(from_hex(array_to_string(list_transform(range(1, len(starts) + 2), lambda i: h[2 * CAST(CASE WHEN i = 1 THEN 0 ELSE ends[i-1] END AS BIGINT) + 1 : 2 * CAST(CASE WHEN i > len(starts) THEN n ELSE starts[i] END AS BIGINT)]), ''))) AS kept_sha256
FROM keep
"""

_CONTROL = "|".join("".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in s) for s in chat.CONTROL)


def _escaped(x: str) -> str:
    """Code points of an escaped text: one more for each backslash and each control string."""
    return f"(length({x}) + length({x}) - length(replace({x}, chr(92), '')) + len(regexp_extract_all({x}, '{_CONTROL}')))"


OP8 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.START) + 1 + len(chat.END)} + {_escaped("role")} + {len(chat.BREAK) - 1} * (length(role) - length(replace(role, chr(10), ''))) + {_escaped("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP9 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS MATERIALIZED (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS k FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') AS k FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM iw))),
h AS MATERIALIZED (SELECT doc_id, s, size, item FROM dw JOIN iw USING (size, k)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP10 = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
dw AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
g AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS first FROM dw),
c AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM g WHERE first < doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN c USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _op6(seed: int = 20, shards: int = 8) -> str:
    """The permutation as a recursive walk, and CRC-32 by its polynomial, byte by byte."""
    m1, m2 = sharding.MULTIPLIERS
    mask, steps, left, right = sharding.MASK, [], "(v >> b)", "(v & low)"
    for i, key in enumerate(sharding.round_keys(seed)):
        steps.append(f"a{i} AS (SELECT n, b, low, {left} AS l, {right} AS r, (xor({right}, {key}) * {m1}) & {mask} AS t FROM {'s' if i == 0 else f'c{i - 1}'})")
        steps.append(f"b{i} AS (SELECT n, b, low, l, r, (xor(t, t >> 15) * {m2}) & {mask} AS t FROM a{i})")
        steps.append(f"c{i} AS (SELECT n, b, low, r AS l, xor(l, xor(t, t >> 13) & low) AS r FROM b{i})")
        left, right = "l", "r"
    last = f"c{sharding.ROUNDS - 1}"
    bit = "list_reduce(range(0, 9), lambda c, i: CASE WHEN i = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(v AS BIGINT))"
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(c ORDER BY v) AS t FROM (SELECT v, {bit.replace("range(0, 9)", "range(1, 9)")} AS c FROM (SELECT unnest(range(0, 256)) AS v))),
d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS x FROM documents),
u AS MATERIALIZED (SELECT DISTINCT x, hex(encode(x)) AS h FROM d),
y AS MATERIALIZED (SELECT x, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: (instr('123456789ABCDEF', h[2*i+1])) * 16 + instr('123456789ABCDEF', h[2*i+2])), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM u, crc),
o AS MATERIALIZED (SELECT doc_id, CAST(strlen(x) + 1 AS BIGINT) AS size, coalesce(crc, 0) AS text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(crc, 0), strlen(x)) - 1 AS n FROM d JOIN y USING (x)),
z AS MATERIALIZED (SELECT count(*) AS total, greatest(1, (len(bin(greatest(2, count(*)) - 1)) + 1) // 2) AS b FROM o),
walk AS (
  SELECT n, n AS v, 0 AS step FROM o
  UNION ALL
  (WITH s AS (SELECT n, v, z.b, (1 << z.b) - 1 AS low FROM walk, z WHERE step = 0 OR v >= z.total),
  {", ".join(steps)}
  SELECT n, (l << b) | r AS v, 1 AS step FROM {last}))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(v % {shards} AS INTEGER) AS shard, CAST(v // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM o JOIN (SELECT n, v FROM walk, z WHERE step = 1 AND v < z.total) USING (n)
"""


OP6 = _op6()
ORACLES = {
    "op2_lsh_forest": OP2,
    "op4_kd_trees": OP4,
    "op5_suffix_array": OP5,
    "op6_feistel_shards": OP6,
    "op8_prefix_trees": OP8,
    "op9_winnowing": OP9,
    "op10_difference_cover": OP10,
}
