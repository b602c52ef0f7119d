"""SQL of the queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from listsieve.llm import secret_index

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str, separators: str) -> str:
    low = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    return f"list_filter(regexp_split_to_array({low}, '{separators}'), lambda w: w <> '')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(rank: int, rule: secret_index.Rule) -> str:
    stepping = quoted(f"(?s:(.*?))({rule.pattern})")
    return f"""
SELECT doc_id, {rank} AS rank, {quoted(rule.kind)} AS kind, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i) AS stop, size, tested
FROM (SELECT doc_id, unnest(generate_series(1, len(gaps))) AS i, unnest(gaps) AS gap, unnest(sizes) AS size, unnest(tests) AS tested
  FROM (SELECT doc_id,
    list_transform(regexp_extract_all(text, {stepping}, 1), lambda x: length(x)) AS gaps,
    list_transform(regexp_extract_all(text, {stepping}, 2), lambda x: length(x)) AS sizes,
    list_transform(regexp_extract_all(text, {stepping}, {rule.group + 2}), lambda x: length(x)) AS tests FROM docs))
WHERE true QUALIFY tested >= {rule.least}"""


def _secrets() -> str:
    each = " UNION ALL ".join(f"SELECT * FROM ({_spans(k, r)})" for k, r in enumerate(secret_index.RULES))
    base = ", ".join(quoted(r.kind) for r in secret_index.BASE_RULES)
    told = "kind || ':' || (stop - size) || ':' || stop, ',' ORDER BY stop - size, rank"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_index.BASE_RULES)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({each})
SELECT doc_id, {counts}, sha256(coalesce(string_agg({told}) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg({told}) FILTER (kind IS NOT NULL), '') AS spans
FROM docs LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


NEAR_JOIN = f"""
WITH RECURSIVE low AS (SELECT doc_id, {words("text", "[\\x20\\x09-\\x0D]+")} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM low WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM low LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reached GROUP BY a) USING (doc_id)"""

_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
DECONTAMINATE = f"""
WITH item AS (SELECT item_id, {words("text", _ALNUM)} AS w FROM benchmark),
item_at AS (SELECT *, least(10, len(w)) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM item_at),
docs AS (SELECT doc_id, {words("text", _ALNUM)} AS w FROM documents),
doc_at AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM windows)),
hits AS (SELECT doc_id, i, a.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM doc_at) a
  JOIN windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM
  (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

_TERM = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
BALL_SEARCH = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {words("text", _TERM)} AS w FROM documents),
sizes AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
times AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM times, totals GROUP BY t, n_docs),
items AS (SELECT item_id, i, unnest(w) AS t FROM
  (SELECT item_id, row_number() OVER () AS i, {words("text", _TERM)} AS w FROM benchmark)),
scores AS (SELECT i, item_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM items JOIN weights USING (t) JOIN times USING (t) JOIN sizes USING (r), totals GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM
  (SELECT item_id, i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank
   FROM scores JOIN sizes USING (r) WHERE score > 0) WHERE rank <= 10"""

_CRC_STEP = "lambda a, b: xor(a >> 1, 3988292384::UBIGINT * (a & 1))"
_EIGHT = ", ".join(["0::UBIGINT"] * 8)
_CRC = (
    "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''),"
    f" lambda x: ascii(x)::UBIGINT)), lambda a, b: list_reduce([xor(a, b), {_EIGHT}], {_CRC_STEP})))"
)
PREFIX_TRIE = f"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS base, CAST({_CRC} % 9 AS BIGINT) AS h FROM (SELECT DISTINCT c FROM own)),
turns AS (SELECT convs.c, pos, role, text FROM convs JOIN own ON own.c = convs.base WHERE pos < h
  UNION ALL SELECT convs.c, pos, role, text FROM convs JOIN own ON own.c = convs.c WHERE pos >= h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS depth, role, text FROM turns),
paths AS (SELECT c, depth, strlen(text) AS bytes, string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
    OVER (PARTITION BY c ORDER BY depth) AS node FROM placed
  UNION ALL SELECT c, 0, 0, '' FROM convs),
steps AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY c) AS size FROM paths),
nodes AS (SELECT node, depth, any_value(parent) AS parent, any_value(bytes) AS bytes, min(c) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = size), '')) AS ends_sha256 FROM steps GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
under AS (SELECT DISTINCT a.node AS top, b.node AS node FROM steps a JOIN steps b ON a.c = b.c AND a.depth <= b.depth),
sums AS (SELECT top AS node, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
  FROM under JOIN whole USING (node) GROUP BY top)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w JOIN sums USING (node) LEFT JOIN nodes p ON p.node = w.parent"""

ORACLES = {
    "op2_secret_index": _secrets(),
    "op6_near_join": NEAR_JOIN,
    "op7_decontaminate": DECONTAMINATE,
    "op11_ball_search": BALL_SEARCH,
    "op12_prefix_trie": PREFIX_TRIE,
}
