"""SQL for the Merkle manifest."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(x: str) -> str:
    """The unsigned crc32 of a short ASCII text; 3988292384 is the reversed polynomial, fixed."""
    steps = f"flatten(list_transform(string_split({x}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({steps}, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def _field(x: str) -> str:
    x = f"CAST({x} AS VARCHAR)"
    return f"coalesce(strlen({x}) || ':' || {x}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """Levels of the trees over ``leaves`` (g, p, h, n), and the siblings of each node."""
    return f"""
{name}(k, g, p, h, n) AS (
  SELECT 0, g, p, h, n FROM {leaves}
  UNION ALL
  SELECT k + 1, g, p // 8, sha256(string_agg(h, '' ORDER BY p)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY k, g, p // 8, n),
{name}_s AS (
  SELECT a.k, a.g, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (WHERE b.p < a.p), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (WHERE b.p > a.p), '') AS r
  FROM {name} a JOIN {name} b ON a.k = b.k AND a.g = b.g AND a.p // 8 = b.p // 8 WHERE a.n > 1 GROUP BY a.k, a.g, a.p)"""


MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf,
         {_leaf(f"CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END")} AS changed
  FROM documents),
a AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM d),
leaves AS (SELECT g, p, leaf AS h, n FROM a),
{_tree("t", "leaves")},
subroots AS (SELECT g AS p, h, count(*) OVER () AS n, 0 AS g FROM t WHERE n = 1),
{_tree("u", "subroots")},
steps AS (
  SELECT a.g, a.p, s.k, s.l, s.r FROM a JOIN t_s s ON s.g = a.g AND s.p = a.p // CAST(power(8, s.k) AS BIGINT)
  UNION ALL
  SELECT a.g, a.p, 100 + s.k, s.l, s.r FROM a JOIN u_s s ON s.p = a.g // CAST(power(8, s.k) AS BIGINT)),
w AS (SELECT g, p, string_agg(l || r, '' ORDER BY k) AS proof, list(l || '|' || r ORDER BY k) AS way FROM steps GROUP BY g, p),
f AS (
  SELECT a.doc_id, a.leaf, b.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(w.proof, '')) AS proof_sha256,
         CASE WHEN w.way IS NULL THEN a.changed ELSE list_reduce(w.way, lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2)), a.changed) END AS folded_root
  FROM a JOIN subroots b ON b.p = a.g LEFT JOIN w ON w.g = a.g AND w.p = a.p)
SELECT *, folded_root = root AS verified FROM f
"""
