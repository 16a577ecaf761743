"""DuckDB SQL of the prefix trie and of the Merkle manifest, written from their definitions: every prefix of every conversation is
a row, every level of every tree a step of a recursion. No digest order, skeleton or superblock occurs here.
"""

from __future__ import annotations

#: CRC-32 (reflected polynomial 0xEDB88320) of a text of ASCII characters; DuckDB has no function for it.
_CRC_TABLE = """
crc_table AS (SELECT list(list_reduce([b, 1, 1, 1, 1, 1, 1, 1, 1],
                     lambda a, step: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS t
              FROM range(256) r(b))"""


def _crc(text: str) -> str:
    """Needs ``crc_table`` beside it in FROM."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), "
            "4294967295::BIGINT)")


TRIE_SQL = f"""
WITH {_CRC_TABLE.strip()},
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
signed AS (SELECT conv_id, turn, strlen(text) AS bytes, sha256(strlen(role) || ':' || role || text) AS sign FROM turns),
originals AS (
  SELECT conv_id, list({{'sign': sign, 'bytes': bytes}} ORDER BY turn NULLS FIRST, sign) AS said FROM signed GROUP BY conv_id),
heads AS (
  SELECT conv_id, said, conv_id - (conv_id % 5 + 5) % 5 AS first, {_crc('conv_id::VARCHAR')} % 9 AS h FROM originals, crc_table),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(f.said, 1, c.h), []), list_slice(c.said, c.h + 1, len(c.said))) AS said
  FROM heads c LEFT JOIN originals f ON f.conv_id = c.first),
members AS (
  SELECT conv_id, d AS depth, len(said) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE said[d].bytes END AS bytes,
         array_to_string(list_transform(list_slice(said, 1, d), lambda s: s.sign), '') AS path,
         CASE WHEN d > 0 THEN array_to_string(list_transform(list_slice(said, 1, d - 1), lambda s: s.sign), '') END AS above
  FROM (SELECT conv_id, said, unnest(range(len(said) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(bytes) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path),
children AS (SELECT above AS path, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
sums AS (
  SELECT m.path, sum((below.n_children = 0)::INT) AS n_leaves, sum(below.own) AS saved_tokens
  FROM counted below JOIN members m ON m.conv_id = below.conv_id AND m.depth <= below.depth GROUP BY m.path)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (path) LEFT JOIN nodes p ON p.path = c.above
"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}, '-')"


_BEFORE = "ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_AFTER = "ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
_FIRST_FOUR = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

MERKLE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE.strip()},
leaves AS (
  SELECT doc_id, source, sha256({_FIRST_FOUR} || {_field('text')}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_crc('doc_id::VARCHAR')} % 5 = 0 THEN sha256({_FIRST_FOUR} || {_field('low')}) END AS forged
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents), crc_table),
placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS r,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS size
  FROM leaves),
up(source, level, idx, digest, n) AS (
  SELECT source, 0, pos, leaf, size FROM placed
  UNION ALL
  SELECT source, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16
  FROM up WHERE n > 1 GROUP BY source, level, idx // 16, n),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size
  FROM up WHERE n = 1),
top(level, idx, digest, n) AS (
  SELECT 0, pos, subroot, size FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16
  FROM top WHERE n > 1 GROUP BY level, idx // 16, n),
low_sides AS (
  SELECT source, level, idx, coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, idx // 16 {_BEFORE}), '') AS b,
         coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, idx // 16 {_AFTER}), '') AS a
  FROM up WHERE n > 1),
top_sides AS (
  SELECT level, idx, coalesce(string_agg(digest, '') OVER (PARTITION BY level, idx // 16 {_BEFORE}), '') AS b,
         coalesce(string_agg(digest, '') OVER (PARTITION BY level, idx // 16 {_AFTER}), '') AS a
  FROM top WHERE n > 1),
low_proofs AS (
  SELECT r, list({{'b': b, 'a': a}} ORDER BY level) AS sides
  FROM placed p JOIN low_sides s ON s.source IS NOT DISTINCT FROM p.source AND s.idx = p.pos >> (4 * s.level) GROUP BY r),
top_proofs AS (
  SELECT pos, list({{'b': b, 'a': a}} ORDER BY level) AS sides
  FROM subroots p JOIN top_sides s ON s.idx = p.pos >> (4 * s.level) GROUP BY pos),
proofs AS (
  SELECT doc_id, leaf, forged, subroot, (SELECT digest FROM top WHERE n = 1) AS root,
         list_concat(coalesce(low_proofs.sides, []), coalesce(top_proofs.sides, [])) AS sides
  FROM placed JOIN subroots ON subroots.source IS NOT DISTINCT FROM placed.source
  LEFT JOIN low_proofs USING (r) LEFT JOIN top_proofs ON top_proofs.pos = subroots.pos),
folded AS (
  SELECT *, list_reduce(list_prepend({{'b': coalesce(forged, leaf), 'a': ''}}, sides),
                        lambda low, s: {{'b': sha256(s.b || low.b || s.a), 'a': ''}}).b AS folded_root
  FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(sides, lambda s: s.b || s.a), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""
