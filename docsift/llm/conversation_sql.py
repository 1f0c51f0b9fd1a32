"""DuckDB SQL for the conversation queries: plain recursion over scripts, and plain groups by whole prefixes."""

from __future__ import annotations

#: The table of CRC-32 (polynomial 0xEDB88320), as a list in the column tab.
_TABLE = """
crc_steps(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) AS r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM crc_steps WHERE k = 8)"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text; the table crc has to be joined."""
    codes = f"list_transform(range(1, len({text}) + 1), lambda j: ord(substr({text}, j, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


#: Inserts from each state: how many, the state behind them, their letters and lines.
_INSERTS = """ins(state, dest, letters, put) AS (VALUES
  (0, 0, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']),
  (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
  (2, 2, '', []), (2, 3, 'I', ['assistant:']), (2, 2, 'II', ['assistant:', 'user:']),
  (3, 3, '', []), (3, 2, 'I', ['user:']), (3, 3, 'II', ['user:', 'assistant:']))"""
_WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

REPAIR_SQL = f"""
WITH RECURSIVE {_TABLE}, {_INSERTS},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT src.*, {_crc32('k')} % 20 AS h FROM src, crc),
dmg AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS copies FROM hit),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos FROM dmg, LATERAL (SELECT unnest(range(copies)))),
faulty AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prior, CASE WHEN rtrim(text, {_WHITE}) = '' THEN 'b'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN right(rtrim(text, {_WHITE}), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
rec(conv_id, pos, state, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} FROM conversations
  UNION ALL
  SELECT conv_id, pos, state, min(best) FROM (
    SELECT r.conv_id, f.pos, CASE WHEN act = 'D' THEN dest WHEN act = 'K' AND initial = 's' THEN 1 WHEN dest = 2 THEN 3 ELSE 2 END AS state,
      {{'cost': r.best.cost + 2 * length(letters) + CASE act WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN act <> 'D' AND fault = 't' THEN 1 ELSE 0 END,
        'audit': r.best.audit || letters || act,
        'lines': r.best.lines || put || CASE act WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE WHEN dest = 2 THEN 'assistant:' ELSE 'user:' END || text] END}} AS best
    FROM rec r JOIN faulty f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = r.pos + 1 JOIN ins USING (state), (VALUES ('D'), ('K'), ('R')) AS acts(act)
    WHERE act = 'D' OR fault NOT IN ('b', 'd') AND (act = 'R' OR initial = 's' AND dest = 0 OR initial = 'u' AND dest <> 2 OR initial = 'a' AND dest = 2)) GROUP BY ALL),
counts AS (SELECT c.conv_id, count(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pos > 1 AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faulty f ON c.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY c.conv_id),
ends AS (SELECT c.conv_id, min({{'cost': best.cost + 2 * length(letters), 'audit': best.audit || letters, 'lines': best.lines || put}}) AS best
  FROM counts c JOIN rec r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = c.n JOIN ins USING (state) WHERE dest IN (0, 3) GROUP BY c.conv_id)
SELECT c.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256, len(best.lines)::BIGINT AS n_repaired
FROM counts c JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""

TRIE_SQL = f"""
WITH RECURSIVE {_TABLE},
turns AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own FROM conversations GROUP BY conv_id),
heads AS (SELECT conv_id, own, conv_id::VARCHAR AS k FROM turns),
sized AS (SELECT heads.*, coalesce({_crc32('k')} % 9, 0) AS h FROM heads, crc),
built AS (SELECT s.conv_id, list_concat(coalesce(b.own, [])[1:s.h], s.own[s.h + 1:]) AS path FROM sized s LEFT JOIN turns b ON b.conv_id = s.conv_id - s.conv_id % 5),
prefixes AS (SELECT conv_id, d AS depth, path[1:d] AS key, len(path) = d AS whole FROM built, LATERAL (SELECT unnest(range(len(path) + 1)) AS d)),
nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole), '') AS ends,
  CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(key[depth].text) END AS weight FROM prefixes GROUP BY key, depth),
kids AS (SELECT key[1:depth - 1] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT key[1:d] AS key, sum(weight) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves
  FROM (SELECT n.key, n.depth, n.weight, k.n_children IS NULL AS leaf FROM nodes n LEFT JOIN kids k USING (key)), LATERAL (SELECT unnest(range(depth + 1)) AS d) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN kids k USING (key) JOIN below b USING (key) LEFT JOIN nodes p ON n.depth > 0 AND p.key = n.key[1:n.depth - 1]"""
