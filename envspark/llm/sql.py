"""DuckDB SQL of the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op12_fill_in_middle"] = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cut AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM drawn),
placed AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s
  FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: Unsigned crc32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _levels(name: str, source: str) -> str:
    """All levels of the binary trees over ``source`` (g, idx, n, h)."""
    return f"""{name} AS (
  WITH RECURSIVE t(lvl, g, idx, n, h) AS (
    SELECT 0, g, idx, n, h FROM {source}
    UNION ALL
    SELECT lvl + 1, g, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY lvl, g, idx // 2, n)
  SELECT * FROM t)"""


def _climb(name: str, source: str, levels: str) -> str:
    """Rows of ``source`` (row, g, idx, node, proof) carried to the root of their tree."""
    return f"""{name} AS (
  WITH RECURSIVE c(lvl, row, g, idx, node, proof, done) AS (
    SELECT 0, row, g, idx, node, proof, false FROM {source}
    UNION ALL
    SELECT c.lvl + 1, c.row, c.g, c.idx // 2,
           CASE WHEN own.n = 1 THEN c.node WHEN s.h IS NULL THEN sha256(c.node) WHEN c.idx % 2 = 1 THEN sha256(s.h || c.node) ELSE sha256(c.node || s.h) END,
           c.proof || CASE WHEN own.n = 1 THEN '' ELSE coalesce(s.h, '') END, own.n = 1
    FROM c JOIN {levels} own ON own.lvl = c.lvl AND own.g = c.g AND own.idx = c.idx
    LEFT JOIN {levels} s ON s.lvl = c.lvl AND s.g = c.g AND s.idx = xor(c.idx, 1)
    WHERE NOT c.done)
  SELECT * FROM c WHERE done)"""


SQL["op13_merkle_manifest"] = f"""
WITH leaves AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {_leaf('n_chars')} AS h,
         CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND ({_CRC}) % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS forged
  FROM documents),
placed AS (
  SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{_levels('lower', 'placed')},
subroots AS (SELECT g AS tree, h FROM lower WHERE n = 1),
ranked AS (SELECT '' AS g, tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM subroots),
{_levels('upper', 'ranked')},
beginning AS (SELECT row, g, idx, coalesce(forged, h) AS node, '' AS proof FROM placed),
{_climb('under', 'beginning', 'lower')},
middle AS (SELECT u.row, '' AS g, r.idx, u.node, u.proof FROM under u JOIN ranked r ON r.tree = u.g),
{_climb('above', 'middle', 'upper')}
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, root.h AS root, sha256(a.proof) AS proof_sha256, a.node AS folded_root, a.node = root.h AS verified
FROM placed p JOIN above a ON a.row = p.row JOIN subroots s ON s.tree = p.g, (SELECT h FROM upper WHERE n = 1) root
"""

SQL["op4_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS run FROM starts),
firsts AS (SELECT run, min(doc_id) AS first_id FROM windows GROUP BY run),
gone AS (SELECT DISTINCT w.doc_id, w.i + k.k AS place FROM windows w JOIN firsts f ON f.run = w.run AND f.first_id < w.doc_id, range(0, 13) k(k)),
listed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d),
kept AS (
  SELECT l.doc_id, count(g.place) AS n_removed, string_agg(l.word, ' ' ORDER BY l.place) FILTER (WHERE g.place IS NULL) AS rest
  FROM listed l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.place = l.place GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.rest, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

SQL["op10_minhash"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, reach.r FROM reach JOIN both_ways l ON l.a = reach.doc_id),
component AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN component c ON c.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""
