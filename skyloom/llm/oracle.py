"""SQL forms, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from skyloom.llm.decontamination import LEAST, MASKS, WINDOW

_WORD = r"[^\x20\x09-\x0D]+"

LINES = """
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
windows AS (SELECT doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS k
            FROM (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS i FROM docs WHERE len(ls) >= 3)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM later),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM docs),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(n, 0) AS n_removed, CASE WHEN ls IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN docs USING (doc_id) LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
"""

PHRASES = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 13], ' ') AS k
            FROM (SELECT doc_id, ws, unnest(range(len(ws) - 12)) AS i FROM docs WHERE len(ws) >= 13)),
later AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM later),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
"""

SIMILAR = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(len(ws) - 3)) AS i FROM docs WHERE len(ws) > 3)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM docs WHERE len(ws) BETWEEN 1 AND 3),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_have i JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * i.n >= 85 * (s.n + t.n - i.n)),
reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reached GROUP BY x) USING (doc_id)
"""


def _seeds(table: str, key: str) -> str:
    parts = []
    for number, mask in enumerate(MASKS):
        used = ", ".join(f"h[p + {i + 1}]" for i, x in enumerate(mask) if x == "1")
        parts.append(f"SELECT {key}, p, {number} AS mask, array_to_string([{used}], ' ') AS k "
                     f"FROM (SELECT {key}, h, unnest(range(len(h) - {mask.rindex('1')})) AS p FROM {table} WHERE len(h) > {mask.rindex('1')})")
    return " UNION ALL ".join(parts)


def _tokens(table: str, key: str) -> str:
    return (f"SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS h "
            f"FROM {table} WHERE text IS NOT NULL")


LEAKS = f"""
WITH docs AS ({_tokens('documents', 'doc_id')}), items AS ({_tokens('benchmark', 'item_id')}),
ds AS ({_seeds('docs', 'doc_id')}), bs AS ({_seeds('items', 'item_id')}),
lines AS (SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS off FROM ds JOIN bs USING (mask, k)),
aligned AS (SELECT doc_id, item_id, off, list_transform(range(greatest(0, -off), least(len(i.h), len(d.h) - off)), lambda j: (i.h[j + 1] = d.h[j + off + 1])::INT) AS same
            FROM lines JOIN docs d USING (doc_id) JOIN items i USING (item_id)),
best AS (SELECT doc_id, item_id, off, list_max(list_transform(range(len(same) - {WINDOW - 1}), lambda s: list_sum(same[s + 1:s + {WINDOW}]))) AS n
         FROM aligned WHERE len(same) >= {WINDOW})
SELECT doc_id, item_id, max(n)::INT AS n_equal, arg_min(off, (-n, off))::INT AS begins FROM best WHERE n >= {LEAST} GROUP BY doc_id, item_id
"""

def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


# bit by bit: the first element of each list is the state, the others only count
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: xor(c // 2, 3988292384::UBIGINT * (c % 2)))))"""


def _climb(nodes: str, walk: str, start: str, kids: str) -> str:
    """Per doc_id: from its node (tree, pos, proof, fold) up to the one node that is left."""
    return f"""{kids} AS (SELECT tree, lvl, pos // 3 AS run, list(d ORDER BY pos) AS ds, any_value(n) AS n FROM {nodes} WHERE n > 1 GROUP BY tree, lvl, pos // 3),
{walk} AS ({start} UNION ALL
  SELECT w.doc_id, w.tree, w.lvl + 1, w.pos // 3, proof || array_to_string(list_filter(ds, lambda d, i: i <> w.pos % 3 + 1), ''),
         sha256(array_to_string(list_transform(ds, lambda d, i: CASE WHEN i = w.pos % 3 + 1 THEN w.fold ELSE d END), '')), (w.n + 2) // 3
  FROM {walk} w JOIN {kids} k ON k.tree = w.tree AND k.lvl = w.lvl AND k.run = w.pos // 3 WHERE w.n > 1)"""


def _tree(name: str, start: str) -> str:
    return f"""{name} AS ({start} UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, lvl, pos // 3, n)"""


MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, {_leaf('text')} AS leaf, CASE WHEN {_CRC32} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS changed,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents),
{_tree('nodes', 'SELECT tree, 0 AS lvl, pos, leaf AS d, n FROM leaves')},
subroots AS (SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree('upper', "SELECT '' AS tree, 0 AS lvl, pos, d, n FROM subroots")},
{_climb('nodes', 'low', "SELECT doc_id, tree, 0 AS lvl, pos, '' AS proof, changed AS fold, n FROM leaves", 'kids')},
{_climb('upper', 'high', "SELECT doc_id, '' AS tree, 0 AS lvl, s.pos, proof, fold, s.n FROM low JOIN subroots s USING (tree) WHERE low.n = 1", 'upper_kids')}
SELECT doc_id, leaf, s.d AS subroot, u.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u.d AS verified
FROM leaves JOIN subroots s USING (tree) JOIN upper u ON u.n = 1 JOIN high USING (doc_id) WHERE high.n = 1
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(table: str, key: str) -> str:
    return (f"SELECT {key}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}')) AS term "
            f"FROM {table} WHERE text IS NOT NULL")


RANKED = f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM ({_terms('documents', 'doc_id')}) GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term),
m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM sizes, totals),
asked AS (SELECT item_id, term, count(*) AS q FROM ({_terms('benchmark', 'item_id')}) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 10
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

URLS = rf"""
WITH rules (h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
parts AS (SELECT row_number() OVER () AS r, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
          FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages)),
fits AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (r)
"""

ORACLE = {
    "op1_line_dedup": LINES,
    "op2_substring_dedup": PHRASES,
    "op7_ngram_jaccard_join": SIMILAR,
    "op10_decontamination": LEAKS,
    "op11_merkle_manifest": MANIFEST,
    "op12_ranked_search": RANKED,
    "op13_url_filters": URLS,
}
