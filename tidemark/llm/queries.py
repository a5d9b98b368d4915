"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, jaccard, langid, licences, lines, mixing, nearvec, packing, personal, suffixes

QUERIES = {
    "op1_nearest_neighbours": ann.op1,
    "op2_suffix_dedup": suffixes.op2,
    "op3_line_dedup": lines.op3,
    "op4_language_id": langid.op4,
    "op5_licence_scans": licences.op5,
    "op6_packing": packing.op6,
    "op7_jaccard_join": jaccard.op7,
    "op8_personal_data": personal.op8,
    "op9_mixing": mixing.op9,
    "op10_near_vectors": nearvec.op10,
}

#: Words of a text and what is reachable by links, as DuckDB writes them.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_REACH = """reach(a, b) AS (SELECT a, b FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.b)"""

_REPEATS = rf"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p + 1 : p + {suffixes.LENGTH}], ' ') AS x FROM w, unnest(range(greatest(0, len(ws) - {suffixes.LENGTH - 1}))) AS t(p)),
hit AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY x) AS lead, count(*) OVER (PARTITION BY x) AS n FROM win),
marked AS (SELECT doc_id, p, lead, sum(CASE WHEN p <= before + {suffixes.LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM
  (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM hit WHERE n > 1))
SELECT doc_id, min(p) AS start_word, max(p) + {suffixes.LENGTH} AS end_word, max(p) + {suffixes.LENGTH} - min(p) AS n_words, min(lead) AS first_doc_id FROM marked GROUP BY doc_id, g"""

_JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p + 1 : p + {jaccard.SHINGLE}], ' ') AS x FROM w, unnest(range(CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(1, len(ws) - {jaccard.SHINGLE - 1}) END)) AS t(p)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
rare AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY c, x) AS k FROM (SELECT *, count(*) OVER (PARTITION BY x) AS c FROM s)),
prefix AS (SELECT r.doc_id, x, n FROM rare r JOIN n USING (doc_id) WHERE k <= n - CAST(ceil({jaccard.PERCENT} * n / 100.0) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.x = b.x AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= {jaccard.PERCENT} * greatest(a.n, b.n)),
links AS (SELECT a, b FROM (SELECT c.a, c.b, na, nb, count(*) AS i FROM cand c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.x = x.x GROUP BY ALL)
  WHERE 100 * i >= {jaccard.PERCENT} * (na + nb - i)),
{_REACH}
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, coalesce(least(doc_id, min(b)), doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = doc_id GROUP BY doc_id"""

_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id < q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= {nearvec.THRESHOLD}),
n AS (SELECT a, count(*) AS n FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) GROUP BY 1),
{_REACH},
c AS (SELECT vec_id, coalesce(any_value(n), 0) AS n_links, coalesce(least(vec_id, min(b)), vec_id) AS component_id FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN reach ON reach.a = vec_id GROUP BY vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c"""

ORACLES: dict[str, str] = {
    "op2_suffix_dedup": _REPEATS,
    "op5_licence_scans": licences.sql(),
    "op7_jaccard_join": _JACCARD,
    "op10_near_vectors": _VECTORS,
}
