"""DuckDB SQL for the queries that SQL can express on whole tables.

``p4_``, ``p5_pieces``, ``p6_decontaminated``, ``p7_`` and ``p8_`` have none: they are tested against brute
force, exact round trips and held-out accuracy in ``tests/llm``.
"""

_RECORDS = """
rec AS (
  SELECT rec_table, rec_id, min(text) AS text FROM (
    SELECT 'chunks' AS rec_table, CAST(chunk_pos AS VARCHAR) AS rec_id, text FROM chunks
    UNION ALL SELECT 'questions_sme_v3', id, answer FROM questions_sme_v3)
  WHERE rec_id IS NOT NULL GROUP BY 1, 2),
post AS (
  SELECT rec_table, rec_id, term, count(*) AS tf
  FROM (SELECT rec_table, rec_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS term FROM rec) GROUP BY 1, 2, 3),
st AS (SELECT rec_table, term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY 1, 2),
sz AS (SELECT rec_table, CAST(count(*) AS DOUBLE) AS n FROM rec GROUP BY 1),
sc AS (
  SELECT rec_table, rec_id, term, tf, df,
         tf * (log2(n / df) + log2(1 - exp(-CAST(cf AS DOUBLE) / n))) AS score
  FROM post JOIN st USING (rec_table, term) JOIN sz USING (rec_table))
"""

_SHARED = f"""{_RECORDS.split("post AS")[0].rstrip().rstrip(",")},
win AS (SELECT rec_table, rec_id, i, substr(text, i, 200) AS w FROM (SELECT *, unnest(range(1, length(text) - 198)) AS i FROM rec WHERE length(text) >= 200)),
two AS (SELECT md5_number(w) AS h FROM win GROUP BY 1 HAVING min(rec_table || ' ' || rec_id) <> max(rec_table || ' ' || rec_id)),
hit AS (SELECT rec_table, rec_id, i FROM win WHERE md5_number(w) IN (SELECT h FROM two)),
cov AS (SELECT rec_table, rec_id, sum(least(200, coalesce(nx - i, 200))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY rec_table, rec_id ORDER BY i) AS nx FROM hit) GROUP BY 1, 2)
"""

_PLACES = """
one AS (
  SELECT query_id, retriever, chunk_id, max(score) AS score FROM hits
  WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND retriever IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2, 3),
pl AS (
  SELECT *, rank() OVER (PARTITION BY query_id, retriever ORDER BY score DESC)
            + (count(*) OVER (PARTITION BY query_id, retriever, score) - 1) / 2.0 AS place FROM one),
lists AS (SELECT query_id, CAST(count(DISTINCT retriever) AS DOUBLE) AS k FROM one GROUP BY 1),
items AS (SELECT query_id, chunk_id, sum(place) AS wp, count(*) AS n_scores FROM pl GROUP BY 1, 2),
sizes AS (SELECT query_id, CAST(count(*) AS DOUBLE) AS m FROM items GROUP BY 1),
pts AS (
  SELECT query_id, chunk_id, n_scores, k, k * m - wp - (k - n_scores) * (m + 1) / 2.0 AS points
  FROM items JOIN lists USING (query_id) JOIN sizes USING (query_id))
"""

_GRAMS = r"""
d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
h AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM heldout_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
dg AS (SELECT id, i, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
hg AS (SELECT id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM h WHERE len(w) >= 12))
"""

ORACLE_SQL = {
    "p1_found": f"WITH {_RECORDS} SELECT rec_table, rec_id, term FROM sc WHERE tf >= 3 AND df <= 4",
    "p1_ranked_terms": f"""WITH {_RECORDS}
SELECT rec_table, rec_id, row_number() OVER (PARTITION BY rec_table, rec_id ORDER BY round(score, 6) DESC, term) AS rank,
       term, tf, df, round(score, 4) AS score FROM sc""",
    "p2_found": f"""WITH {_PLACES},
lead AS (SELECT query_id, chunk_id, k FROM pts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY points DESC, chunk_id) = 1),
top AS (SELECT query_id, chunk_id, count(*) AS n_top, count(*) FILTER (place = 1) AS firsts,
               max(retriever) FILTER (place = 2) AS second_in, max(retriever) FILTER (place = 1) AS first_in
        FROM pl WHERE place <= 10 GROUP BY 1, 2)
SELECT l.query_id, l.chunk_id FROM lead l JOIN top t USING (query_id, chunk_id)
WHERE k >= 3 AND firsts = k - 1 AND second_in IS NOT NULL
  AND EXISTS (SELECT 1 FROM top a WHERE a.query_id = l.query_id AND a.firsts = 1 AND a.n_top = 1 AND a.first_in = t.second_in)""",
    "p2_fused": f"""WITH {_PLACES}
SELECT query_id, chunk_id, n_scores, points, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, chunk_id) AS rank FROM pts""",
    "p3_found": f"WITH {_SHARED} SELECT rec_table, rec_id FROM cov",
    "p3_shared": f"""WITH {_SHARED} SELECT rec_table, rec_id, length(text) AS n_chars, coalesce(n, 0) AS shared_chars,
  CASE WHEN length(text) > 0 THEN round(coalesce(n, 0) / length(text), 4) ELSE 0.0 END AS shared_share FROM rec LEFT JOIN cov USING (rec_table, rec_id)""",
    "p5_found": r"""
WITH t AS (
  SELECT DISTINCT 'chunks' AS rec_table, CAST(chunk_pos AS VARCHAR) AS rec_id, text FROM chunks WHERE chunk_pos IS NOT NULL
  UNION
  SELECT 'extracted_docs', sha256 || ':' || (i - 1), chunks[i].text
  FROM (SELECT sha256, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM extracted_docs WHERE sha256 IS NOT NULL)),
s AS (SELECT rec_table, rec_id, text,
             list_max(list_transform(string_split(regexp_replace(text, '([.!?])[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '\1' || chr(10), 'g'), chr(10)), lambda x: length(x))) AS stretch
      FROM t WHERE floor(length(text) / 3.5) + 1 > 400)
SELECT rec_table, rec_id, CASE WHEN floor(stretch / 3.5) + 1 > 400 THEN 'forced' ELSE 'natural' END AS cut_kind FROM s""",
    "p6_found": f"WITH {_GRAMS} SELECT DISTINCT hg.id AS item_id, dg.id AS doc_id FROM hg JOIN dg USING (g)",
    # the items of the tables have twelve words or more and no script without spaces, so runs of words are all there is to find
    "p6_extent": f"""WITH {_GRAMS},
hit AS (SELECT dg.id AS doc_id, i, hg.id AS item_id FROM dg JOIN (SELECT DISTINCT id, g FROM hg) hg USING (g)),
cov AS (SELECT doc_id, count(DISTINCT pos) AS matched_words FROM (SELECT doc_id, unnest(range(i, i + 12)) AS pos FROM hit) GROUP BY 1),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items FROM hit GROUP BY 1)
SELECT doc_id, len(w) AS n_words, matched_words, n_items FROM cov JOIN n USING (doc_id) JOIN d ON d.id = doc_id""",
}
