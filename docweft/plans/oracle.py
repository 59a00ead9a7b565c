"""DuckDB SQL of the queries, written from the definitions and not from the Spark plans.

No SQL: ``section_cut``, ``index_append_idempotent``'s engine, encoders and streams have none or only SQL for
their result; those are also tested on literal rows.
"""

from __future__ import annotations

from docweft.functions import text as T
from docweft.plans.queries import SAMPLES

_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_W0 = _WS[:-1] + "*"
_TOKEN = r"[a-z]+\d+|\d[\d,\.]*|[a-z]+"

_C = "c AS (SELECT DISTINCT * FROM chunks WHERE chunk_pos IS NOT NULL)"
_Q = "q AS (SELECT DISTINCT id AS query_id, question, answer, stratum, gold_chunks, evidence, CAST(substr(id, 2) AS BIGINT) AS qnum FROM questions_sme_v3 WHERE id IS NOT NULL)"
_A = "a AS (SELECT DISTINCT * FROM answers WHERE answer_id IS NOT NULL)"
_X = "x AS (SELECT DISTINCT * FROM extracted_docs WHERE sha256 IS NOT NULL)"
_XC = f"{_X}, xc AS (SELECT sha256, filename, i - 1 AS ordinal, chunks[i] AS ch, substr(sha256, 1, 8) || ':' || (i - 1) AS chunk_id FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM x))"
_L = """hl AS (
  SELECT query_id, retriever AS source, chunk_id AS chunk_pos, max(score) AS score FROM hits
  WHERE score IS NOT NULL AND query_id IS NOT NULL AND retriever IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2, 3),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_pos) AS rank FROM hl)"""


def _alias_case(x: str) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, vs in T.ALIASES.items() for v in vs)
    return f"(VALUES {rows}) AS {x}(k, v)"


def _postings(corpus: str = "c", aliases: bool = True) -> str:
    """``tk``: one row per token of a document with aliases; ``p`` and ``dl``."""
    extra = f" UNION ALL SELECT t.chunk_pos, al.v FROM tk0 t JOIN {_alias_case('al')} ON t.term = al.k" if aliases else ""
    return f"""tk0 AS (SELECT chunk_pos, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM {corpus}),
tk AS (SELECT chunk_pos, term FROM tk0{extra}),
p AS (SELECT chunk_pos, term, count(*) AS tf FROM tk GROUP BY 1, 2),
dl AS (SELECT {corpus}.chunk_pos, count(tk.term) AS dl FROM {corpus} LEFT JOIN tk USING (chunk_pos) GROUP BY 1)"""


def _bm25(corpus: str = "c") -> str:
    return f"""{_postings(corpus)},
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tm AS (SELECT term, count(*) AS df, greatest(1e-6, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1)) AS idf FROM p, st GROUP BY term, n),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '{_TOKEN}')) AS term FROM q) GROUP BY 1, 2),
bs AS (SELECT query_id, chunk_pos, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
       FROM qt JOIN tm USING (term) JOIN p USING (term) JOIN dl USING (chunk_pos), st GROUP BY 1, 2),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_pos) AS bm25_rank FROM bs)"""


_DENSE = """v AS (SELECT vec_id AS chunk_pos, embedding AS vec FROM embeddings WHERE vec_id IN (SELECT chunk_pos FROM c)),
dq AS (SELECT q.*, e.embedding AS qvec FROM q JOIN embeddings e ON e.vec_id = q.qnum),
ds AS (SELECT query_id, chunk_pos, round(list_sum(list_transform(list_zip(CAST(qvec AS DOUBLE[]), CAST(vec AS DOUBLE[])), lambda z: z[1] * z[2])), 6) AS sim
       FROM dq, v WHERE dq.qnum <> v.chunk_pos),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_pos) AS dense_place FROM ds)"""

_HYBRID = f"""{_C}, {_Q}, {_DENSE}, {_bm25()},
own AS (SELECT query_id, qnum FROM dq),
b50 AS (SELECT query_id, chunk_pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_pos) AS bm25_rank
        FROM bs LEFT JOIN own USING (query_id) WHERE qnum IS NULL OR qnum <> chunk_pos QUALIFY bm25_rank <= 50),
d50 AS (SELECT query_id, chunk_pos, dense_place FROM dr WHERE dense_place <= 50),
fu AS (SELECT query_id, chunk_pos, bm25_rank, dense_place, coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + dense_place), 0) AS rrf_score
       FROM b50 FULL JOIN d50 USING (query_id, chunk_pos)),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, bm25_rank NULLS LAST, dense_place NULLS LAST) AS place FROM fu)"""

_TWO = f"""{_L},
fu AS (SELECT query_id, chunk_pos, b.rank AS bm25_rank, d.rank AS dense_place, coalesce(1.0 / (60 + b.rank), 0) + coalesce(1.0 / (60 + d.rank), 0) AS rrf_score
       FROM (SELECT * FROM l WHERE source = 'bm25') b FULL JOIN (SELECT * FROM l WHERE source = 'dense') d USING (query_id, chunk_pos)),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, bm25_rank NULLS LAST, dense_place NULLS LAST) AS place FROM fu)"""


def _rerank(head: int, out: str) -> str:
    return f"""{out} AS (SELECT fr.query_id, fr.chunk_pos, place, row_number() OVER (PARTITION BY fr.query_id ORDER BY (place > {head})::INT,
        CASE WHEN place <= {head} THEN ce.score END DESC NULLS LAST, place) AS reranked
  FROM fr LEFT JOIN (SELECT * FROM l WHERE source = 'cross_encoder') ce ON fr.query_id = ce.query_id AND fr.chunk_pos = ce.chunk_pos)"""


_GOLD = "g AS (SELECT DISTINCT query_id, unnest(gold_chunks) AS chunk_pos FROM q)"


def _first(source: str, where: str = "true") -> str:
    return f"""{_Q}, {_L}, {_GOLD},
fg AS (SELECT l.query_id, min(rank) AS first_rank FROM l JOIN g USING (query_id, chunk_pos) WHERE source = '{source}' GROUP BY 1),
fk AS (SELECT q.query_id, stratum, first_rank FROM q LEFT JOIN fg USING (query_id) WHERE {where})"""


_ANSWERABLE = "len(gold_chunks) > 0"
_METRICS = """count(*) AS n_questions, """ + ", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1.0 ELSE 0 END), 6) AS recall_at_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr"
_ALL = f"""{_Q}, {_L}, {_GOLD},
fg AS (SELECT l.query_id, source, min(rank) AS first_rank FROM l JOIN g USING (query_id, chunk_pos) GROUP BY 1, 2),
fk AS (SELECT s.source, q.query_id, first_rank FROM q, (VALUES ('bm25'), ('dense'), ('cross_encoder'), ('legacy_bm25')) s(source) LEFT JOIN fg ON fg.query_id = q.query_id AND fg.source = s.source WHERE {_ANSWERABLE}),
me AS (SELECT source, {_METRICS} FROM fk GROUP BY 1)"""
_RR = f"""{_Q}, {_GOLD}, {_TWO}, {_rerank(10, 'r10')}, {_rerank(15, 'r15')}, {_rerank(20, 'r20')},
ra AS (SELECT 10 AS head, * FROM r10 UNION ALL SELECT 15, * FROM r15 UNION ALL SELECT 20, * FROM r20),
qa AS (SELECT * FROM q WHERE {_ANSWERABLE}),
fg AS (SELECT head, query_id, min(reranked) AS first_rank FROM ra JOIN g USING (query_id, chunk_pos) GROUP BY 1, 2),
fk AS (SELECT h.head, qa.query_id, first_rank FROM qa, (VALUES (10), (15), (20)) h(head) LEFT JOIN fg ON fg.head = h.head AND fg.query_id = qa.query_id),
b0 AS (SELECT query_id, min(place) AS first_rank FROM fr JOIN g USING (query_id, chunk_pos) GROUP BY 1),
ba AS (SELECT qa.query_id, first_rank FROM qa LEFT JOIN b0 USING (query_id))"""

_FURNITURE = rf"(?i)^{_W0}(page{_WS}\pN+({_WS}of{_WS}\pN+)?|\pN+{_W0}\|{_W0}page|\pN+){_W0}$".replace("\\pN", "\\p{Nd}")
_DOCLINES = "dlines AS (SELECT doc_id, i - 1 AS line_no, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)))"
_TRIM = rf"regexp_replace(%s, '^{_WS}|{_WS}$', '', 'g')"
_STREAM = f"{_DOCLINES}, cl AS (SELECT * FROM (SELECT doc_id, line_no, {_TRIM % 'line'} AS line FROM dlines) WHERE length(line) > 0 AND NOT regexp_matches(line, '{_FURNITURE}')), sm AS (SELECT doc_id, string_agg(line, ' ' ORDER BY line_no) AS stream FROM cl GROUP BY 1)"
_SPLIT = rf"string_split(regexp_replace(%s, '([.!?]){_WS}([A-Z•●\-])', '\1' || chr(1) || '\2', 'g'), chr(1))"
_PACK = f"""{_STREAM},
ss AS (SELECT doc_id, stream, list_filter({_SPLIT % 'stream'}, lambda s: length(s) > 0) AS sents FROM sm),
pk AS (SELECT doc_id, stream, list_reduce(list_transform(sents, lambda s: [s]), lambda acc, x: CASE
         WHEN floor(length('doc' || chr(10) || acc[-1] || ' ' || x[1]) / 3.5) + 1 > 400 THEN list_concat(acc, x)
         ELSE list_concat(acc[:-2], [acc[-1] || ' ' || x[1]]) END) AS bodies FROM ss),
pc AS (SELECT doc_id, stream, i - 1 AS ordinal, 'doc' || chr(10) || bodies[i] AS text, bodies[i] AS body FROM (SELECT *, unnest(range(1, len(bodies) + 1)) AS i FROM pk))"""

_NATION = "n AS (SELECT r_name, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)"
_ORPHANS = "length(regexp_replace(x, '[^.]', '', 'g'))"
_FRONT = r"""(len(list_filter(string_split_regex(text, '\s+'), lambda t: length(t) > 0)) > 0 AND (
  len(list_filter(string_split_regex(text, '\s+'), lambda t: regexp_matches(t, '^\.+$'))) >= 0.30 * len(list_filter(string_split_regex(text, '\s+'), lambda t: length(t) > 0))
  OR (len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '(?:\.\s*){4,}'))) > 0 AND
      2 * len(list_filter(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '(?:\.\s*){4,}')), lambda s: regexp_matches(trim(regexp_replace(s, '(?:\.\s*){4,}', ' ', 'g')), '^\s*\d+(?:\.\d+)*\s+\S[^|]*?\s+\d+\s*$')))
      >= len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '(?:\.\s*){4,}'))))))"""
_UTOK = f"list_filter(string_split_regex(%s, '{_WS}'), lambda t: length(t) > 0)"
_NUM = r"regexp_matches(t, '\d') AND regexp_matches(t, '^[\d,.()%\-+]+$')"
_DENSITY = f"CASE WHEN len({_UTOK}) > 0 THEN len(list_filter({_UTOK}, lambda t: {_NUM})) / len({_UTOK}) ELSE 0.0 END"


def _density(x: str) -> str:
    return _DENSITY.replace("%s", x)


_GATED = f"""gt AS (SELECT *, {_FRONT} AS front,
   CASE WHEN {_FRONT} THEN 0.0 ELSE {_density(r"regexp_replace(text, '(?:\.\s*){4,}', ' ', 'g')")} END AS dens,
   regexp_matches(text, '\\bcol\\d+\\s*:') OR regexp_matches(text, ':\\s*(?:ted|ing|tion|ed|ly|ment|ness)\\b') OR regexp_matches(text, '\\|\\s*\\.\\d') AS garbled,
   len(list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda s: contains(s, '|')),
       lambda s: list_transform(list_filter(string_split(s, '|')[2:], lambda u: contains(u, ':')), lambda u: {_TRIM % "string_split(u, ':')[1]"})),
       lambda h: len(h) >= 2 AND len(list_distinct(h)) < len(h))) > 0 AS ambiguous FROM c),
gs AS (SELECT *, dens >= 0.35 AND NOT contains(text, ':') AND NOT contains(text, '|') AS orphan FROM gt)""".replace("\\\\", "\\")

_NA = r"trim(regexp_replace(lower(%s), '[^a-z0-9@.+]+', ' ', 'g'))"
_NW = r"trim(regexp_replace(lower(%s), '[^a-z0-9]+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_CSTOP = "[" + ", ".join(f"'{w}'" for w in T.CANDIDATE_STOP_WORDS) + "]"

_SPANS = f"""{_C}, {_Q},
qw AS (SELECT query_id, string_split({_NA % 'answer'}, ' ') AS w FROM q WHERE answer IS NOT NULL),
s1 AS (SELECT query_id, w, unnest(range(0, len(w) - 3)) AS start FROM qw WHERE len(w) >= 4),
s2 AS (SELECT query_id, w, start, unnest(range(4, len(w) - start + 1)) AS size FROM s1),
sp AS (SELECT query_id, start, size, array_to_string(w[start + 1:start + size], ' ') AS span FROM s2),
ct AS (SELECT chunk_pos, {_NA % 'text'} AS t FROM c WHERE text IS NOT NULL),
sh AS (SELECT query_id, start, size, span, list_sort(list(chunk_pos)) AS chunks FROM sp JOIN ct ON contains(t, span) GROUP BY 1, 2, 3, 4 HAVING count(*) <= 3),
vb AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY size DESC, start) = 1),
atk AS (SELECT DISTINCT query_id, unnest(string_split({_NA % 'answer'}, ' ')) AS tok FROM q WHERE answer IS NOT NULL),
an AS (SELECT * FROM atk WHERE length(tok) > 2 AND NOT list_contains({_STOP}, tok) AND regexp_matches(tok, '[@0-9]')),
cw AS (SELECT DISTINCT chunk_pos, unnest(string_split(t, ' ')) AS tok FROM ct),
ch AS (SELECT query_id, tok AS anchor, list_sort(list(chunk_pos)) AS chunks FROM an JOIN cw USING (tok) GROUP BY 1, 2
       HAVING count(*) <= least(3, greatest(1, floor((SELECT count(*) FROM c) * 0.15)))),
ab AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(anchor) DESC, anchor) = 1)"""

_SQ = rf"trim(regexp_replace(lower(%s), '{_WS}', ' ', 'g'))"
_LAYER = f"""{_A}, {_C},
ga AS (SELECT *, coalesce(answer, '') AS ans, len(coalesce(gold_chunks, [])) = 0 AS none,
        list_filter(list_distinct(regexp_extract_all({_SQ % "coalesce(answer, '')"}, '[a-z0-9@.]+')), lambda t: length(t) > 3 OR regexp_matches(t, '[0-9@]')) AS toks FROM a),
gw AS (SELECT answer_id, unnest(toks) AS tok FROM ga),
gg AS (SELECT DISTINCT answer_id, unnest(gold_chunks) AS chunk_pos FROM a),
gk AS (SELECT DISTINCT chunk_pos, unnest(regexp_extract_all({_SQ % 'text'}, '[a-z0-9@.]+')) AS tok FROM c),
gn AS (SELECT DISTINCT answer_id, tok FROM gg JOIN gk USING (chunk_pos)),
gm AS (SELECT answer_id, count(*) AS met FROM gw JOIN gn USING (answer_id, tok) GROUP BY 1),
lr AS (SELECT ga.*, coalesce(met, 0) / greatest(1, len(toks)) AS ratio, contains(lower(ans), 'not_in_documents') AS a_abstained FROM ga LEFT JOIN gm USING (answer_id)),
la AS (SELECT *, CASE WHEN none THEN CASE WHEN a_abstained THEN 'PASS' ELSE 'FAIL' END WHEN a_abstained THEN 'FAIL'
        WHEN ratio >= 0.5 THEN 'PASS' WHEN ratio >= 0.3 THEN 'WEAK' ELSE 'FAIL' END AS a_verdict,
        CASE WHEN NOT none AND NOT a_abstained THEN ratio END AS a_ratio FROM lr)"""
_JUDGED = f"""{_LAYER},
jd AS (SELECT *, CASE WHEN length(answer) % 11 = 0 THEN 'PARSE_ERROR' WHEN a_abstained THEN CASE WHEN len(gold_chunks) = 0 THEN 'CORRECT_ABSTENTION' ELSE 'WRONG_ABSTENTION' END
        WHEN length(answer) % 3 = 0 THEN 'UNFAITHFUL' ELSE 'FAITHFUL' END AS b_verdict FROM la WHERE answer IS NOT NULL),
rc AS (SELECT *, CASE a_verdict WHEN 'PASS' THEN 'PASS' WHEN 'WEAK' THEN 'REVIEW' ELSE 'FAIL' END AS a_bin,
        CASE WHEN b_verdict IN ('FAITHFUL', 'CORRECT_ABSTENTION') THEN 'PASS' WHEN b_verdict IN ('UNFAITHFUL', 'WRONG_ABSTENTION') THEN 'FAIL' ELSE 'REVIEW' END AS b_bin FROM jd),
rv AS (SELECT *, a_bin = b_bin AS agree, a_bin <> b_bin OR a_bin = 'REVIEW' OR b_bin = 'REVIEW' OR none OR b_verdict = 'PARSE_ERROR' AS needs_review FROM rc)"""
_RUN = """count(*) FILTER (NOT none) AS answerable, count(*) FILTER (NOT none AND a_verdict = 'PASS') AS passed,
  round(100.0 * count(*) FILTER (NOT none AND a_verdict = 'PASS') / greatest(1, count(*) FILTER (NOT none)), 1) AS passed_pct"""
_STATS = "count({v}) AS n, round(avg({v}), 2) AS mean, round(median({v}), 2) AS median, round(min({v}), 2) AS min, round(max({v}), 2) AS max"
_PAGES = """pl AS (SELECT doc, coalesce(page, 0) AS page, chunk_pos AS line_no, text AS line FROM c WHERE doc IS NOT NULL AND text IS NOT NULL),
lo AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start FROM pl)"""

def _quoted(x: str) -> str:
    return " || chr(10) || ".join(f"'{p}'" for p in x.split("\n"))


_SAMPLES = "(VALUES " + ", ".join(f"({k}, {_quoted(x)})" for k, x in SAMPLES) + ") AS sa(key, text)"
_C0 = f"c AS (SELECT DISTINCT chunk_pos, text FROM chunks WHERE chunk_pos IS NOT NULL UNION ALL SELECT * FROM {_SAMPLES})"

ORACLE_SQL = {
    "tokenize_terms": f"WITH {_C}, {_postings(aliases=False)} SELECT chunk_pos, term, tf, dl FROM p JOIN dl USING (chunk_pos)",
    "tokenize_alias_expand": f"WITH {_C}, {_postings()} SELECT chunk_pos, term, tf, dl FROM p JOIN dl USING (chunk_pos)",
    "norm_variants": f"WITH {_C} SELECT chunk_pos, {_NA % 'text'} AS anchor, {_SQ % 'text'} AS spaces, {_NW % 'text'} AS words FROM c",
    "digit_density": f"WITH {_C} SELECT chunk_pos, CASE WHEN text IS NOT NULL THEN round({_density('text')}, 6) ELSE 0.0 END AS density FROM c",
    "furniture_filter": f"WITH {_DOCLINES} SELECT * FROM dlines WHERE regexp_matches(line, '{_FURNITURE}')",
    "heading_predicate": rf"""WITH {_C},
ln AS (SELECT chunk_pos, i - 1 AS line_no, s[i] AS line, {_TRIM % 's[i]'} AS t FROM (SELECT chunk_pos, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT chunk_pos, string_split(text, chr(10)) AS s FROM c WHERE text IS NOT NULL))),
w AS (SELECT *, {_UTOK.replace('%s', 't')} AS ws FROM ln)
SELECT chunk_pos, line_no, line FROM w WHERE length(t) BETWEEN 1 AND 80 AND NOT regexp_matches(t, '[.;,:]$') AND len(ws) BETWEEN 1 AND 10
  AND (regexp_matches(t, '^{_W0}(\p{{Nd}}+(?:\.\p{{Nd}}+)*)\.?{_WS}[^\s]') OR t LIKE '%?' OR len(list_filter(ws, lambda x: upper(x[1]) = x[1] AND lower(x[1]) <> x[1])) >= greatest(1, len(ws) // 2))""",
    "sentence_split": f"WITH {_C}, s AS (SELECT chunk_pos, {_SPLIT % 'text'} AS x FROM c WHERE text IS NOT NULL) SELECT chunk_pos, i - 1 AS sent_no, x[i] AS sentence FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM s)",
    "paragraph_split": rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n{_W0}\n'), lambda p: {_TRIM % "regexp_replace(regexp_replace(p, '[ ' || chr(9) || ']+', ' ', 'g'), 'a^', '')"}), lambda p: length(p) >= 15) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, i - 1 AS par_no, x[i] AS paragraph FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM s)""",
    "heading_body_split": f"WITH {_C} SELECT chunk_pos, string_split(text, chr(10))[1] AS heading, CASE WHEN text IS NULL OR instr(text, chr(10)) = 0 THEN '' ELSE substr(text, instr(text, chr(10)) + 1) END AS body FROM c",
    "snippets": rf"WITH {_C}, f AS (SELECT chunk_pos, text, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS t FROM c) SELECT chunk_pos, CASE WHEN length(t) > 70 THEN substr(t, 1, 70) || '…' ELSE t END AS snippet, CAST(floor(length(text) / 3.5) + 1 AS INT) AS n_tokens FROM f",
    "human_sizes": "SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.0f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS size FROM (SELECT doc_id, CAST(length(text) * 1024 AS DOUBLE) AS b FROM documents) WHERE b IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL",
    "content_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "bm25_term_stats": f"WITH {_C}, {_Q}, {_bm25()} SELECT term, df, round(idf, 6) AS idf FROM tm",
    "bm25_doc_stats": f"WITH {_C}, {_postings()} SELECT chunk_pos, dl FROM dl",
    "bm25_corpus_stats": f"WITH {_C}, {_postings()} SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM dl",
    "bm25_scores": f"WITH {_C}, {_Q}, {_bm25()} SELECT query_id, chunk_pos, score FROM bs",
    "bm25_topk": f"WITH {_C}, {_Q}, {_bm25()} SELECT query_id, chunk_pos, score, bm25_rank FROM br WHERE bm25_rank <= 10",
    "bm25_legacy_rank": rf"""WITH {_C}, {_Q},
lt AS (SELECT chunk_pos, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM c), lp AS (SELECT chunk_pos, term, count(*) AS tf FROM lt GROUP BY 1, 2),
ld AS (SELECT c.chunk_pos, count(term) AS dl FROM c LEFT JOIN lt USING (chunk_pos) GROUP BY 1), ls AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM ld),
li AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM lp, ls GROUP BY term, n),
lq AS (SELECT query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM q),
sc AS (SELECT query_id, chunk_pos, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM lq JOIN li USING (term) JOIN lp USING (term) JOIN ld USING (chunk_pos), ls GROUP BY 1, 2),
al AS (SELECT q.query_id, c.chunk_pos, coalesce(score, 0.0) AS score FROM q CROSS JOIN c LEFT JOIN sc ON sc.query_id = q.query_id AND sc.chunk_pos = c.chunk_pos)
SELECT query_id, chunk_pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_pos) AS rank FROM al QUALIFY rank <= 10""",
    "l2_normalize": "SELECT vec_id, i - 1 AS dim, round(CAST(embedding[i] AS DOUBLE) / greatest(1e-9, n), 6) AS x FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "unit_norm_gate": "SELECT count(*) AS n_vectors, count(*) FILTER (abs(n - 1) > 1e-5) AS n_off, count(*) FILTER (abs(n - 1) > 1e-5) = 0 AS passed FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS n FROM embeddings)",
    "dense_topk": f"WITH {_C}, {_Q}, {_DENSE} SELECT query_id, chunk_pos, sim, dense_place FROM dr WHERE dense_place <= 10",
    "rrf_fuse": f"WITH {_L}, s AS (SELECT query_id, chunk_pos, sum(1.0 / (60 + rank)) AS sc, list_sort(list(source || ':' || lpad(CAST(rank AS VARCHAR), 9, '0'))) AS seen FROM l GROUP BY 1, 2) SELECT query_id, chunk_pos, round(sc, 9) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 12) DESC, seen) AS place FROM s",
    "rrf_weighted": f"WITH {_L}, s AS (SELECT query_id, chunk_pos, sum(CASE source WHEN 'bm25' THEN 1.0 WHEN 'dense' THEN 2.0 WHEN 'cross_encoder' THEN 0.5 ELSE 0.25 END / (60 + rank)) AS sc, list_sort(list(source || ':' || lpad(CAST(rank AS VARCHAR), 9, '0'))) AS seen FROM l GROUP BY 1, 2) SELECT query_id, chunk_pos, round(sc, 9) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 12) DESC, seen) AS place FROM s",
    "rrf_two_lists": f"WITH {_TWO} SELECT query_id, chunk_pos, bm25_rank, dense_place, round(rrf_score, 9) AS rrf_score, place FROM fr",
    "hybrid_search_topk": f"WITH {_HYBRID} SELECT query_id, chunk_pos, bm25_rank, dense_place, round(rrf_score, 9) AS rrf_score, place, doc, page FROM fr JOIN c USING (chunk_pos) WHERE place <= 5",
    "search_hits_considered": f"WITH {_HYBRID} SELECT query_id, CASE WHEN place <= 5 THEN 'hit' ELSE 'considered' END AS slot, place, chunk_pos FROM fr WHERE place <= 10",
    "bm25_only_fallback": f"WITH {_C}, {_Q}, {_bm25()} SELECT query_id, chunk_pos, bm25_rank, round(1.0 / (60 + bm25_rank), 9) AS rrf_score FROM br WHERE bm25_rank <= 5",
    "rerank_head_tail": f"WITH {_TWO}, {_rerank(10, 'r10')} SELECT query_id, chunk_pos, place, reranked FROM r10",
    "first_gold_rank": f"WITH {_first('bm25')} SELECT query_id, stratum, first_rank FROM fk",
    "recall_mrr": f"WITH {_ALL} SELECT * FROM me",
    "recall_by_stratum": f"WITH {_first('cross_encoder', _ANSWERABLE)} SELECT stratum, {_METRICS} FROM fk GROUP BY 1 UNION ALL SELECT 'all', {_METRICS} FROM fk",
    "legacy_evaluate": f"""WITH {_Q}, {_C}, {_L}, gx AS (SELECT DISTINCT query_id, u AS chunk_pos FROM (SELECT query_id, unnest(gold_chunks) AS u FROM q) WHERE u IN (SELECT chunk_pos FROM c)),
b AS (SELECT query_id, min(rank) AS r FROM l JOIN gx USING (query_id, chunk_pos) WHERE source = 'legacy_bm25' GROUP BY 1), n AS (SELECT count(*) AS n_total FROM q)
SELECT n_total, (SELECT count(DISTINCT query_id) FROM gx) AS n_graded, {", ".join(f"round((SELECT count(*) FROM b WHERE r <= {k}) / n_total, 6) AS recall_at_{k}" for k in (1, 3, 5, 10))}, round((SELECT sum(1.0 / r) FROM b) / n_total, 6) AS mrr FROM n""",
    "gold_coverage_at5": f"WITH {_Q}, {_L}, gx AS (SELECT DISTINCT query_id, unnest(gold_chunks) AS chunk_pos FROM q WHERE len(gold_chunks) > 1) SELECT gx.query_id, count(*) AS n_gold, count(t.chunk_pos) AS n_found FROM gx LEFT JOIN (SELECT query_id, chunk_pos FROM l WHERE source = 'bm25' AND rank <= 5) t ON gx.query_id = t.query_id AND gx.chunk_pos = t.chunk_pos GROUP BY 1",
    "k3_stress": f"WITH {_first('dense', _ANSWERABLE)} SELECT query_id, first_rank, CASE WHEN first_rank IS NULL OR first_rank > 5 THEN 'missed_at_5' ELSE 'beyond_3' END AS why FROM fk WHERE first_rank IS NULL OR first_rank > 3",
    "failure_list": f"WITH {_first('bm25', _ANSWERABLE)} SELECT query_id, first_rank FROM fk WHERE first_rank IS NULL OR first_rank > 5",
    "retriever_verdict": f"""WITH {_ALL}, b AS (SELECT * FROM me WHERE source = 'bm25'),
r AS (SELECT m.source, m.recall_at_1 >= b.recall_at_1 AND m.recall_at_3 >= b.recall_at_3 AND m.recall_at_5 >= b.recall_at_5 AND m.recall_at_10 >= b.recall_at_10 AND m.mrr >= b.mrr AS never_worse,
  round(m.recall_at_1 - b.recall_at_1, 6) AS delta_recall_at_1, round(m.recall_at_5 - b.recall_at_5, 6) AS delta_recall_at_5, round(m.mrr - b.mrr, 6) AS delta_mrr, m.recall_at_1 AS o1, m.mrr AS o2 FROM me m, b WHERE m.source <> 'bm25')
SELECT source, never_worse, delta_recall_at_1, delta_recall_at_5, delta_mrr FROM r ORDER BY never_worse DESC, o1 DESC, o2 DESC, source LIMIT 1""",
    "rerank_audit": f"""WITH {_RR} SELECT head, count(*) FILTER (coalesce(fk.first_rank, 999) < coalesce(ba.first_rank, 999)) AS improved, count(*) FILTER (coalesce(fk.first_rank, 999) > coalesce(ba.first_rank, 999)) AS worsened,
  count(*) FILTER (coalesce(ba.first_rank, 999) > 5 AND coalesce(fk.first_rank, 999) <= 5) AS rescued, count(*) AS n_questions FROM fk JOIN ba USING (query_id) GROUP BY 1""",
    "best_rerank_n": f"WITH {_RR}, mm AS (SELECT head, {_METRICS} FROM fk GROUP BY 1) SELECT head FROM mm ORDER BY recall_at_5 DESC, recall_at_3 DESC, mrr DESC, head LIMIT 1",
    "document_stream": f"WITH {_STREAM} SELECT doc_id, stream FROM sm",
    "pack_sentences": f"WITH {_PACK} SELECT doc_id, ordinal, text, CAST(floor(length(text) / 3.5) + 1 AS INT) AS n_tokens FROM pc",
    "over_budget_chunks": f"WITH {_PACK} SELECT doc_id, ordinal, CAST(floor(length(text) / 3.5) + 1 AS INT) AS n_tokens FROM pc WHERE floor(length(text) / 3.5) + 1 > 400",
    "chunk_offsets": f"WITH {_PACK} SELECT doc_id, ordinal, instr(stream, body) - 1 AS char_start, CASE WHEN instr(stream, body) > 0 THEN instr(stream, body) - 1 + length(body) ELSE -1 END AS char_end FROM pc",
    "line_offsets": f"WITH {_C}, {_PAGES} SELECT doc, line_no, line_start FROM lo",
    "page_of_offset": f"WITH {_C}, {_PAGES}, pt AS (SELECT doc, line_start + 100 AS \"at\" FROM lo) SELECT DISTINCT doc, \"at\", arg_max(lo.page, line_start) AS page FROM pt JOIN lo USING (doc) WHERE line_start <= \"at\" GROUP BY doc, \"at\"",
    "corpus_fingerprint": f"WITH {_C} SELECT substr(sha256(string_agg(chunk_pos || chr(0) || text, chr(10) ORDER BY chunk_pos)), 1, 16) AS fingerprint, count(*) AS n_chunks FROM c WHERE text IS NOT NULL",
    "tree_fingerprint": f"WITH {_C}, lf AS (SELECT chunk_pos, chunk_pos // 65536 AS run, sha256(chunk_pos || chr(0) || coalesce(text, chr(1))) AS h FROM c), rn AS (SELECT run, sha256(string_agg(h, chr(10) ORDER BY chunk_pos)) AS h FROM lf GROUP BY 1) SELECT substr(sha256(string_agg(h, chr(10) ORDER BY run)), 1, 16) AS tree_fingerprint FROM rn",
    "chunk_metrics": f"""WITH {_C}, t AS (SELECT *, floor(length(text) / 3.5) + 1 AS n FROM c), m AS (
  SELECT 'corpus' AS scope, 'all' AS name, count(*) AS n_chunks, count(DISTINCT doc) AS n_docs, max(n) AS max_tokens, floor(sum(n) / count(n)) AS mean_tokens FROM t
  UNION ALL SELECT 'kind', kind, count(*), count(DISTINCT doc), max(n), floor(sum(n) / count(n)) FROM t GROUP BY kind
  UNION ALL SELECT 'doc', doc, count(*), count(DISTINCT doc), max(n), floor(sum(n) / count(n)) FROM t GROUP BY doc) SELECT * FROM m""",
    "stable_chunk_ids": f"WITH {_XC} SELECT chunk_id, sha256, ordinal, ch.page AS page, ch.char_start AS char_start, ch.char_end AS char_end FROM xc",
    "document_row_ranges": f"WITH {_X}, n AS (SELECT sha256, len(chunks) AS n_chunks FROM x), r AS (SELECT *, coalesce(sum(n_chunks) OVER (ORDER BY sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_row FROM n) SELECT sha256, n_chunks, first_row, first_row + n_chunks AS end_row FROM r",
    "header_span": f"WITH {_NATION} SELECT DISTINCT r_name AS name, 0 AS start, 3 AS stop FROM n UNION ALL SELECT DISTINCT p_brand, 0, 1 FROM part",
    "merge_header_stack": f"WITH {_NATION} SELECT DISTINCT r_name, col_no, header FROM n, (VALUES (0, ''), (1, 'Key number'), (2, 'Note'), (3, 'Size units')) h(col_no, header)",
    "serialise_table": f"WITH {_NATION} SELECT r_name, string_agg(n_name || ' | Key number: ' || n_nationkey || ' | Size units: ' || n_nationkey * 1000, chr(10) ORDER BY n_nationkey) AS text FROM n GROUP BY 1",
    "serialise_labelled_stub": r"SELECT p_brand, string_agg(trim(regexp_replace(p_name, '\s+', ' ', 'g')) || ' | Size: ' || p_size || ' | Type: ' || trim(regexp_replace(p_type, '\s+', ' ', 'g')), chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1",
    "render_pipe_table": f"WITH {_NATION} SELECT r_name, '| col0 | Key number | Note | Size units |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |  | ' || n_nationkey * 1000 || ' |', chr(10) ORDER BY n_nationkey) AS text FROM n GROUP BY 1",
    "real_table_filter": f"WITH {_NATION} SELECT r_name, (4 + 1 + count(*) * 3) >= 0.4 * (12 + count(*) * 4) AS is_real, false AS header_is_real FROM n GROUP BY 1",
    "front_matter": f"SELECT key AS doc_id FROM (SELECT doc_id AS key, text FROM documents UNION ALL SELECT * FROM {_SAMPLES}) WHERE text IS NOT NULL AND {_FRONT}",
    "orphan_digit_wall": f"""WITH c AS (SELECT o_orderkey AS chunk_pos, concat_ws(' ', 'order', o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN 'status:' ELSE 'open' END) AS text FROM orders
  UNION ALL SELECT * FROM {_SAMPLES}), {_GATED} SELECT chunk_pos AS key FROM gs WHERE orphan""",
    "garbled_labels": f"WITH {_C0}, {_GATED} SELECT chunk_pos FROM gs WHERE garbled",
    "ambiguous_headers": f"WITH {_C0}, {_GATED} SELECT chunk_pos FROM gs WHERE ambiguous",
    "gate_flags": f"WITH {_C}, {_GATED} SELECT chunk_pos, CASE WHEN orphan THEN 'orphan' WHEN garbled THEN 'garbled' WHEN ambiguous THEN 'ambiguous' ELSE '' END AS gate FROM gs WHERE text IS NOT NULL",
    "gate_report": f"WITH {_C}, {_GATED} SELECT doc, count(*) AS n_blocks, count(*) FILTER (kind = 'table') AS n_tables, count(*) FILTER (text IS NOT NULL AND front) AS n_front_matter, count(*) FILTER (orphan) AS n_orphan, count(*) FILTER (garbled) AS n_garbled, count(*) FILTER (ambiguous) AS n_ambiguous, count(*) FILTER (kind = 'table') = 0 AS no_tables FROM gs GROUP BY 1",
    "gold_smear_gate": f"WITH {_Q}, {_C}, n AS (SELECT count(*) AS n FROM c), s AS (SELECT query_id, len(gold_chunks) AS k FROM q UNION ALL SELECT 'smeared', 4 + n // 4 FROM n) SELECT query_id FROM s, n WHERE k > greatest(3, n // 5)",
    "gold_missing_gate": f"WITH {_Q}, {_C}, {_GOLD} SELECT query_id, chunk_pos AS gold FROM g WHERE chunk_pos NOT IN (SELECT chunk_pos FROM c WHERE kind = 'clause')",
    "unique_id_gate": f"WITH {_XC} SELECT count(*) AS n_rows, count(DISTINCT chunk_id) AS n_ids FROM xc",
    "verbatim_label": f"WITH {_SPANS} SELECT query_id, span, unnest(chunks) AS chunk_pos FROM vb",
    "anchor_label": f"WITH {_SPANS} SELECT query_id, anchor, unnest(chunks) AS chunk_pos FROM ab",
    "autolabel_tiers": f"WITH {_SPANS} SELECT q.query_id, CASE WHEN span IS NOT NULL THEN 'VERBATIM' WHEN anchor IS NOT NULL THEN 'ANCHOR' ELSE 'ABSTAIN' END AS tier, coalesce(span, anchor, '') AS matched FROM q LEFT JOIN vb ON vb.query_id = q.query_id LEFT JOIN ab ON ab.query_id = q.query_id",
    "label_review": f"""WITH {_C}, {_Q.replace('q AS (', 'q0 AS (')}, q AS (SELECT query_id, answer, gold_chunks, evidence.matched_span AS ms FROM q0
  UNION ALL SELECT 'moved ' || query_id, answer, list_transform(gold_chunks, lambda x: x + 1), CASE WHEN qnum % 2 = 0 THEN evidence.matched_span END FROM q0), {_GOLD}, qs AS (SELECT q.*, ms AS span FROM q WHERE query_id IN (SELECT query_id FROM g)),
ok AS (SELECT DISTINCT g.query_id FROM g JOIN c USING (chunk_pos) JOIN qs USING (query_id) WHERE length(span) > 0 AND contains({_NW % 'c.text'}, {_NW % 'span'})),
tk AS (SELECT DISTINCT chunk_pos, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM c),
cm AS (SELECT tok FROM tk GROUP BY 1 HAVING count(*) > greatest(3, floor((SELECT count(*) FROM c) * 0.3))),
wt AS (SELECT DISTINCT query_id, tok FROM (SELECT query_id, unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS tok FROM qs WHERE coalesce(length(span), 0) = 0) WHERE length(tok) >= 4 AND tok NOT IN (SELECT tok FROM cm)),
hn AS (SELECT wt.query_id, tk.chunk_pos, count(*) AS n, bool_or(g.chunk_pos IS NOT NULL) AS own FROM wt JOIN tk USING (tok) LEFT JOIN g ON g.query_id = wt.query_id AND g.chunk_pos = tk.chunk_pos GROUP BY 1, 2),
ot AS (SELECT query_id, chunk_pos AS best_other, n AS n_other FROM hn WHERE NOT own AND query_id NOT IN (SELECT query_id FROM hn WHERE own) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_pos DESC) = 1)
SELECT query_id, 'span_absent' AS why, NULL::BIGINT AS best_other, NULL::BIGINT AS n_other FROM qs WHERE length(span) > 0 AND query_id NOT IN (SELECT query_id FROM ok)
UNION ALL SELECT query_id, 'other_chunk', best_other, n_other FROM ot WHERE n_other >= 2""",
    "answer_candidates": f"""WITH {_C}, {_Q}, w AS (SELECT DISTINCT query_id, tok FROM (SELECT query_id, unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS tok FROM q) WHERE NOT list_contains({_CSTOP}, tok)),
h AS (SELECT DISTINCT chunk_pos, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM c), s AS (SELECT query_id, chunk_pos, count(*) AS overlap FROM w JOIN h USING (tok) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, chunk_pos DESC) AS place FROM s QUALIFY place <= 6""",
    "weak_candidates": f"""WITH {_C}, {_Q}, w AS (SELECT DISTINCT query_id, tok FROM (SELECT query_id, unnest(string_split({_NA % 'answer'}, ' ')) AS tok FROM q) WHERE tok <> '' AND NOT list_contains({_STOP}, tok)),
h AS (SELECT DISTINCT chunk_pos, unnest(string_split({_NA % 'text'}, ' ')) AS tok FROM c), s AS (SELECT query_id, chunk_pos, count(*) AS overlap FROM w JOIN h USING (tok) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, chunk_pos DESC) AS place FROM s QUALIFY place <= 5""",
    "layer_a_verdict": f"WITH {_LAYER} SELECT answer_id, a_verdict, a_abstained, round(a_ratio, 4) AS a_ratio FROM la",
    "abstention_variants": f"WITH {_A} SELECT answer_id, starts_with({_TRIM % 'answer'}, 'NOT_IN_DOCUMENTS') AS prefix, contains(lower(answer), 'not_in_documents') AS anywhere, contains(lower(answer), 'not_in_documents') AND length(answer) - 16 > 25 AS laundered FROM a WHERE answer IS NOT NULL",
    "parse_judge": f"WITH {_JUDGED} SELECT answer_id, b_verdict FROM jd",
    "judge_verdicts": f"""WITH {_A}, {_C}, g AS (SELECT answer_id, unnest(gold_chunks) AS chunk_pos, unnest(range(1, len(gold_chunks) + 1)) AS i FROM a),
x AS (SELECT answer_id, string_agg('[' || n || '] ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY n) AS ctx FROM (SELECT answer_id, text, row_number() OVER (PARTITION BY answer_id ORDER BY i) AS n FROM g JOIN c USING (chunk_pos)) GROUP BY 1)
SELECT answer_id, CASE WHEN coalesce(answer, '') = '' THEN 'PARSE_ERROR' WHEN ctx IS NULL THEN 'CORRECT_ABSTENTION' WHEN contains(lower(ctx), lower(answer)) THEN 'FAITHFUL' ELSE 'UNFAITHFUL' END AS b_verdict FROM a LEFT JOIN x USING (answer_id)""",
    "judge_reconcile": f"WITH {_JUDGED} SELECT answer_id, a_bin, b_bin, agree, needs_review FROM rv",
    "agreement_report": f"""WITH {_JUDGED} SELECT count(*) AS n, count(*) FILTER (NOT none) AS n_answerable, round(avg(agree::INT), 6) AS agreement, count(*) FILTER (needs_review) AS n_review,
  {", ".join(f"round(avg((a_bin = '{x}')::INT) FILTER (NOT none), 6) AS a_{x.lower()}" for x in ("PASS", "FAIL", "REVIEW"))}, count(*) FILTER (none AND a_verdict = 'PASS') AS probes_right FROM rv""",
    "run_comparison": f"""WITH {_LAYER} SELECT prompt_version, {_RUN}, count(*) FILTER (NOT none AND a_abstained) AS wrong_abstentions, count(*) FILTER (a_abstained AND length(ans) - 16 > 25) AS laundered,
  count(*) FILTER (contains(lower(ans), '[general knowledge')) AS gk_labelled, count(*) FILTER (none) AS probes, count(*) FILTER (none AND a_verdict = 'PASS') AS probes_right FROM la GROUP BY 1""",
    "run_comparison_by_stratum": f"WITH {_LAYER} SELECT prompt_version, stratum, {_RUN} FROM la GROUP BY 1, 2",
    "run_churn": f"""WITH {_LAYER}, w AS (SELECT id, min(a_verdict) FILTER (prompt_version = 'v1') AS v1, min(a_verdict) FILTER (prompt_version = 'v2') AS v2, min(a_verdict) FILTER (prompt_version = 'v3') AS v3 FROM la GROUP BY 1)
SELECT * FROM w WHERE v1 IS DISTINCT FROM v2 OR v2 IS DISTINCT FROM v3""",
    "human_tally": f"""WITH {_LAYER}, h AS (SELECT a_verdict, CASE WHEN contains(lower(answer), lower(gold_answer)) THEN 'CORRECT' WHEN gold_answer IS NULL THEN 'LABEL ISSUE' ELSE 'UNGROUNDED' END AS v FROM la WHERE answer IS NOT NULL)
SELECT a_verdict, count(*) AS n, count(*) FILTER (v = 'CORRECT') AS correct, count(*) FILTER (v = 'UNGROUNDED') AS ungrounded, count(*) FILTER (v = 'WRONG') AS wrong, count(*) FILTER (v = 'LABEL ISSUE') AS label_issue, round(count(*) FILTER (v = 'CORRECT') / count(*), 6) AS precision FROM h GROUP BY 1""",
    "context_assembly": f"WITH {_C}, {_L}, h AS (SELECT query_id, rank, coalesce(text, '') AS text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM l JOIN c USING (chunk_pos) WHERE source = 'bm25' AND rank <= 3), x AS (SELECT query_id, string_agg('[' || i || '] ' || text, chr(10) || chr(10) ORDER BY i) AS t FROM h GROUP BY 1) SELECT query_id, md5(t) AS context_md5, length(t) AS n_chars FROM x",
    "context_by_chunk_id": f"WITH {_C}, {_L}, h AS (SELECT query_id, rank, chunk_pos, coalesce(text, '') AS text FROM l JOIN c USING (chunk_pos) WHERE source = 'bm25' AND rank <= 3) SELECT query_id, md5(string_agg('[' || chunk_pos || '] ' || text, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM h GROUP BY 1",
    "prompt_fill": f"WITH {_A} SELECT answer_id, 'Question: ' || coalesce(question, '') || chr(10) || 'Answer: ' || coalesce(answer, '') AS prompt FROM a",
    "resume_antijoin": f"WITH {_Q}, {_A} SELECT query_id FROM q WHERE query_id NOT IN (SELECT id FROM a WHERE prompt_version = 'v1' AND gen_seconds IS NOT NULL AND id IS NOT NULL)",
    "gold_map_tristate": f"""WITH {_Q}, {_C}, {_L}, {_GOLD}, gm AS (SELECT chunk_pos FROM c WHERE kind = 'clause'), r AS (SELECT query_id, chunk_pos FROM l WHERE source = 'dense' AND rank <= 5),
x AS (SELECT g.query_id, count(gm.chunk_pos) AS m, count(*) - count(gm.chunk_pos) AS u, count(r.chunk_pos) FILTER (gm.chunk_pos IS NOT NULL) AS h FROM g LEFT JOIN gm USING (chunk_pos) LEFT JOIN r ON r.query_id = g.query_id AND r.chunk_pos = g.chunk_pos GROUP BY 1)
SELECT q.query_id, CASE WHEN coalesce(m, 0) > 0 THEN CAST(h > 0 AS INT) END AS hit, coalesce(m, 0) AS n_mapped, coalesce(u, 0) AS n_unmapped FROM q LEFT JOIN x USING (query_id)""",
    "stats_block": f"WITH {_A} SELECT prompt_version, {_STATS.format(v='gen_seconds')} FROM a GROUP BY 1",
    "event_stats": f"WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) SELECT event_type, {_STATS.format(v='k')} FROM e GROUP BY 1",
    "unique_sources": f"WITH {_C}, {_L}, h AS (SELECT query_id, doc AS filename, page, min(rank) AS r FROM l JOIN c USING (chunk_pos) WHERE source = 'bm25' AND rank <= 10 AND doc IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2, 3) SELECT query_id, filename, page, row_number() OVER (PARTITION BY query_id ORDER BY r, filename, page) AS source_no FROM h",
    "migration_diff": f"WITH {_C}, n AS (SELECT chunk_pos, CASE WHEN chunk_pos % 10 = 0 THEN rtrim(text, ' ') ELSE text END AS t FROM c WHERE chunk_pos % 97 <> 5) SELECT c.chunk_pos, length(text) AS old_len, length(t) AS new_len FROM c LEFT JOIN n USING (chunk_pos) WHERE text IS DISTINCT FROM t",
    "gen_tps": f"WITH {_A} SELECT answer_id, round((floor(length(answer) / 3.5) + 1) / (CASE WHEN gen_seconds > 0 THEN gen_seconds * 1e9 END / 1e9), 2) AS tps FROM a",
    "dump_records": f"WITH {_C} SELECT chunk_pos, md5(repeat('-', 78) || chr(10) || '[' || chunk_pos || '] source=' || doc || ' type=' || kind || ' page=' || coalesce(page, 0) || ' len=' || length(text) || ' tokens=' || CAST(floor(length(text) / 3.5) + 1 AS INT) || chr(10) || repeat('-', 78) || chr(10) || text || chr(10)) AS record_md5 FROM c WHERE text IS NOT NULL AND doc IS NOT NULL",
    "document_frequency_ceiling": f"WITH {_C}, t AS (SELECT DISTINCT chunk_pos, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM c) SELECT term, count(*) AS df FROM t GROUP BY 1 HAVING count(*) > greatest(3, floor((SELECT count(*) FROM c) * 0.3))",
    "token_set_ops": f"""WITH {_Q}, {_C}, {_GOLD}, gt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM g JOIN c USING (chunk_pos)),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS tok FROM q), ids AS (SELECT DISTINCT query_id FROM g JOIN c USING (chunk_pos)),
u AS (SELECT query_id, tok, max(a) AS a, max(b) AS b FROM (SELECT *, 1 AS a, 0 AS b FROM qt UNION ALL SELECT *, 0, 1 FROM gt) GROUP BY 1, 2)
SELECT query_id, count(*) AS n_union, count(*) FILTER (a = 1 AND b = 1) AS n_both, count(*) FILTER (a = 1 AND b = 0) AS n_only_question FROM u JOIN ids USING (query_id) GROUP BY 1""",
    "index_append_idempotent": f"WITH {_XC} SELECT chunk_id, sha256 AS doc_sha256, filename, ch.page AS page, ch.char_start AS char_start, ch.char_end AS char_end FROM xc",
    "index_stats": f"WITH {_XC} SELECT count(DISTINCT sha256) AS n_documents, count(*) AS n_chunks FROM xc",
    "outside_boxes": """WITH p AS (SELECT l_orderkey, l_linenumber AS page, l_quantity AS cx, l_discount * 100 AS cy FROM lineitem), b AS (SELECT r_regionkey + 1 AS page, (r_regionkey + 1) * 8.0 AS x0, (r_regionkey + 1) * 8.0 + 10 AS x1 FROM region)
SELECT page, count(*) AS n_outside, sum(l_orderkey) AS key_sum FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = p.page AND cx BETWEEN x0 AND x1 AND cy BETWEEN 1.5 AND 6.5) GROUP BY 1""",
    "search_persisted_lexical": f"""WITH {_XC}, {_Q}, xt AS (SELECT chunk_id AS chunk_pos, ch.text AS text, filename, ch.page AS page FROM xc), {_bm25('xt')}
SELECT query_id, chunk_pos AS chunk_id, bm25_rank, round(1.0 / (60 + bm25_rank), 9) AS rrf_score, CASE WHEN bm25_rank <= 5 THEN 'hit' ELSE 'considered' END AS slot, filename, page FROM br JOIN xt USING (chunk_pos) WHERE bm25_rank <= 10""",
    "stream_ingest_dedup": "SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
