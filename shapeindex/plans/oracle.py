"""DuckDB SQL equal in result to each registered query (tables are pre-registered views).

Structural results are closed form: a corpus row's template fixes its validity, node count,
term count and code lines (FIXTURES §2), a query template fixes the matched corpus template,
matched terms, lines, anchor and preview (FIXTURES §3-§4). Names never reach a term, so a
template's terms occur exactly in the rows of that template: df = rows of the template.
"""
from .fixtures import QUERIES, TEMPLATES

CORPUS = """
corpus AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS sid,
         CAST((l_orderkey + l_linenumber) % 8 AS INTEGER) AS t,
         l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag
  FROM lineitem),
tmpl(t, valid, n_nodes, dl, code_lines) AS (VALUES
  (0, true, 17, 1, 2), (1, true, 23, 3, 3), (2, true, 31, 5, 5), (3, false, NULL, NULL, 2),
  (4, true, 5, 0, 1), (5, true, 38, 5, 4), (6, true, 1, 0, 0), (7, true, 29, 4, 7))"""

SEARCH = f"""WITH {CORPUS},
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) AS total
          FROM corpus JOIN tmpl USING (t) WHERE valid),
tcount AS (SELECT t, count(*) AS c FROM corpus GROUP BY t),
qmap(qt, target, m, lines, anchor, line_start, display_start, n_rows, row_tmpl, hl) AS (VALUES
  (0, 0, 1, '1,2', '#L1-L2', 1, 1, 2, 'v{{k}} = cfg.load()', '1,2'),
  (1, 2, 3, '3,4', '#L3-L4', 3, 2, 3, '        for i in range(n):', '1,2'),
  (2, 7, 1, '6', '#L6', 6, 5, 4, '    go.fast(3)', '1'),
  (3, 1, 3, '1,2,3', '#L1-L3', 1, 1, 3, 'def f{{k}}(a, b):', '1,2,3'),
  (4, 5, 5, '3,4,5', '#L3-L5', 3, 2, 3, 'z = 1', '1,2,3')),
q AS (SELECT CAST(s_suppkey AS BIGINT) AS query_id, CAST(s_suppkey % 7 AS INTEGER) AS qt FROM supplier),
cand AS (
  SELECT q.query_id, c.sid, c.l_orderkey, c.l_partkey, c.l_suppkey, c.l_linenumber, c.l_returnflag, m.*,
         round(m.m * (ln(s.n / (tc.c + 1.0)) + 1) * 2.2
               / (1 + 1.2 * (0.25 + 0.75 * tm.dl / (s.total / s.n))), 6) AS score
  FROM q JOIN qmap m ON q.qt = m.qt JOIN corpus c ON c.t = m.target
       JOIN tcount tc ON tc.t = m.target JOIN tmpl tm ON tm.t = m.target CROSS JOIN stats s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sid) AS rnk FROM cand)"""

SQL = {}

SQL["code_parse_status"] = f"""WITH {CORPUS}
SELECT sid AS snippet_id, valid, CAST(n_nodes AS INTEGER) AS n_nodes, CAST(dl AS INTEGER) AS dl
FROM corpus JOIN tmpl USING (t)"""

SQL["code_term_roots"] = f"""WITH {CORPUS},
roots(t, node_type, c) AS (VALUES (0, 'Assign', 1), (1, 'FunctionDef', 1), (1, 'Return', 1), (1, 'BinOp', 1),
  (2, 'ClassDef', 1), (2, 'FunctionDef', 1), (2, 'For', 1), (2, 'Expr', 1), (2, 'Call', 1),
  (5, 'Assign', 1), (5, 'ListComp', 1), (5, 'comprehension', 1), (5, 'Expr', 1), (5, 'Call', 1),
  (7, 'Try', 1), (7, 'Expr', 2), (7, 'ExceptHandler', 1))
SELECT node_type, CAST(sum(c) AS BIGINT) AS n FROM corpus JOIN roots USING (t) GROUP BY node_type"""

SQL["code_index_stats"] = f"""WITH {CORPUS}
SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(dl) AS BIGINT) AS total_len,
       round(CAST(sum(dl) AS DOUBLE) / count(*), 6) AS avgdl
FROM corpus JOIN tmpl USING (t) WHERE valid"""

SQL["stream_index_stats"] = SQL["code_index_stats"]

SQL["code_df_histogram"] = f"""WITH {CORPUS},
per_t AS (SELECT t, count(*) AS df FROM corpus GROUP BY t)
SELECT CAST(df AS BIGINT) AS df, CAST(sum(dl) AS BIGINT) AS n_terms
FROM per_t JOIN tmpl USING (t) WHERE valid AND dl > 0 GROUP BY df"""

SQL["code_search_hits"] = SEARCH + """
SELECT query_id, CAST(rnk AS INTEGER) AS rank, sid AS snippet_id, score, CAST(m AS INTEGER) AS matched_tokens_count,
  CASE WHEN l_returnflag = 'R' THEN 'Python Docs' ELSE 'r' || l_suppkey END AS repo,
  CASE WHEN l_returnflag = 'R' THEN 'T: m' || l_partkey || '.f' || sid
       ELSE 'f' || l_partkey || '_' || l_linenumber || '.py' END AS filename,
  CASE WHEN l_returnflag = 'R' THEN 'https://docs.python.org/3/library/m' || l_partkey || '.html#f' || sid
       ELSE 'https://github.com/x/r' || l_suppkey || '/blob/h' || l_suppkey || '/src/f' || l_partkey || '_'
            || l_linenumber || '.py' || anchor END AS url,
  lines, CAST(line_start AS INTEGER) AS line_start, CAST(display_start AS INTEGER) AS display_start,
  CAST(n_rows AS INTEGER) AS n_rows, replace(row_tmpl, '{k}', CAST(l_orderkey AS VARCHAR)) AS first_row, hl
FROM ranked WHERE rnk <= 10"""

SQL["code_search_results"] = SEARCH + """,
per_q AS (SELECT query_id, count(*) AS n FROM ranked WHERE rnk <= 10 GROUP BY query_id)
SELECT q.query_id, coalesce(per_q.n, 0) > 0 AS has_results, CAST(coalesce(per_q.n, 0) AS INTEGER) AS n_hits,
       q.qt = 6 AS is_error
FROM q LEFT JOIN per_q USING (query_id)"""

SQL["code_ingest_report"] = f"""WITH {CORPUS}
SELECT 'r' || l_suppkey AS repo, CAST(count(*) FILTER (WHERE valid) AS BIGINT) AS accepted,
       CAST(count(*) FILTER (WHERE NOT valid) AS BIGINT) AS skipped
FROM corpus JOIN tmpl USING (t) GROUP BY l_suppkey"""

SQL["code_corpus_meta"] = f"""WITH {CORPUS}
SELECT CAST(sum(code_lines) AS BIGINT) AS python_line_count, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS repo_count
FROM corpus JOIN tmpl USING (t)"""

SQL["code_files_to_documents"] = """
SELECT 'r' || l_suppkey || ' ' || 'f' || l_linenumber || '_' || l_orderkey || '.py' AS title,
       'https://github.com/x/r' || l_suppkey || '/blob/h' || s_nationkey || '/src/p' || l_partkey || '/f'
       || l_linenumber || '_' || l_orderkey || '.py' AS url
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0"""

# the whole corpus with the texts of FIXTURES §2
SQL["code_scan_documents"] = f"""WITH {CORPUS}
SELECT sid AS snippet_id,
  CASE WHEN l_returnflag = 'R' THEN 'T: m' || l_partkey || '.f' || sid
       ELSE 'r' || l_suppkey || ' f' || l_partkey || '_' || l_linenumber || '.py' END AS title,
  CASE WHEN l_returnflag = 'R' THEN 'https://docs.python.org/3/library/m' || l_partkey || '.html#f' || sid
       ELSE 'https://github.com/x/r' || l_suppkey || '/blob/h' || l_suppkey || '/src/f' || l_partkey || '_'
            || l_linenumber || '.py' END AS url,
  md5(replace(CASE t {" ".join("WHEN " + str(t) + " THEN '" + text.replace("'", "''") + "'" for t, text in sorted(TEMPLATES.items()))} END, '{{k}}',
      CAST(l_orderkey AS VARCHAR))) AS content_md5
FROM corpus JOIN tmpl USING (t) WHERE valid"""

# terms of the code made from documents: a statement per line has the term of its value and, around it, its own
STATEMENTS = """
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
stmts AS (SELECT doc_id, CAST(i AS INTEGER) AS i,
  'Attribute(value=Call(func=Attribute(value=Name(ctx=Load()), attr=''m' || (length(line) % 40) || ''', ctx=Load()), args=[Constant(value='''
  || substr(md5(line), 1, 8) || ''', kind=None), Constant(value=' || length(line) || ', kind=None)], keywords=[]), attr=''k'
  || (length(line) % 3) || ''', ctx=Load())' AS inner_term FROM lines),
terms AS (SELECT doc_id, i, inner_term, 'Assign(targets=[Name(ctx=Store())], value=' || inner_term || ', type_comment=None)' AS outer_term FROM stmts)"""

SQL["code_term_identity"] = f"""WITH {STATEMENTS},
occ AS (SELECT doc_id, outer_term AS term FROM terms UNION ALL SELECT doc_id, inner_term FROM terms)
SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS tf, 1 AS hash_texts, 1 AS digest_texts, 1 AS digests
FROM occ GROUP BY term"""

SQL["code_term_positions"] = f"""WITH {STATEMENTS}
SELECT doc_id, CAST(2 * (i - 1) AS INTEGER) AS pos, md5(outer_term) AS term_md5 FROM terms
UNION ALL SELECT doc_id, CAST(2 * (i - 1) + 1 AS INTEGER), md5(inner_term) FROM terms"""

# a statement is two terms of equal frequency; a hit's lines are those of its matched statements, or all if the first is matched
DATA_SEARCH = f"""WITH {STATEMENTS},
dl AS (SELECT doc_id, 2 * count(*) AS dl FROM stmts GROUP BY doc_id),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM dl),
tf AS (SELECT doc_id, inner_term, count(*) AS tf FROM stmts GROUP BY ALL),
df AS (SELECT inner_term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT DISTINCT doc_id AS query_id, inner_term FROM stmts WHERE doc_id % 20 = 0 AND i <= 3),
s AS (SELECT query_id, tf.doc_id, round(sum(2 * (ln(n / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score,
             CAST(2 * count(*) AS INTEGER) AS matched_tokens_count
      FROM q JOIN tf USING (inner_term) JOIN df USING (inner_term) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY query_id, tf.doc_id),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10),
own AS (SELECT query_id, doc_id, i FROM top JOIN stmts USING (doc_id) JOIN q USING (query_id, inner_term)),
marked AS (SELECT query_id, doc_id, i FROM own UNION
           SELECT query_id, doc_id, stmts.i FROM (SELECT * FROM own WHERE i = {{root}}) JOIN stmts USING (doc_id)),
runs AS (SELECT query_id, doc_id, min(i) AS a, max(i) AS b FROM (
           SELECT *, i - row_number() OVER (PARTITION BY query_id, doc_id ORDER BY i) AS g FROM marked) GROUP BY query_id, doc_id, g),
best AS (SELECT query_id, doc_id, first(a ORDER BY b - a DESC, a) AS a, first(b ORDER BY b - a DESC, a) AS b FROM runs GROUP BY query_id, doc_id),
hits AS (SELECT query_id, rank, doc_id, score, matched_tokens_count, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS lines,
                'https://h/d' || doc_id || '#L' || a || CASE WHEN b > a THEN '-L' || b ELSE '' END AS url
         FROM top JOIN best USING (query_id, doc_id) JOIN marked USING (query_id, doc_id) WHERE i >= a GROUP BY query_id, rank, doc_id, score, matched_tokens_count, a, b)"""

SQL["code_data_search"] = DATA_SEARCH.replace("{root}", "1") + " SELECT query_id, rank, doc_id, score, matched_tokens_count, lines, url FROM hits"

SQL["code_data_search_no_root"] = DATA_SEARCH.replace("{root}", "0") + " SELECT query_id, rank, doc_id, lines, url FROM hits"

# with names kept, the terms that hold the row's own name are equal within an order only: the assignment of template 0, the
# function of 1 and the class of 2; the others are as many as before
SQL["code_names_df_histogram"] = f"""WITH {CORPUS},
per AS (SELECT count(*) AS df, 1 AS k FROM corpus WHERE t IN (0, 1, 2) GROUP BY t, l_orderkey
        UNION ALL SELECT count(*), CASE t WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 5 THEN 5 ELSE 4 END FROM corpus WHERE t IN (1, 2, 5, 7) GROUP BY t)
SELECT CAST(df AS BIGINT) AS df, CAST(sum(k) AS BIGINT) AS n_terms FROM per GROUP BY df"""

SQL["part_gram_top10"] = """WITH d AS (SELECT p_partkey, lower(concat_ws(' ', p_name, p_brand, p_type)) AS x FROM part),
occ AS (SELECT p_partkey, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS g FROM d),
dl AS (SELECT p_partkey, greatest(length(x) - 2, 0) AS dl FROM d),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM dl),
tf AS (SELECT p_partkey, g, count(*) AS tf FROM occ GROUP BY ALL), df AS (SELECT g, count(*) AS df FROM tf GROUP BY g),
b AS (SELECT min(p_partkey) AS query_id, lower(concat_ws(' ', p_type, p_brand)) AS x FROM part GROUP BY p_brand, p_type),
q AS (SELECT DISTINCT query_id, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS g FROM b),
s AS (SELECT query_id, p_partkey, round(sum((ln(n / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score,
             CAST(count(*) AS INTEGER) AS matched_tokens_count
      FROM q JOIN tf USING (g) JOIN df USING (g) JOIN dl USING (p_partkey) CROSS JOIN st GROUP BY query_id, p_partkey)
SELECT query_id, rank, p_partkey, score, matched_tokens_count FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) AS INTEGER) AS rank FROM s) WHERE rank <= 10"""

WORDS = """
words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS ws FROM documents),
occ AS (SELECT doc_id, unnest(ws) AS term, unnest(range(0, len(ws))) AS pos FROM words)"""

SQL["word_postings"] = f"""WITH {WORDS}
SELECT term, doc_id, CAST(count(*) AS BIGINT) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions
FROM occ GROUP BY term, doc_id"""

SQL["word_doc_freq"] = f"""WITH {WORDS}
SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM occ GROUP BY term"""

SQL["word_stats"] = f"""WITH {WORDS}
SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS total_len,
       round(CAST(sum(len(ws)) AS DOUBLE) / count(*), 6) AS avgdl FROM words"""

SQL["word_bm25_top10"] = f"""WITH {WORDS},
dl AS (SELECT doc_id, len(ws) AS dl FROM words),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id,
             unnest(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '')) AS term FROM benchmark),
s AS (SELECT q.query_id, tf.doc_id,
             sum((ln(st.n / (df.df + 1)) + 1) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl.dl / st.avgdl))) AS score,
             count(*) AS matched
      FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st
      GROUP BY q.query_id, tf.doc_id),
r AS (SELECT query_id, doc_id, round(score, 6) AS score, matched,
             row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rnk FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rnk AS INTEGER) AS rank, doc_id, score,
       CAST(matched AS INTEGER) AS matched_tokens_count
FROM r WHERE rnk <= 10"""

SQL["doc_line_window"] = """WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
d2 AS (SELECT doc_id, CASE WHEN suffix(text, chr(10)) THEN parts[1:len(parts) - 1] ELSE parts END AS ls FROM d),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS lineno FROM d2),
m AS (SELECT doc_id, lineno FROM l WHERE length(line) > 80),
g AS (SELECT doc_id, lineno, lineno - row_number() OVER (PARTITION BY doc_id ORDER BY lineno) AS g FROM m),
runs AS (SELECT doc_id, g, min(lineno) AS s, max(lineno) AS e, count(*) AS n FROM g GROUP BY doc_id, g),
best AS (SELECT doc_id, s, e FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) AS r FROM runs) WHERE r = 1),
kept AS (SELECT m.doc_id, m.lineno, best.s, best.e FROM m JOIN best USING (doc_id) WHERE m.lineno >= best.s),
agg AS (SELECT doc_id, min(s) AS s, min(e) AS e, string_agg(CAST(lineno AS VARCHAR), ',' ORDER BY lineno) AS kept_lines,
               string_agg(CAST(lineno - s + 1 AS VARCHAR), ',' ORDER BY lineno) AS hl FROM kept GROUP BY doc_id)
SELECT doc_id, kept_lines,
       CASE WHEN s = e THEN '#L' || s ELSE '#L' || s || '-L' || e END AS anchor,
       CAST(greatest(1, s - 1) AS INTEGER) AS display_start, CAST(len(ls[s:s + 10]) AS INTEGER) AS n_rows,
       CAST(length(ls[s]) AS INTEGER) AS first_row_len, hl
FROM agg JOIN d2 USING (doc_id)"""

SQL["docs_code_lines"] = """
SELECT source, CAST(coalesce(sum(len(list_filter(string_split(text, chr(10)),
        lambda x: NOT regexp_matches(x, '^[ \\t\\r\\f]*(#|$)')))), 0) AS BIGINT) AS python_line_count
FROM documents GROUP BY source"""

SQL["docs_snippet_text"] = """
SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS text_len FROM (
  SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)),
         lambda x: NOT (starts_with(x, '>>>') OR starts_with(x, '...'))), '') AS t FROM documents)"""

SQL["lineitem_longest_run"] = """WITH v AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem),
g AS (SELECT *, l_orderkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS g FROM v),
runs AS (SELECT l_suppkey, g, min(l_orderkey) AS s, max(l_orderkey) AS e, count(*) AS n FROM g GROUP BY l_suppkey, g),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, s) AS r FROM runs) WHERE r = 1)
SELECT b.l_suppkey, b.s AS run_start, b.e AS run_end, CAST(b.n AS BIGINT) AS run_len,
       CAST((SELECT count(*) FROM v WHERE v.l_suppkey = b.l_suppkey AND v.l_orderkey < b.s) AS INTEGER) AS start_index
FROM best b"""

SQL["lineitem_first_run"] = """WITH v AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem),
g AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber) AS g FROM v),
runs AS (SELECT l_partkey, g, min(l_linenumber) AS s, max(l_linenumber) AS e FROM g GROUP BY l_partkey, g)
SELECT l_partkey, s AS first_start, e AS first_end FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY s) AS r FROM runs) WHERE r = 1"""

SQL["events_first_wins"] = """
SELECT event_id, user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"""

SQL["orders_upsert"] = """WITH o AS (SELECT 'c/' || o_custkey AS url, o_orderkey, o_orderstatus FROM orders)
SELECT url, o_orderkey, false AS is_new FROM o WHERE o_orderstatus = 'F'
  AND url NOT IN (SELECT url FROM o WHERE o_orderstatus = 'O')
UNION ALL
SELECT url, o_orderkey, true AS is_new FROM o WHERE o_orderstatus = 'O'"""

SQL["orders_budget"] = """WITH sizes AS (
  SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes FROM orders GROUP BY o_custkey),
r AS (SELECT o_custkey, bytes, CAST(coalesce(sum(bytes) OVER (ORDER BY o_custkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bytes_before FROM sizes)
SELECT o_custkey, bytes, bytes_before FROM r WHERE bytes_before <= 1000000000"""

SQL["lineitem_crawl"] = """WITH RECURSIVE edges AS (
  SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem
  UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
r(url, depth) AS (
  SELECT 'o' || o_orderkey, 0 FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.url)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY url"""

SQL["part_select_repos"] = """
SELECT p_name || '#' || p_partkey AS name, CAST(p_size AS BIGINT) AS stars,
       CAST(floor(p_retailprice * 11) AS BIGINT) AS size_kb
FROM part WHERE p_type = 'ECONOMY' AND p_size > 1 AND CAST(floor(p_retailprice * 11) AS BIGINT) > 10000
ORDER BY stars DESC, name LIMIT 10"""

# HTML character references as a parser decodes them: with and (legacy HTML5 rule) without the
# semicolon; "&amp" last so that nothing is decoded twice
_ENTITIES = [("&quot", '"'), ("&lt", "<"), ("&gt", ">"), ("&copy", "©"), ("&middot", "·"), ("&amp", "&")]


def _unescape_sql() -> str:
    expr = "{x}"
    for ent, ch in _ENTITIES:
        lit = ch.replace("'", "''")
        expr = f"replace(replace({expr}, '{ent};', '{lit}'), '{ent}', '{lit}')"
    return expr


UNESCAPE = _unescape_sql()

SQL["pages_toc_links"] = f"""WITH nav AS (
  SELECT page_id, url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS hs
  FROM pages),
h AS (SELECT page_id, url, unnest(hs) AS href, unnest(range(0, len(hs))) AS ord FROM nav)
SELECT page_id, CAST(ord AS INTEGER) AS ord,
       regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {UNESCAPE.format(x='href')} AS link
FROM h"""

ARTICLE = f"""a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art FROM pages),
b AS (SELECT page_id, url, art, string_split(art, '<p>') AS pieces FROM a),
blocks AS (SELECT page_id, unnest(pieces[2:]) AS piece FROM b),
bt AS (SELECT page_id, {UNESCAPE.format(x="regexp_replace(split_part(piece, '</p>', 1), '<[^>]*>', '', 'g')")} AS txt
       FROM blocks)"""

SQL["pages_sections"] = f"""WITH {ARTICLE}
SELECT b.page_id, {UNESCAPE.format(x="regexp_replace(regexp_extract(art, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")} AS title,
       b.url, CAST(len(pieces) - 1 AS INTEGER) AS n_blocks,
       CAST(coalesce((SELECT sum(length(txt)) FROM bt WHERE bt.page_id = b.page_id), 0) AS BIGINT) AS text_len
FROM b WHERE art <> ''"""

HOST_LANG = "regexp_extract(url, '^(https?://[^/]+/[^/?#]*)', 1)"

SQL["pages_dedup_url"] = f"""WITH {ARTICLE}
SELECT {HOST_LANG} AS url, page_id FROM b
WHERE len(pieces) > 1 AND page_id % 3 <> 0
QUALIFY row_number() OVER (PARTITION BY {HOST_LANG} ORDER BY page_id) = 1"""

SQL["stream_dedup_urls"] = f"SELECT DISTINCT {HOST_LANG} AS url FROM pages"

SQL["stream_two_feeds"] = """
WITH items AS (
  SELECT 'https://h/' || o_custkey AS url, 'v = c.m' || o_orderkey || '()' AS content, o_orderstatus AS s
  FROM orders WHERE o_orderkey % 7 <> 0
)
SELECT url, content FROM items
WHERE s = 'P' OR url NOT IN (SELECT url FROM items WHERE s = 'P')"""

SQL["code_type_sequences"] = f"""WITH {CORPUS},
seqs(t, type_sequence) AS (VALUES
  (0, 'Module Assign Name Store Call Attribute Name Load Load Assign Name Store BinOp Name Load Add Constant'),
  (1, 'Module FunctionDef arguments arg arg Assign Name Store BinOp Name Load Mult Name Load Return BinOp Call '
      || 'Attribute Name Load Load Add Constant'),
  (2, 'Module ClassDef Name Load FunctionDef arguments arg arg For Name Store Call Name Load Name Load Expr Call '
      || 'Attribute Attribute Name Load Load Load Name Load Return Attribute Name Load Load'),
  (4, 'Module Assign Name Store Constant'),
  (5, 'Module Import alias Assign Name Store Constant Assign Name Store ListComp Attribute Name Load Load '
      || 'comprehension Name Store Name Load Compare Attribute Name Load Load Gt Constant Expr Call Name Load '
      || 'Attribute Subscript Name Load Constant Load Load'),
  (6, 'Module'),
  (7, 'Module Assign Name Store Constant Assign Name Store Constant Try Expr Call Attribute Name Load Load Constant '
      || 'ExceptHandler Name Load Expr Call Attribute Name Load Load Name Load Raise'))
SELECT type_sequence, CAST(count(*) AS BIGINT) AS n FROM corpus JOIN seqs USING (t) GROUP BY type_sequence"""

SQL["code_iter_documents"] = f"""WITH {CORPUS}
SELECT sid AS snippet_id,
  CASE WHEN l_returnflag = 'R' THEN 'T: m' || l_partkey || '.f' || sid
       ELSE 'r' || l_suppkey || ' f' || l_partkey || '_' || l_linenumber || '.py' END AS title,
  CASE WHEN l_returnflag = 'R' THEN 'https://docs.python.org/3/library/m' || l_partkey || '.html#f' || sid
       ELSE 'https://github.com/x/r' || l_suppkey || '/blob/h' || l_suppkey || '/src/f' || l_partkey || '_'
            || l_linenumber || '.py' END AS url
FROM corpus JOIN tmpl USING (t) WHERE valid ORDER BY sid LIMIT 10"""

SQL["code_title_terms"] = f"""WITH {CORPUS},
titles AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'T: m' || l_partkey || '.f' || sid
              ELSE 'r' || l_suppkey || ' f' || l_partkey || '_' || l_linenumber || '.py' END AS title
  FROM corpus JOIN tmpl USING (t) WHERE valid),
words AS (SELECT unnest(regexp_extract_all(lower(title), '\\w+(\\.?\\w+)*', 0)) AS word FROM titles)
SELECT word, CAST(count(*) AS BIGINT) AS n FROM words
WHERE length(word) > 1 AND word NOT IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'can', 'for', 'from',
  'have', 'if', 'in', 'is', 'it', 'may', 'not', 'of', 'on', 'or', 'tbd', 'that', 'the', 'this', 'to', 'us', 'we',
  'when', 'will', 'with', 'yet', 'you', 'your')
GROUP BY word"""

SQL["word_df_quantiles"] = f"""WITH {WORDS},
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM occ GROUP BY term)
SELECT CAST(count(*) AS BIGINT) AS n_terms, round(quantile_cont(df, 0.5), 6) AS p50,
       round(quantile_cont(df, 0.9), 6) AS p90, round(quantile_cont(df, 0.99), 6) AS p99,
       CAST(max(df) AS BIGINT) AS max_df FROM df"""

SQL["pages_toc_links_jvm"] = SQL["pages_toc_links"]

SQL["stream_events_dedup"] = "SELECT DISTINCT user_id, event_type FROM events"

SQL["pages_item_feeds"] = f"""WITH {ARTICLE}
SELECT CASE WHEN contains(url, '/en/') THEN 0 ELSE 1 END AS feed, url,
       CAST(len(pieces) - 1 AS INTEGER) AS n_snippets
FROM b WHERE art <> ''"""

SQL["pages_explode_items"] = f"""WITH {ARTICLE},
ex AS (SELECT url, unnest(pieces[2:]) AS piece, unnest(range(0, len(pieces) - 1)) AS ord FROM b WHERE art <> '')
SELECT url, CAST(ord AS INTEGER) AS ord,
       CAST(length({UNESCAPE.format(x="regexp_replace(split_part(piece, '</p>', 1), '<[^>]*>', '', 'g')")}) AS INTEGER)
         AS text_len
FROM ex"""


# the items of the manual pages, straight from the tables; sorted as the pages nest
MANUAL = """
items AS (
  SELECT o_custkey AS c, o_orderkey AS o, 0 AS own, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_extendedprice AS e, 1 AS outside,
         'Order ' || o_orderkey || ': p' || l_partkey AS title, '#p' || l_partkey AS frag,
         CASE WHEN l_partkey % 10 = 0 THEN 'def (:' ELSE 'x = a.m' || l_suppkey || '()' END AS code, l_partkey % 10 <> 0 AS ok
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL
  SELECT o_custkey, o_orderkey, 0, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 0, 'p' || l_partkey || ': None', '#o' || o_orderkey, 'y = ' || l_linenumber, true
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber % 2 = 0
  UNION ALL
  SELECT o_custkey, o_orderkey, 1, 0, 0, 0, 0, 0, 'Order ' || o_orderkey, '#o' || o_orderkey, 'z = o.n' || o_orderkey || '()', true FROM orders WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT c_custkey, 9223372036854775807, 2, 0, 0, 0, 0, 0, 'Customer ' || c_name, coalesce('#o' || f, ''), 'w = c.m' || c_custkey || '()', true
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS f FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
ranked AS (
  SELECT items.*, 'https://h/c' || c || '.html' || frag AS url, CAST(row_number() OVER (PARTITION BY c ORDER BY o, own, n, p, s, e, outside) - 1 AS INTEGER) AS ord
  FROM items JOIN customer ON c_custkey = c)"""

SQL["manual_items"] = f"""WITH {MANUAL}
SELECT c AS custkey, ord, title, url, 1 AS n_raw, CASE WHEN ok THEN 1 ELSE 0 END AS n_ok, md5(code) AS raw_md5 FROM ranked"""

SQL["manual_first_wins"] = f"""WITH {MANUAL}
SELECT custkey, ord, url, code FROM (
  SELECT c AS custkey, ord, url, code, row_number() OVER (PARTITION BY url ORDER BY c, ord) AS k FROM ranked WHERE ok) WHERE k = 1"""

LINKS = """
pages AS (SELECT c_custkey AS k FROM customer),
links AS (SELECT DISTINCT k, d FROM (
  SELECT k, k * 2 AS d FROM pages UNION ALL SELECT k, k * 2 + 1 FROM pages
  UNION ALL SELECT k, k // 10 FROM pages WHERE k % 10 = 0 UNION ALL SELECT k, k FROM pages WHERE k % 10 = 0) WHERE d IN (SELECT k FROM pages))"""

SQL["manual_crawl"] = f"""WITH RECURSIVE {LINKS},
walk(k, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT d, depth + 1 FROM walk JOIN links USING (k) WHERE depth < 64),
seen AS (SELECT k, min(depth) AS depth FROM walk GROUP BY k)
SELECT 'https://h/c' || k || '.html' AS url, depth, k NOT IN (SELECT k FROM links) AS is_leaf FROM seen"""

SQL["manual_crawl_tutorial"] = f"""WITH {LINKS},
seeds AS (SELECT k FROM pages WHERE k % 20 = 0),
seen AS (SELECT k, 0 AS depth FROM seeds UNION SELECT d, 1 FROM links WHERE k IN (SELECT k FROM seeds) AND d NOT IN (SELECT k FROM seeds))
SELECT 'https://h/c' || k || '.html' AS url, depth, depth = 1 AS is_leaf FROM seen"""


TEXTS = "CASE t " + " ".join(f"WHEN {t} THEN '" + text.replace("'", "''") + "'" for t, text in sorted(TEMPLATES.items())) + " END"

SQL["code_ingest_budget"] = f"""WITH {CORPUS},
per AS (SELECT l_suppkey AS k, CAST(sum(strlen(replace({TEXTS}, '{{k}}', CAST(l_orderkey AS VARCHAR)))) AS BIGINT) AS bytes, count(*) FILTER (valid) AS ok, count(*) AS n
        FROM corpus JOIN tmpl USING (t) WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY l_suppkey),
run AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 1000000 AS admitted FROM per)
SELECT 'r' || k AS repo, bytes, admitted, CASE WHEN admitted THEN ok ELSE 0 END AS accepted, CASE WHEN admitted THEN n - ok ELSE 0 END AS skipped FROM run"""

SQL["code_ingest_total"] = f"""WITH {CORPUS}
SELECT 'r' || l_suppkey AS repo, CAST(count(*) FILTER (WHERE valid) AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE NOT valid) AS BIGINT) AS skipped
FROM corpus JOIN tmpl USING (t) GROUP BY ROLLUP (l_suppkey)"""

SQL["code_meta_file"] = SQL["code_corpus_meta"]

SQL["part_repo_file"] = """WITH p AS (SELECT *, p_name || '#' || p_partkey AS name, CAST(floor(p_retailprice * 11) AS BIGINT) AS size_kb, p_partkey % 50 = 0 AS bad FROM part)
SELECT name, p_type AS language, CAST(p_size AS BIGINT) AS stars, size_kb, NULL AS record FROM p WHERE NOT bad
UNION ALL SELECT NULL, NULL, NULL, NULL, '{"name":"' || name || '","language":"' || p_type || '","stargazers_count":"many","size":' || size_kb || ',"owner":{"login":"' || p_brand || '"}}' FROM p WHERE bad"""

# the response envelope as text: hits with their nested fields in order, or the parser's message
QUERY_TEXTS = "CASE qt " + " ".join(f"WHEN {t} THEN '" + v[0].replace("'", "''") + "'" for t, v in sorted(QUERIES.items())) + " END"

SQL["code_search_json"] = SEARCH + f""",
hits AS (
  SELECT query_id, rnk, '{{"rank":' || rnk || ',"snippet_id":' || sid || ',"score":' || score || ',"matched_tokens_count":' || m
    || ',"title":{{"repo":"' || CASE WHEN l_returnflag = 'R' THEN 'Python Docs' ELSE 'r' || l_suppkey END || '","filename":"'
    || CASE WHEN l_returnflag = 'R' THEN 'T: m' || l_partkey || '.f' || sid ELSE 'f' || l_partkey || '_' || l_linenumber || '.py' END
    || '"}},"url":"' || CASE WHEN l_returnflag = 'R' THEN 'https://docs.python.org/3/library/m' || l_partkey || '.html#f' || sid
       ELSE 'https://github.com/x/r' || l_suppkey || '/blob/h' || l_suppkey || '/src/f' || l_partkey || '_' || l_linenumber || '.py' || anchor END
    || '","lines":[' || lines || '],"preview":{{"line_start":' || line_start || ',"display_start":' || display_start || ',"rows":['
    || array_to_string(list_transform(string_split(replace({TEXTS}, '{{k}}', CAST(l_orderkey AS VARCHAR)), chr(10))[line_start:line_start + n_rows - 1],
                                      lambda x: '"' || replace(x, '"', '\\"') || '"'), ',') || '],"hl":[' || hl || ']}}}}' AS hit
  FROM (SELECT *, target AS t FROM ranked) WHERE rnk <= 10),
per_q AS (SELECT query_id, string_agg(hit, ',' ORDER BY rnk) AS shown FROM hits GROUP BY query_id),
asked AS (SELECT query_id, qt, '"' || replace(replace(replace({QUERY_TEXTS}, '{{k}}', CAST(query_id AS VARCHAR)), '"', '\\"'), chr(10), '\\n') || '"' AS code FROM q)
SELECT query_id, '{{"previous_input":' || code || CASE WHEN qt = 6 THEN ',"errors":"invalid syntax (<unknown>, line 1)"}}'
  ELSE ',"similar":[' || coalesce(shown, '') || '],"has_results":' || CASE WHEN shown IS NULL THEN 'false' ELSE 'true' END || '}}' END AS json
FROM asked LEFT JOIN per_q USING (query_id)"""

SQL["stream_state"] = """SELECT count(*) AS n_first, count(*) AS n_keys, count(*) AS state_rows, 20::BIGINT AS batches
FROM (SELECT DISTINCT user_id, event_type FROM events)"""
