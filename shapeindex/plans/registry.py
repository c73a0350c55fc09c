"""Registered queries: one Spark callable (spark, sf_dir) -> DataFrame per operator, and for each
the same result written independently in DuckDB SQL over the driver's tables.

Structural queries run on the code corpus of ``plans.corpus``; their SQL uses the per-template
constants of FIXTURES §2-§4 (node, term and line counts), so the oracle is closed form.
"""
from __future__ import annotations

import threading

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import ARTICLE_RULES, LIBRARY_RULES, TUTORIAL_RULES, SearchOptions
from ..operators import html as H
from ..operators import index as I
from ..operators import lines as L
from ..operators import search as S
from ..operators import stats as ST
from ..operators import terms as TK
from ..session import ensure_checkpoint_dir, scratch_path
from ..sources.repos import select_repos
from .corpus import code_corpus, code_queries, document_code, document_queries, index_pages, manual_pages, part_labels, table

_LOCK = threading.Lock()
_INDEXES: dict = {}


def _index(spark: SparkSession, sf_dir: str, kind: str) -> I.Index:
    """Build (once per process and input folder) and open an index over the given tables."""
    key = (sf_dir.rstrip("/"), kind)
    with _LOCK:
        path = _INDEXES.get(key)
        if path:
            try:
                return I.open_index(spark, path)
            except Exception:
                pass
        path = scratch_path(spark, f"index-{kind}")
        own = {"names": TK.NAMES, "grams": TK.GRAMS}.get(kind)
        idx = I.create_index(spark, path, kind="words" if kind == "words" else "structural", tokenizer=own)
        if kind in ("structural", "names"):
            docs = code_corpus(spark, sf_dir).select("snippet_id", "title", "url", "content")
        elif kind == "document_code":
            docs = document_code(spark, sf_dir)
        elif kind == "grams":
            docs = part_labels(spark, sf_dir)
        else:
            docs = table(spark, sf_dir, "documents").select(
                F.col("doc_id").alias("snippet_id"), F.lit("").alias("title"), F.col("source").alias("url"),
                F.col("text").alias("content"))
        I.add_documents(idx, docs, batch_seq=0)
        _INDEXES[key] = path
        return I.open_index(spark, path)


# =========================================================================== structural tokens

def q_code_parse_status(spark, sf_dir):
    c = code_corpus(spark, sf_dir).select("snippet_id", "content")
    return TK.parse_code(c, keep_nodes="none", hashes=False).select("snippet_id", "valid", "n_nodes", "dl")


def q_code_term_roots(spark, sf_dir):
    c = code_corpus(spark, sf_dir).select("snippet_id", "content")
    roots = TK.nodes(TK.parse_code(c, keep_nodes="terms", hashes=False, types_only=True))
    return roots.groupBy("node_type").agg(F.count(F.lit(1)).cast("long").alias("n"))


def q_code_index_stats(spark, sf_dir):
    st = _index(spark, sf_dir, "structural").stats()
    return st.select("n_docs", "total_len", F.round(F.col("total_len") / F.col("n_docs"), 6).alias("avgdl"))


def q_code_df_histogram(spark, sf_dir):
    t = _index(spark, sf_dir, "structural").terms()
    return t.groupBy("df").agg(F.count(F.lit(1)).cast("long").alias("n_terms"))


def q_code_type_sequences(spark, sf_dir):
    c = code_corpus(spark, sf_dir).select("snippet_id", "content")
    seq = TK.type_sequence(TK.parse_code(c, keep_nodes="all", hashes=False, types_only=True).where("valid"))
    return seq.groupBy("type_sequence").agg(F.count(F.lit(1)).cast("long").alias("n"))


def q_code_iter_documents(spark, sf_dir):
    idx = _index(spark, sf_dir, "structural")
    return I.iter_documents(idx, limit=10).select("snippet_id", "title", "url")


def q_code_scan_documents(spark, sf_dir):
    """IDX8 without a limit: every live document."""
    return I.iter_documents(_index(spark, sf_dir, "structural")).select("snippet_id", "title", "url", F.md5("content").alias("content_md5"))


def q_code_term_identity(spark, sf_dir):
    """TOK6, TOK11: every term of code that depends on the data, by its printed text, and how many texts and digests stand
    for one another."""
    return TK.term_identity(document_code(spark, sf_dir)).select("term", "df", "tf", "hash_texts", "digest_texts", "digests")


def q_code_term_positions(spark, sf_dir):
    """TOK8: the term stream, (doc_id, pos) and the term's text."""
    p = TK.parse_code(document_code(spark, sf_dir), keep_nodes="terms", with_text=True)
    return TK.term_stream(p).select(F.col("snippet_id").alias("doc_id"), "pos", F.md5("term").alias("term_md5"))


def _document_code_search(spark, sf_dir, opts):
    return S.search(_index(spark, sf_dir, "document_code"), document_queries(spark, sf_dir), opts)[0]


def q_code_data_search(spark, sf_dir):
    """QRY1-QRY10 on code that depends on the data: scores, matched terms, lines and anchors."""
    hits = _document_code_search(spark, sf_dir, SearchOptions())
    return hits.select("query_id", "rank", F.col("snippet_id").alias("doc_id"), "score", "matched_tokens_count",
                       F.array_join("lines", ",").alias("lines"), "url")


def q_code_data_search_no_root(spark, sf_dir):
    """QRY7 without the root rule: a file's first term marks its own lines only."""
    hits = _document_code_search(spark, sf_dir, SearchOptions(root_rule=False))
    return hits.select("query_id", "rank", F.col("snippet_id").alias("doc_id"), F.array_join("lines", ",").alias("lines"), "url")


def q_code_names_df_histogram(spark, sf_dir):
    """UDF1: document frequencies of an index whose tokenizer keeps names."""
    t = _index(spark, sf_dir, "names").terms()
    return t.groupBy("df").agg(F.count(F.lit(1)).cast("long").alias("n_terms"))


def q_part_gram_top10(spark, sf_dir):
    """UDF1: BM25 over character 3-grams of part labels, one query per brand and type."""
    p = table(spark, sf_dir, "part")
    qs = p.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("query_id")).select("query_id", F.concat_ws(" ", "p_type", "p_brand").alias("code"))
    hits, _ = S.search(_index(spark, sf_dir, "grams"), qs, SearchOptions(), decorate_hits=False)
    return hits.select("query_id", "rank", F.col("snippet_id").alias("p_partkey"), "score", "matched_tokens_count")


def q_code_title_terms(spark, sf_dir):
    idx = _index(spark, sf_dir, "structural")
    return I.title_terms(idx.snippets()).groupBy("word").agg(F.count(F.lit(1)).cast("long").alias("n"))


def _code_search(spark, sf_dir):
    idx = _index(spark, sf_dir, "structural")
    return S.search(idx, code_queries(spark, sf_dir).select("query_id", "code"), SearchOptions())


def q_code_search_hits(spark, sf_dir):
    hits, _ = _code_search(spark, sf_dir)
    return hits.select(
        "query_id", "rank", "snippet_id", "score", "matched_tokens_count",
        F.col("title.repo").alias("repo"), F.col("title.filename").alias("filename"), "url",
        F.array_join("lines", ",").alias("lines"),
        F.col("preview.line_start").alias("line_start"), F.col("preview.display_start").alias("display_start"),
        F.size("preview.rows").alias("n_rows"), F.get("preview.rows", 0).alias("first_row"),
        F.array_join("preview.hl", ",").alias("hl"))


def q_code_search_results(spark, sf_dir):
    _, results = _code_search(spark, sf_dir)
    return results.select("query_id", "has_results", F.coalesce(F.size("similar"), F.lit(0)).cast("int").alias("n_hits"),
                          F.col("error").isNotNull().alias("is_error"))


def q_code_search_json(spark, sf_dir):
    _, results = _code_search(spark, sf_dir)
    return S.results_json(results)


def q_code_ingest_report(spark, sf_dir):
    c = code_corpus(spark, sf_dir).select("snippet_id", "repo", "content")
    return ST.ingest_report(TK.parse_code(c, keep_nodes="none", hashes=False))


def q_code_corpus_meta(spark, sf_dir):
    return ST.corpus_meta(code_corpus(spark, sf_dir))


def q_code_ingest_budget(spark, sf_dir):
    """IDX9, EXT13, IDX4, STA3 as one operator: suppliers are repositories in the order of their keys, and files are added until a
    million bytes are in."""
    from ..operators.ingest import ingest_repositories
    files = code_corpus(spark, sf_dir).select("repo", F.concat(F.lit("src/"), F.col("snippet_id").cast("string"), F.lit(".py")).alias("relpath"), "content")
    key = F.col("s_suppkey").cast("string")
    repos = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("r"), key).alias("name"),
                                                    F.concat(F.lit("https://h/r"), key).alias("html_url"), F.lit("h").alias("head"))
    idx = I.create_index(spark, scratch_path(spark, "ingest"))
    return ingest_repositories(idx, repos, files, max_bytes=1_000_000, already=0).select("repo", "bytes", "admitted", "accepted", "skipped")


def q_code_ingest_total(spark, sf_dir):
    """STA3 with its total row (repo is null)."""
    c = code_corpus(spark, sf_dir).select("snippet_id", "repo", "content")
    return ST.ingest_report(TK.parse_code(c, keep_nodes="none", hashes=False), with_total=True)


def q_code_meta_file(spark, sf_dir):
    """SRC7: the metadata aggregate written as a file and read back."""
    from ..sources.items import read_meta, write_meta
    path = scratch_path(spark, "meta")
    write_meta(ST.corpus_meta(code_corpus(spark, sf_dir)), path)
    return read_meta(spark, path)


def q_part_repo_file(spark, sf_dir):
    """SRC1: lists of repositories in the published form, written from parts and read back; every fiftieth has a text where its
    stars should be and is kept aside."""
    from ..sources.repos import read_repos, rejected_repos
    p = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))
    text = F.to_json(F.struct(name.alias("name"), F.col("p_type").alias("language"), F.col("p_size").cast("long").alias("stargazers_count"),
                              F.floor(F.col("p_retailprice") * 11).cast("long").alias("size"), F.struct(F.col("p_brand").alias("login")).alias("owner")))
    text = F.when(F.col("p_partkey") % 50 == 0, F.regexp_replace(text, '"stargazers_count":[0-9]+', '"stargazers_count":"many"')).otherwise(text)
    path = scratch_path(spark, "repo-lists")
    files = p.groupBy((F.col("p_partkey") % 8).alias("k")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(text), ","), F.lit("]")).alias("value"))
    files.repartition(8, "k").select(F.regexp_replace("value", "\n", " ").alias("value")).write.text(path)
    good = read_repos(spark, path).select("name", "language", "stars", "size_kb", F.lit(None).cast("string").alias("record"))
    bad = rejected_repos(spark, path).select(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("language"),
                                             F.lit(None).cast("long").alias("stars"), F.lit(None).cast("long").alias("size_kb"), "record")
    return good.unionByName(bad)


def q_code_files_to_documents(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    files = li.select(F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("repo"),
                      F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit("/f"),
                               F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_orderkey").cast("string"),
                               F.lit(".py")).alias("relpath"),
                      F.lit(None).cast("string").alias("content"))
    repos = (table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0)
             .select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("name"),
                     F.concat(F.lit("https://github.com/x/r"), F.col("s_suppkey").cast("string")).alias("html_url"),
                     F.concat(F.lit("h"), F.col("s_nationkey").cast("string")).alias("head")))
    return H.files_to_documents(files, repos).select("title", "url")


# =========================================================================== words on documents

def _doc_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("snippet_id"), F.col("text").alias("content"))
    return TK.word_tokenizer()(d)


def q_word_postings(spark, sf_dir):
    p = (_doc_terms(spark, sf_dir).groupBy("term_hash", "snippet_id")
         .agg(F.min("term").alias("term"), F.count(F.lit(1)).cast("long").alias("tf"),
              F.sort_array(F.collect_list("pos")).alias("positions")))
    return p.select("term", F.col("snippet_id").alias("doc_id"), "tf", F.array_join("positions", " ").alias("positions"))


def q_word_doc_freq(spark, sf_dir):
    per_doc = _doc_terms(spark, sf_dir).groupBy("term_hash", "snippet_id").agg(F.min("term").alias("term"))
    return per_doc.groupBy("term_hash").agg(F.min("term").alias("term"),
                                            F.count(F.lit(1)).cast("long").alias("df")).select("term", "df")


def q_word_stats(spark, sf_dir):
    idx = _index(spark, sf_dir, "words")
    return idx.stats().select("n_docs", "total_len", F.round(F.col("total_len") / F.col("n_docs"), 6).alias("avgdl"))


def q_word_df_quantiles(spark, sf_dir):
    q = I.df_quantiles(_index(spark, sf_dir, "words"))
    return q.select("n_terms", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")], "max_df")


def q_word_bm25_top10(spark, sf_dir):
    idx = _index(spark, sf_dir, "words")
    qs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("code"))
    hits, _ = S.search(idx, qs, SearchOptions(), decorate_hits=False)
    return hits.select("query_id", "rank", F.col("snippet_id").alias("doc_id"), "score", "matched_tokens_count")


def q_doc_line_window(spark, sf_dir):
    """QRY8-QRY11 on documents: marked lines = lines longer than 80 characters; kept from the
    first longest run on; anchor from their first run; preview window from the first kept line.
    A document's lines are bounded by the document, so runs are one array pass per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = F.filter(F.transform(L.text_lines(F.col("text")), lambda line, i: F.when(F.length(line) > 80, i + 1)),
                      lambda n: n.isNotNull())
    run = L.longest_run_of_sorted(F.col("marked"))
    out = (d.withColumn("marked", marked).where(F.size("marked") > 0)
           .withColumn("run", run).withColumn("kept", F.filter("marked", lambda n: n >= F.col("run.start")))
           .withColumn("pv", L.preview(F.col("text"), F.col("kept"), 10)))
    return out.select("doc_id", F.array_join("kept", ",").alias("kept_lines"),
                      L.anchor(F.col("run.start"), F.col("run.end")).alias("anchor"),
                      F.col("pv.display_start").alias("display_start"), F.size("pv.rows").alias("n_rows"),
                      F.length(F.get("pv.rows", 0)).alias("first_row_len"), F.array_join("pv.hl", ",").alias("hl"))


def q_docs_code_lines(spark, sf_dir):
    return ST.code_line_count(table(spark, sf_dir, "documents"), "text", by=("source",))


def q_docs_snippet_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    txt = H.snippet_text_from_pieces(F.split("text", "\n"))
    return d.select("doc_id", F.md5(txt).alias("text_md5"), F.length(txt).alias("text_len"))


# =========================================================================== relational forms

def q_lineitem_longest_run(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey")
    lr = L.longest_run(v, ["l_suppkey"], "l_orderkey")
    si = L.longest_run_start_index(v, ["l_suppkey"], "l_orderkey", lr=lr)
    return lr.join(si, "l_suppkey").select("l_suppkey", "run_start", "run_end", F.col("run_len").cast("long"), "start_index")


def q_lineitem_first_run(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber")
    return L.first_run(v, ["l_partkey"], "l_linenumber")


def q_events_first_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return H.dedup_first_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select(
        "event_id", "user_id", "event_type", "value")


def q_orders_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c/"), F.col("o_custkey").cast("string")).alias("url"),
                                              "o_orderkey", "o_orderstatus")
    return I.replace_by_key(o.where("o_orderstatus = 'F'").drop("o_orderstatus"),
                          o.where("o_orderstatus = 'O'").drop("o_orderstatus"), "url")


def q_orders_budget(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sizes = o.groupBy("o_custkey").agg(F.sum(F.floor("o_totalprice").cast("long")).alias("bytes"))
    ran = I.running_sum_before(sizes, "o_custkey", "bytes")
    return ran.where(F.col("bytes_before") <= 1_000_000_000).select("o_custkey", "bytes", "bytes_before")


def q_lineitem_crawl(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    li = table(spark, sf_dir, "lineitem")
    edges = (li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"),
                       F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
             .unionByName(li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"),
                                    F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))))
    seeds = (table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
             .select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("url")))
    return H.crawl_edges(edges, seeds).select("url", F.col("depth").cast("int").alias("depth"))


def q_part_select_repos(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    repos = p.select(F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")).alias("name"),
                     F.when(F.col("p_type") == "ECONOMY", F.lit("Python")).otherwise(F.col("p_type")).alias("language"),
                     F.col("p_size").cast("long").alias("stars"),
                     F.floor(F.col("p_retailprice") * 11).cast("long").alias("size_kb"))
    return select_repos(repos).select("name", "stars", "size_kb")


# =========================================================================== pages

def q_pages_toc_links(spark, sf_dir):
    return H.toc_links(table(spark, sf_dir, "pages"), ARTICLE_RULES, key_cols=("page_id",)).select("page_id", "ord", "link")


def q_pages_toc_links_jvm(spark, sf_dir):
    return H.toc_links_regex(table(spark, sf_dir, "pages"), "nav", key_cols=("page_id",)).select("page_id", "ord", "link")


def q_pages_sections(spark, sf_dir):
    s = H.extract_sections(table(spark, sf_dir, "pages"), ARTICLE_RULES, key_cols=("page_id",), validate=False)
    return s.select("page_id", "title", "url", F.size("snippets_raw").alias("n_blocks"),
                    F.aggregate("snippets_raw", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("text_len"))


def _page_items(spark, sf_dir):
    s = H.extract_sections(table(spark, sf_dir, "pages"), ARTICLE_RULES, key_cols=("page_id",), validate=False)
    return s.select("page_id", "title", "url", F.col("snippets_raw").alias("code_snippets"))


def q_pages_item_feeds(spark, sf_dir):
    """SRC5: items written as two JSON feeds (English pages first, then the others) and read
    back as one bag union: (feed, url, n_snippets)."""
    from ..sources.items import read_items, write_items
    items = _page_items(spark, sf_dir)
    first, second = scratch_path(spark, "feed-en"), scratch_path(spark, "feed-other")
    write_items(items.where(F.col("url").contains("/en/")), first)
    write_items(items.where(~F.col("url").contains("/en/")), second)
    return read_items(spark, first, second).select("feed", "url", F.size("code_snippets").alias("n_snippets"))


def q_pages_explode_items(spark, sf_dir):
    """EXT12: one document per snippet of an item, title and url repeated: (url, ord, text_len)."""
    docs = I.explode_items(_page_items(spark, sf_dir).withColumn("item_ord", F.col("page_id")))
    return docs.select("url", F.col("ord").cast("int").alias("ord"), F.length("content").alias("text_len"))


def q_pages_dedup_url(spark, sf_dir):
    s = H.extract_sections(table(spark, sf_dir, "pages"), ARTICLE_RULES, key_cols=("page_id",), validate=False)
    # items of a host and language share a url; every third comes without code and must not win
    url = F.regexp_extract("url", r"^(https?://[^/]+/[^/?#]*)", 1)
    items = s.select("page_id", url.alias("url"), F.when(F.col("page_id") % 3 == 0, F.array()).otherwise(F.col("snippets_raw")).cast("array<string>").alias("code_snippets"))
    return H.dedup_by_url(H.drop_empty_items(items), [F.col("page_id")]).select("url", "page_id")


def q_manual_items(spark, sf_dir):
    """EXT4-EXT9 on nested sections and definitions, by joins over DOM rows."""
    from ..operators import dom as D
    found = D.extract_items(manual_pages(spark, sf_dir), F.col("custkey"))
    return found.select(F.col("page").alias("custkey"), "ord", "title", "url", F.size("snippets_raw").alias("n_raw"), F.size("code_snippets").alias("n_ok"),
                        F.md5(F.array_join("snippets_raw", "|")).alias("raw_md5"))


def q_manual_first_wins(spark, sf_dir):
    """EXT9-EXT11: items left with code, the first of every url."""
    from ..operators import dom as D
    found = D.clean_items(D.extract_items(manual_pages(spark, sf_dir), F.col("custkey")))
    return found.select(F.col("page").alias("custkey"), "ord", "url", F.array_join("code_snippets", "|").alias("code"))


def q_manual_crawl(spark, sf_dir):
    """EXT3, library rule: any depth, pages without links are leaves; the links have cycles."""
    seeds = spark.createDataFrame([("https://h/c1.html",)], "url string")
    return H.crawl(index_pages(spark, sf_dir), seeds, LIBRARY_RULES).select("url", F.col("depth").cast("int").alias("depth"), "is_leaf")


def q_manual_crawl_tutorial(spark, sf_dir):
    """EXT3, tutorial rule: the seeds are expanded once, what they link to is parsed."""
    seeds = table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("https://h/c"), F.col("c_custkey").cast("string"), F.lit(".html")).alias("url"))
    return H.crawl(index_pages(spark, sf_dir), seeds, TUTORIAL_RULES).select("url", F.col("depth").cast("int").alias("depth"), "is_leaf")


# =========================================================================== streaming

def _stream_of(spark, df, key=None, files=3):
    """``df`` as a file stream of several micro-batches: written once to ``files`` files (rows of equal ``key`` in one) in the
    shared folder, read one file at a time. The table itself may be a file or a folder."""
    path = scratch_path(spark, "stream-in")
    (df.repartition(files, key) if key else df.repartition(files)).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run_to_table(spark, stream):
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def q_stream_dedup_urls(spark, sf_dir):
    """STR1: the first page of each host and language wins; the urls repeat within and between micro-batches."""
    from ..streaming.items import dedup_stream
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^(https?://[^/]+/[^/?#]*)", 1).alias("url"), "page_id")
    return _run_to_table(spark, dedup_stream(_stream_of(spark, pages)).select("url"))


def q_stream_events_dedup(spark, sf_dir):
    """STR1 over a month of events: the first event per (user, type) of all time, so the state is every key ever seen (a
    watermark's window would let keys come again)."""
    from ..streaming.items import dedup_stream
    events = table(spark, sf_dir, "events").withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    return _run_to_table(spark, dedup_stream(_stream_of(spark, events), url_col="key").select("user_id", "event_type"))


def q_stream_state(spark, sf_dir):
    """STR1 over twenty micro-batches with the state of all keys in RocksDB, by their hashes: first events per (user, type), and how many
    keys the state holds at the end."""
    from ..streaming.items import dedup_stream, rocksdb_state, state_rows
    events = table(spark, sf_dir, "events").withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    first = dedup_stream(_stream_of(spark, events, files=20), url_col="key", hashed=True).select("key")
    with rocksdb_state(spark):
        query = first.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        query.awaitTermination()
    keys = spark.read.parquet(out)
    return keys.agg(F.count("*").alias("n_first"), F.count_distinct("key").alias("n_keys")).select(
        "n_first", "n_keys", F.lit(state_rows(query)).cast("long").alias("state_rows"), F.lit(len({p["batchId"] for p in query.recentProgress if p["numInputRows"]})).cast("long").alias("batches"))


def q_stream_index_stats(spark, sf_dir):
    from ..streaming.items import index_stream
    path = scratch_path(spark, "stream-index")
    I.create_index(spark, path)
    docs = code_corpus(spark, sf_dir).select("snippet_id", "title", "url", "content")
    q = index_stream(_stream_of(spark, docs), path, scratch_path(spark, "stream-index-ck"), documents=True)
    q.awaitTermination()
    st = I.open_index(spark, path).stats()
    return st.select("n_docs", "total_len", F.round(F.col("total_len") / F.col("n_docs"), 6).alias("avgdl"))


def q_stream_two_feeds(spark, sf_dir):
    """STR2, STR3 and IDX6 together: one stream adds the items of finished and open orders, another one, with a checkpoint of
    its own, replaces those of customers with a pending order. Every seventh order's only snippet does not parse: the
    item is dropped by the cleaning pass. The live documents afterwards: (url, content)."""
    from ..streaming.items import clean_stream, index_stream
    bad = F.col("o_orderkey") % 7 == 0
    items = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("title"), F.concat(F.lit("https://h/"), F.col("o_custkey").cast("string")).alias("url"),
        F.array(F.concat(F.when(bad, F.lit("def (: ")).otherwise(F.lit("")), F.lit("v = c.m"), F.col("o_orderkey").cast("string"), F.lit("()"))).alias("code_snippets"),
        F.col("o_orderkey").cast("long").alias("item_ord"), F.col("o_orderstatus").alias("_s"))
    path = scratch_path(spark, "two-feeds")
    I.create_index(spark, path)
    for status, upsert in ((F.col("_s") != "P", False), (F.col("_s") == "P", True)):
        feed = _stream_of(spark, items.where(status).drop("_s"), "url", 2)
        index_stream(clean_stream(feed), path, scratch_path(spark, "two-feeds-ck"), upsert=upsert).awaitTermination()
    return I.iter_documents(I.open_index(spark, path)).select("url", "content")


QUERIES = {
    "code_parse_status": q_code_parse_status,
    "code_term_roots": q_code_term_roots,
    "code_type_sequences": q_code_type_sequences,
    "code_index_stats": q_code_index_stats,
    "code_iter_documents": q_code_iter_documents,
    "code_scan_documents": q_code_scan_documents,
    "code_term_identity": q_code_term_identity,
    "code_term_positions": q_code_term_positions,
    "code_data_search": q_code_data_search,
    "code_data_search_no_root": q_code_data_search_no_root,
    "code_names_df_histogram": q_code_names_df_histogram,
    "part_gram_top10": q_part_gram_top10,
    "code_title_terms": q_code_title_terms,
    "code_df_histogram": q_code_df_histogram,
    "code_search_hits": q_code_search_hits,
    "code_search_results": q_code_search_results,
    "code_search_json": q_code_search_json,
    "code_ingest_report": q_code_ingest_report,
    "code_corpus_meta": q_code_corpus_meta,
    "code_ingest_budget": q_code_ingest_budget,
    "code_ingest_total": q_code_ingest_total,
    "code_meta_file": q_code_meta_file,
    "part_repo_file": q_part_repo_file,
    "code_files_to_documents": q_code_files_to_documents,
    "word_postings": q_word_postings,
    "word_doc_freq": q_word_doc_freq,
    "word_stats": q_word_stats,
    "word_df_quantiles": q_word_df_quantiles,
    "word_bm25_top10": q_word_bm25_top10,
    "doc_line_window": q_doc_line_window,
    "docs_code_lines": q_docs_code_lines,
    "docs_snippet_text": q_docs_snippet_text,
    "lineitem_longest_run": q_lineitem_longest_run,
    "lineitem_first_run": q_lineitem_first_run,
    "events_first_wins": q_events_first_wins,
    "orders_upsert": q_orders_upsert,
    "orders_budget": q_orders_budget,
    "lineitem_crawl": q_lineitem_crawl,
    "part_select_repos": q_part_select_repos,
    "pages_toc_links": q_pages_toc_links,
    "pages_toc_links_jvm": q_pages_toc_links_jvm,
    "pages_sections": q_pages_sections,
    "pages_dedup_url": q_pages_dedup_url,
    "pages_item_feeds": q_pages_item_feeds,
    "pages_explode_items": q_pages_explode_items,
    "manual_items": q_manual_items,
    "manual_first_wins": q_manual_first_wins,
    "manual_crawl": q_manual_crawl,
    "manual_crawl_tutorial": q_manual_crawl_tutorial,
    "stream_dedup_urls": q_stream_dedup_urls,
    "stream_events_dedup": q_stream_events_dedup,
    "stream_state": q_stream_state,
    "stream_index_stats": q_stream_index_stats,
    "stream_two_feeds": q_stream_two_feeds,
}
