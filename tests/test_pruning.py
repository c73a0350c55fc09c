"""Exact top-k pruning returns the same hits as exhaustive scoring, for any rare-term limit."""
import re

import pytest
from pyspark.sql import functions as F

from shapeindex.config import SearchOptions
from shapeindex.operators import index as I
from shapeindex.operators import search as S
from shapeindex.plans.corpus import code_corpus, code_queries, table
from shapeindex.session import scratch_path

SF = "/root/testdata/sf0.01"


def _key(hits):
    return sorted((r.query_id, r.rank, r.snippet_id, r.score, r.matched_tokens_count) for r in hits.collect())


@pytest.fixture(scope="module")
def word_index(spark):
    idx = I.create_index(spark, scratch_path(spark, "prune-words"), kind="words")
    docs = table(spark, SF, "documents").select(F.col("doc_id").alias("snippet_id"), F.lit("").alias("title"),
                                                F.col("source").alias("url"), F.col("text").alias("content"))
    I.add_documents(idx, docs, batch_seq=0)
    return idx


@pytest.mark.parametrize("prune_df", [3, 50, 400])
def test_words_pruned_equals_exhaustive(spark, word_index, prune_df):
    qs = table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("code"))
    full, _ = S.search(word_index, qs, SearchOptions(prune=False), decorate_hits=False)
    want = _key(full)
    pruned, _ = S.search(word_index, qs, SearchOptions(prune=True, prune_df=prune_df), decorate_hits=False)
    assert _key(pruned) == want and len(want) == 400


def test_words_pruning_decides_some_queries(spark, word_index):
    """With a mid-size limit some signatures are answered from rare-term candidates alone."""
    qs = table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("code"))
    prepared = S.prepare_queries(word_index, qs)
    st_sig = S.signature_terms(prepared)
    n = st_sig.count()
    buckets = [r[0] for r in st_sig.select(F.pmod("term_hash", F.lit(word_index.term_buckets)).cast("int"))
               .distinct().collect()]
    n_docs, total = word_index.stats_row()
    st = S.term_side(word_index, st_sig, n, buckets, SearchOptions(), total / n_docs, n_docs).cache()
    limit = 50
    common = st.where(F.col("df") > limit).groupBy("qsig").agg(F.sum("ub").alias("u"))
    assert common.count() > 0  # the common-term bound is exercised
    S.pruned_top_k(word_index, st, n, buckets, SearchOptions(prune_df=limit), total / n_docs, n_docs).count()


def test_code_pruned_equals_exhaustive(spark):
    idx = I.create_index(spark, scratch_path(spark, "prune-code"))
    I.add_documents(idx, code_corpus(spark, "/root/testdata/sf0.001").select("snippet_id", "title", "url", "content"))
    qs = code_queries(spark, "/root/testdata/sf0.001").select("query_id", "code")
    want = _key(S.search(idx, qs, SearchOptions(prune=False), decorate_hits=False)[0])
    for limit in (1, 100):
        got = _key(S.search(idx, qs, SearchOptions(prune=True, prune_df=limit), decorate_hits=False)[0])
        assert got == want


def test_pruning_decides_a_rare_plus_common_query(spark):
    """A specific term next to a ubiquitous one: the rare candidates alone settle the top-k."""
    rows = [(i, "", "u", "common " + ("special " if i % 10 == 0 else "") + f"w{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "snippet_id long, title string, url string, content string")
    idx = I.create_index(spark, scratch_path(spark, "prune-decide"), kind="words")
    I.add_documents(idx, docs)
    qs = spark.createDataFrame([(0, "common special")], "query_id long, code string")
    want = _key(S.search(idx, qs, SearchOptions(prune=False), decorate_hits=False)[0])
    got = _key(S.search(idx, qs, SearchOptions(prune=True, prune_df=30), decorate_hits=False)[0])
    assert got == want and len(want) == 10
    assert S.LAST_PRUNE["tried"] == 1 and S.LAST_PRUNE["decided"] == 1


def test_a_posting_is_not_sent_once_per_signature(spark, word_index, monkeypatch):
    """Documents are dealt before they meet the signatures: what is sent does not grow with the signatures of a term, and there
    are more tasks as the matches grow."""
    common = [r[0] for r in word_index.terms().orderBy(F.desc("df"), "term_hash").limit(3).collect()]
    sigs = [(s, t) for s in range(40) for t in common]
    st = S.term_side(word_index, spark.createDataFrame(sigs, "qsig long, term_hash long"), len(sigs),
                     list(range(word_index.term_buckets)), SearchOptions(), 300.0, 1000).cache()
    buckets = list(range(word_index.term_buckets))
    monkeypatch.setattr(S, "TASK_MATCHES", 5000, raising=False)
    scored = S.score_candidates(word_index, st, len(sigs), buckets, SearchOptions(), 300.0)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    matches = st.agg(F.sum("df")).first()[0]
    assert "Exchange hashpartitioning(qsig" not in plan
    assert re.search(rf"Exchange hashpartitioning\(snippet_id#\d+L, {-(-matches // 5000)}\), REPARTITION", plan) and matches > 5000
    one = word_index.postings().where(F.col("term_hash").isin(common)).select("snippet_id").distinct().count()
    assert scored.count() == 40 * one and scored.where("matched_tokens_count = 3").count() > 0


def test_texts_are_spread_before_they_are_cut_into_grams(spark):
    from shapeindex.operators import terms as TK

    texts = spark.createDataFrame([(i, f"label {i}") for i in range(10)], "snippet_id long, content string").coalesce(1)
    grams = TK.gram_tokenizer(3)(texts)
    assert grams.rdd.getNumPartitions() > 1
    assert grams.where("snippet_id = 7").orderBy("pos").first()["term"] == "lab" and grams.count() == 10 * 5
