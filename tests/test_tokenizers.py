"""Indexes over tokenizers given by the caller (UDF1), and the numbers of documents."""
import math

import pytest
from pyspark.sql import functions as F

from shapeindex.config import SearchOptions
from shapeindex.operators import index as I
from shapeindex.operators import search as S
from shapeindex.operators import terms as TK
from shapeindex.session import scratch_path
from shapeindex.sources import store

DOC = "snippet_id long, title string, url string, content string"


def grams(text, n=3):
    return [text.lower()[i : i + n] for i in range(len(text) - n + 1)]


def test_grams_rank_as_bm25(spark):
    texts = ["small ring", "Small Rings and springs", "ringing", "xy", "", "bolt", "small ring"]
    idx = I.create_index(spark, scratch_path(spark, "grams"), tokenizer=TK.GRAMS)
    docs = spark.createDataFrame([(i, "", f"u{i}", t) for i, t in enumerate(texts)] + [(99, "", "u99", None)], DOC)
    assert I.add_documents(idx, docs) == (7, 1)
    idx = I.open_index(spark, idx.path)  # found by its registered name
    assert idx.tokenizer is TK.GRAMS and I.index_len(idx) == 7
    queries = ["ring", "zzz", "small", "RING spring", "r", None]
    qs = spark.createDataFrame(list(enumerate(queries)), "query_id long, code string")
    hits, results = S.search(idx, qs, SearchOptions(k=3))
    got = {(r.query_id, r.rank): (r.snippet_id, r.score, r.matched_tokens_count) for r in hits.collect()}
    bags = [grams(t) for t in texts]
    avg = sum(map(len, bags)) / len(bags)
    want = {}
    for q, text in enumerate(queries):
        scored = []
        for i, bag in enumerate(bags):
            found = [g for g in set(grams(text or "")) if g in bag]
            score = 0.0
            for g in found:
                df, tf = sum(g in b for b in bags), bag.count(g)
                score += (math.log(len(bags) / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / avg))
            if found:
                scored.append((-round(score, 6), i, len(found)))
        for r, (s, i, n) in enumerate(sorted(scored)[:3]):
            want[q, r + 1] = (i, -s, n)
    assert got == want
    flags = {r.query_id: (r.has_results, r.error) for r in results.collect()}
    assert flags[1] == (False, None) and flags[5] == (False, "null text") and flags[0][0]


def test_any_dataframe_function_is_a_tokenizer(spark):
    """A tokenizer that uses a join and a window: words with their kind, stop words of a table left out."""
    stop = spark.createDataFrame([("the",), ("a",)], "term string")

    def run(df):
        words = df.select("snippet_id", F.posexplode(F.split("content", " ")).alias("pos", "term"))
        return words.join(stop, "term", "left_anti")

    spec = TK.TokenizerSpec("no-stop-words", "3", run)
    idx = I.create_index(spark, scratch_path(spark, "own"), tokenizer=spec)
    I.add_documents(idx, spark.createDataFrame([(1, "", "u", "the cat"), (2, "", "u", "a the"), (3, "", "u", "cat a cat")], DOC))
    assert {r.snippet_id: r.dl for r in idx.snippets().collect()} == {1: 1, 2: 0, 3: 2}
    rows = {r.snippet_id: (r.tf, r.positions) for r in idx.postings().where(F.col("term_hash") == F.xxhash64(F.lit("cat"))).collect()}
    assert rows == {1: (1, [1]), 3: (2, [0, 2])}
    with pytest.raises(RuntimeError, match="no tokenizer"):
        I.open_index(spark, idx.path)
    with pytest.raises(RuntimeError, match="no-stop-words 4"):
        I.open_index(spark, idx.path, TK.TokenizerSpec("no-stop-words", "4", run))
    again = I.open_index(spark, idx.path, spec)
    items = spark.createDataFrame([("t", "u", ["the dog", "dog"])], "title string, url string, code_snippets array<string>")
    assert I.update_items(again, items) == (2, 0)
    assert I.index_len(again) == 2 and [r.df for r in again.terms().collect()] == [2]


def test_names_are_kept(spark):
    idx = I.create_index(spark, scratch_path(spark, "names"), tokenizer=TK.NAMES)
    I.add_documents(idx, spark.createDataFrame([(1, "", "u", "x = a.f()"), (2, "", "u", "y = a.f()"), (3, "", "u", "def (:")], DOC))
    hits, _ = S.search(idx, spark.createDataFrame([(1, "x = a.f()")], "query_id long, code string"))
    assert [r.snippet_id for r in hits.collect()] == [1]
    assert {r.snippet_id: r.dl for r in idx.snippets().collect()} == {1: 1, 2: 1, 3: 0}


def test_kinds_and_columns_are_checked(spark):
    with pytest.raises(ValueError, match="kind"):
        I.create_index(spark, scratch_path(spark, "k"), kind="other")
    with pytest.raises(ValueError, match="kind"):
        I.create_index(spark, scratch_path(spark, "k"), kind="tokens")
    idx = I.create_index(spark, scratch_path(spark, "k"), tokenizer=TK.TokenizerSpec("bad", "1", lambda df: df.select("snippet_id")))
    with pytest.raises(ValueError, match="must give"):
        I.add_documents(idx, spark.createDataFrame([(1, "", "u", "x")], DOC))


@pytest.mark.parametrize("tokenizer,kind", [(None, "words"), (TK.GRAMS, "structural")])
def test_numbers_of_documents(spark, tokenizer, kind):
    """Rows that differ in a null only, and rows that are equal, are documents of their own, in one batch and over batches."""
    idx = I.create_index(spark, scratch_path(spark, "ids"), kind=kind, tokenizer=tokenizer)
    rows = [("x = a.b()", None), (None, "x = a.b()"), ("x", "y = a.b()"), ("x", "y = a.b()"), (None, "x = a.b()"), ("x", "x = c.d()")]
    df = spark.createDataFrame([(t, "u", c) for t, c in rows], "title string, url string, content string").repartition(3)
    for _ in range(2):
        I.add_documents(idx, df)
    ids = [r.snippet_id for r in idx.snippets().select("snippet_id").collect()]
    n = 12 if kind == "words" else 10
    assert len(ids) == len(set(ids)) == n and 0 <= min(ids) and max(ids) < 12
    assert I.index_len(idx) == n
    given = spark.createDataFrame([(500, "t", "u", "z = q.r()")], DOC)
    I.add_documents(idx, given)
    I.add_documents(idx, df.where("title = 'x'"))
    assert idx.snippets().where("snippet_id > 500").count() == 3
    post = idx.postings().select("snippet_id").distinct()
    assert post.join(idx.snippets(), "snippet_id", "left_anti").count() == 0


def test_no_room_for_numbers(spark):
    idx = I.create_index(spark, scratch_path(spark, "ids"), kind="words")
    I.add_documents(idx, spark.createDataFrame([((1 << 63) - 2, "t", "u", "a b")], DOC))
    with pytest.raises(ValueError, match="room"):
        I.add_documents(idx, spark.createDataFrame([("t", "u", "a b")], "title string, url string, content string"))


def test_terms_combined_by_the_pass_make_the_same_index(spark):
    """UDF1 without shuffles: a tokenizer that gives a text's postings in its row builds what its rows would."""
    texts = ["x = a.b(c).d(c)\ny = a.b(c).d(c)", "def (:", "", None, "z = 1", "def f(a):\n    return g(a.b(c).d(a))"]
    docs = spark.createDataFrame([(i, "t", f"u{i}", t) for i, t in enumerate(texts)] + [(None, "t", "u9", texts[0])], DOC)
    rows_only = TK.TokenizerSpec("names", "1", TK.NAMES.run)
    assert TK.NAMES.postings is not None
    built = []
    for spec in (TK.NAMES, rows_only):
        idx = I.create_index(spark, scratch_path(spark, "names"), tokenizer=spec, term_buckets=4, doc_buckets=2)
        counts = I.add_documents(idx, docs)
        tables = [sorted(map(str, t.select(*sorted(t.columns)).collect())) for t in (idx.snippets(), idx.postings(), idx.terms(), idx.stats())]
        built.append((counts, *tables))
        assert any(n.startswith("postings-stage") for n in store.list_names(spark, idx.path)) == (spec is rows_only)
    assert built[0] == built[1] and built[0][0] == (6, 1) and len(built[0][2]) > 4
