"""Index lifecycle: create/open errors, bulk add, upsert golden, length, iteration, budget."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from shapeindex.operators import index as I
from shapeindex.operators import search as S
from shapeindex.session import scratch_path


def test_create_and_open_errors(spark):
    path = scratch_path(spark, "life")
    with pytest.raises(RuntimeError):
        I.open_index(spark, path)
    I.create_index(spark, path)
    with pytest.raises(RuntimeError):
        I.create_index(spark, path)
    assert I.open_index(spark, path).version == 1


def test_upsert_golden(spark):
    """committed (u1, a), (u2, b); batch (u1, [c, d]) -> (u2, b), (u1, c), (u1, d)."""
    path = scratch_path(spark, "upsert")
    idx = I.create_index(spark, path)
    code = {"a": "x = a.f()", "b": "y = b.g()", "c": "z = c.h()", "d": "w = d.k()"}
    first = spark.createDataFrame([("t u1", "u1", [code["a"]], 0), ("t u2", "u2", [code["b"]], 1)],
                                  "title string, url string, code_snippets array<string>, item_ord long")
    assert I.add_items(idx, first) == (2, 0)
    batch = spark.createDataFrame([("t u1", "u1", [code["c"], code["d"], "def (:"], 0)],
                                  "title string, url string, code_snippets array<string>, item_ord long")
    assert I.update_items(idx, batch) == (2, 1)
    idx = I.open_index(spark, path)
    live = sorted((r.url, r.content) for r in I.iter_documents(idx).collect())
    assert live == sorted([("u2", code["b"]), ("u1", code["c"]), ("u1", code["d"])])
    assert I.index_len(idx) == 3
    # replaced documents no longer match; df and N are recomputed from live rows
    qs = spark.createDataFrame([(0, "q = a.f()"), (1, "q = c.h()")], "query_id long, code string")
    hits = {r.query_id for r in S.search(idx, qs)[0].collect()}
    assert hits == {1}
    assert idx.terms().where(F.col("df") > 0).count() == 3


def test_iter_documents_limit(spark, fixture_index):
    assert I.iter_documents(fixture_index, limit=3).count() == 3
    assert I.iter_documents(fixture_index).count() == 7


def test_postings_and_df(spark):
    terms = spark.createDataFrame([(1, 0, 10), (1, 1, 10), (1, 2, 11), (2, 0, 10)], "snippet_id long, pos int, term_hash long")
    p = {(r.term_hash, r.snippet_id): (r.tf, r.positions) for r in I.build_postings(terms).collect()}
    assert p == {(10, 1): (2, [0, 1]), (11, 1): (1, [2]), (10, 2): (1, [0])}
    df = {r.term_hash: r.df for r in I.doc_freq(I.build_postings(terms)).collect()}
    assert df == {10: 2, 11: 1}


def test_admit_within_budget(spark):
    sizes = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 3, 5), ("d", 4, 1)], "repo string, seq int, bytes long")
    got = [r.repo for r in I.admit_within_budget(sizes, 10).orderBy("seq").collect()]
    assert got == ["a", "b", "c"]  # c starts at 10 <= 10; d starts at 15


def test_title_terms(spark):
    df = spark.createDataFrame([(1, "The os.path module: A guide to files")], "snippet_id long, title string")
    words = [r.word for r in I.title_terms(df).orderBy("pos").collect()]
    assert words == ["os.path", "module", "guide", "files"]


def test_words_index_bm25(spark):
    path = scratch_path(spark, "words")
    idx = I.create_index(spark, path, kind="words")
    docs = spark.createDataFrame([(1, "", "u", "a b c"), (2, "", "u", "a a d"), (3, "", "u", "e")],
                                 "snippet_id long, title string, url string, content string")
    I.add_documents(idx, docs)
    hits, _ = S.search(idx, spark.createDataFrame([(0, "a")], "query_id long, code string"), decorate_hits=False)
    got = [(r.snippet_id, r.score) for r in hits.orderBy("rank").collect()]
    import math
    n, avgdl = 3, 7 / 3
    idf = math.log(n / 3) + 1
    w = lambda tf, dl: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert got == [(2, round(w(2, 3), 6)), (1, round(w(1, 3), 6))]


def test_search_on_empty_index(spark):
    idx = I.create_index(spark, scratch_path(spark, "empty"))
    hits, results = S.search(idx, spark.createDataFrame([(0, "x = a.f()")], "query_id long, code string"))
    assert hits.count() == 0
    r = results.first()
    assert not r.has_results and r.error is None
    assert I.index_len(idx) == 0


def test_bucket_choice(spark):
    small = spark.createDataFrame([(1, "t", "u", "x = a.f()")], "snippet_id long, title string, url string, content string")
    assert I.choose_buckets(small) == (64, 16)
    idx = I.create_index(spark, scratch_path(spark, "buckets"))
    assert idx.meta["term_buckets"] is None
    I.add_documents(idx, small)
    assert (idx.term_buckets, idx.doc_buckets) == (64, 16)
    assert I.open_index(spark, idx.path).meta["term_buckets"] == 64
    fixed = I.create_index(spark, scratch_path(spark, "buckets2"), term_buckets=8, doc_buckets=4)
    I.add_documents(fixed, small)
    assert (fixed.term_buckets, fixed.doc_buckets) == (8, 4)


def test_words_upsert_updates_df(spark):
    idx = I.create_index(spark, scratch_path(spark, "wup"), kind="words")
    first = spark.createDataFrame([("t", "u1", ["a b"], 0), ("t", "u2", ["b c"], 1)],
                                  "title string, url string, code_snippets array<string>, item_ord long")
    I.add_items(idx, first)
    I.update_items(idx, spark.createDataFrame([("t", "u1", ["c d"], 0)],
                                              "title string, url string, code_snippets array<string>, item_ord long"))
    idx = I.open_index(spark, idx.path)
    df = {r.term_hash: r.df for r in idx.terms().collect()}
    from pyspark.sql import functions as F
    h = {w: spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in "abcd"}
    assert {w: df.get(h[w], 0) for w in "abcd"} == {"a": 0, "b": 1, "c": 2, "d": 1}
    assert idx.stats_row() == (2, 4)


def test_concurrent_commit_second_writer_fails(spark):
    path = scratch_path(spark, "race")
    I.create_index(spark, path)
    a, b = I.open_index(spark, path), I.open_index(spark, path)
    d1 = spark.createDataFrame([(1, "t", "u1", "x = a.f()")], "snippet_id long, title string, url string, content string")
    d2 = spark.createDataFrame([(2, "t", "u2", "y = b.g()")], "snippet_id long, title string, url string, content string")
    I.add_documents(a, d1)
    with pytest.raises(Exception):
        I.add_documents(b, d2)  # same version: the metadata file already exists
    live = I.open_index(spark, path)
    assert [r.snippet_id for r in I.iter_documents(live).collect()] == [1]
    assert live.stats_row() == (1, 1)


def test_compact_keeps_answers(spark):
    path = scratch_path(spark, "compact")
    idx = I.create_index(spark, path)
    for i, url in enumerate(["u1", "u2", "u3"]):
        I.add_items(idx, spark.createDataFrame([("t", url, [f"v{i} = o.m{i}()", "w = a.b.c()"], 0)],
                                               "title string, url string, code_snippets array<string>, item_ord long"))
    I.update_items(idx, spark.createDataFrame([("t", "u2", ["z = q.r()"], 0)],
                                              "title string, url string, code_snippets array<string>, item_ord long"))
    idx = I.open_index(spark, path)
    qs = spark.createDataFrame([(0, "x = o.m1()"), (1, "k = a.b.c()"), (2, "y = q.r()")], "query_id long, code string")
    before = sorted((r.query_id, r.snippet_id, r.score, r.url) for r in S.search(idx, qs)[0].collect())
    docs_before = sorted(tuple(r) for r in I.iter_documents(idx).collect())
    assert len(idx.meta["segments"]) == 4 and idx.meta["tombstones"]
    I.compact_index(idx)
    c = I.open_index(spark, path)
    assert len(c.meta["segments"]) == 1 and c.meta["tombstones"] is None
    assert sorted(tuple(r) for r in I.iter_documents(c).collect()) == docs_before
    assert sorted((r.query_id, r.snippet_id, r.score, r.url) for r in S.search(c, qs)[0].collect()) == before
    assert c.stats_row() == idx.stats_row()


def test_hot_term_postings_are_split_across_files(spark):
    """A term in two thirds of all snippets is written by several tasks (range partitioning on
    (bucket, term, snippet)), not by one."""
    rows = [(i, "t", f"u{i}", "x = a.f()" if i % 3 else f"y{i} = b.g{i}()") for i in range(3000)]
    docs = spark.createDataFrame(rows, "snippet_id long, title string, url string, content string")
    idx = I.create_index(spark, scratch_path(spark, "hot"), term_buckets=4, doc_buckets=4)
    # AQE would (rightly) merge these tiny partitions into one; at scale they stay apart
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        I.add_documents(idx, docs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    post = idx.postings().withColumn("file", F.input_file_name())
    hot = post.groupBy("term_hash").count().orderBy(F.desc("count")).first()
    assert hot["count"] == 2000
    files = post.where(F.col("term_hash") == hot["term_hash"]).select("file").distinct().count()
    assert files > 1


def test_parse_once_per_text_gives_the_same_index(spark):
    """Duplicated texts (here 3 distinct among 90) index identically with and without dedupe."""
    texts = ["x = a.f()\ny = b.g(1)\n", "def f(a):\n    return a.b.c()\n", "def (:\n"]
    rows = [(i, "t", f"u{i}", texts[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "snippet_id long, title string, url string, content string")
    out = {}
    for mode in (False, True, None):
        idx = I.create_index(spark, scratch_path(spark, f"dedupe-{mode}"))
        counts = I.add_documents(idx, docs, dedupe=mode)
        out[mode] = (counts, idx.stats_row(),
                     sorted(tuple(r) for r in idx.postings().select("term_hash", "snippet_id", "tf", "dl", "positions").collect()),
                     sorted(tuple(r) for r in idx.nodes().select("snippet_id", "pre", "size", "lineno", "term_hash", "first_term_hash").collect()))
    assert out[False] == out[True] == out[None]
    assert out[True][0] == (60, 30)


def test_dedupe_estimate_on_large_inputs(spark, monkeypatch):
    """Auto mode estimates the duplicate share only for large inputs; the result is the same."""
    monkeypatch.setattr(I, "DEDUPE_MIN_BYTES", 0)
    rows = [(i, "t", f"u{i}", "x = a.f()\n" if i % 2 else "def f(a):\n    return a.b.c()\n") for i in range(40)]
    docs = spark.createDataFrame(rows, "snippet_id long, title string, url string, content string")
    a = I.create_index(spark, scratch_path(spark, "est"))
    assert I.add_documents(a, docs) == (40, 0)
    assert a.stats_row() == (40, 20 * 1 + 20 * 3)


def test_compact_words_index(spark):
    path = scratch_path(spark, "wcompact")
    idx = I.create_index(spark, path, kind="words")
    for i in range(3):
        I.add_items(idx, spark.createDataFrame([("t", f"u{i}", [f"alpha beta w{i}"], 0)],
                                               "title string, url string, code_snippets array<string>, item_ord long"))
    I.update_items(idx, spark.createDataFrame([("t", "u1", ["gamma beta"], 0)],
                                              "title string, url string, code_snippets array<string>, item_ord long"))
    idx = I.open_index(spark, path)
    qs = spark.createDataFrame([(0, "beta"), (1, "w1"), (2, "gamma")], "query_id long, code string")
    before = sorted((r.query_id, r.snippet_id, r.score) for r in S.search(idx, qs, decorate_hits=False)[0].collect())
    I.compact_index(idx)
    c = I.open_index(spark, path)
    after = sorted((r.query_id, r.snippet_id, r.score) for r in S.search(c, qs, decorate_hits=False)[0].collect())
    assert after == before and len(c.meta["segments"]) == 1
    assert {q for q, _, _ in after} == {0, 2}  # "w1" was replaced


def test_repeats_and_readded_documents_are_own_documents(spark):
    path = scratch_path(spark, "repeats")
    idx = I.create_index(spark, path)
    docs = spark.createDataFrame([("t", "u1", "x = a.f()")] * 2 + [("t", "u2", "y = b.g()")], "title string, url string, content string")
    assert I.add_documents(idx, docs) == (3, 0)
    assert I.add_documents(I.open_index(spark, path), docs) == (3, 0)  # the same batch again
    idx = I.open_index(spark, path)
    assert I.index_len(idx) == 6 and idx.snippets().select("snippet_id").distinct().count() == 6
    # replaced by url, then added again: the tombstones do not reach later documents
    items = spark.createDataFrame([("t", "u1", ["z = c.h()"], 0)], "title string, url string, code_snippets array<string>, item_ord long")
    assert I.update_items(idx, items) == (1, 0)
    assert I.index_len(I.open_index(spark, path)) == 3
    assert I.add_documents(I.open_index(spark, path), docs) == (3, 0)
    idx = I.open_index(spark, path)
    assert I.index_len(idx) == 6 and I.iter_documents(idx).count() == 6
    q = spark.createDataFrame([(1, "x = a.f()")], "query_id long, code string")
    hits = S.search(idx, q)[0].collect()
    assert len(hits) == 2 and len({h.snippet_id for h in hits}) == 2 and {h.matched_tokens_count for h in hits} == {hits[0].matched_tokens_count}


def test_long_integers_are_valid_in_both_passes(spark):
    from shapeindex.operators import terms as TK

    docs = spark.createDataFrame([(1, "v = c.load(0x" + "f" * 4000 + ")")], "snippet_id long, content string")
    for hashes in (True, False):
        assert [r.valid for r in TK.parse_code(docs, keep_nodes="none", hashes=hashes).select("valid").collect()] == [True]


def test_building_a_plan_runs_no_job(spark):
    from shapeindex.operators import terms as TK

    docs = spark.range(100).groupBy((F.col("id") % 7).alias("snippet_id")).agg(F.max("id").cast("string").alias("content"))
    spark.sparkContext.setJobGroup("plan-only", "no job")
    TK.parse_code(docs, keep_nodes="none")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []


def test_tasks_of_a_build_grow_with_its_nodes_and_terms(spark, monkeypatch):
    """What a task sorts does not grow with the input, and nothing is cached: the parsed rows are written once."""
    cores = spark.sparkContext.defaultParallelism
    assert I._write_tasks(spark, 0, 1600) is I._write_tasks(spark, 100, 1600) is None
    assert I._write_tasks(spark, 1600, 1600) == min(cores, 16)
    assert I._write_tasks(spark, 1600 * 50 + 1, 1600) == max(51, min(cores, 801))
    monkeypatch.setattr(I, "TASK_NODES", 320)
    monkeypatch.setattr(I, "TASK_TERMS", 32)
    monkeypatch.setattr("pyspark.sql.DataFrame.persist", lambda *a, **k: pytest.fail("the parsed rows are cached"))
    rows = [(i, "t", f"u{i}", None if i == 7 else "def (:" if i == 8 else f"x = a.m{i}()\ny = b.g({i})\n") for i in range(400)]
    docs = spark.createDataFrame(rows, "snippet_id long, title string, url string, content string")
    idx = I.create_index(spark, scratch_path(spark, "tasks"), term_buckets=1, doc_buckets=1)
    assert I.add_documents(idx, docs) == (398, 2)
    seg = idx.meta["segments"][0]
    files = {t: idx.segment(seg, t).select(F.input_file_name()).distinct().count() for t in ("snippets", "nodes", "postings")}
    assert files["snippets"] > 15 and files["nodes"] > 15 and files["postings"] > 15
    assert idx.snippets().where("content like 'x = a.m%'").count() == 398
    per_file = [r["ids"] for r in idx.segment(seg, "nodes").groupBy(F.input_file_name()).agg(F.collect_list("snippet_id").alias("ids")).collect()]
    assert all(ids == sorted(ids) for ids in per_file)
    spans = sorted((min(ids), max(ids)) for ids in per_file)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
