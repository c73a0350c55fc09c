"""Spark side of the tokenizer: nodes, term stream, type sequence, word tokenizer, hashing."""
import xxhash
from pyspark.sql import functions as F

from shapeindex.operators import terms as TK
from shapeindex.plans.fixtures import NODES, TERMS, template_text


def _docs(spark):
    return spark.createDataFrame([(t, template_text(t, t)) for t in range(8)], "snippet_id long, content string")


def test_parse_status_and_counts(spark):
    p = TK.parse_code(_docs(spark), keep_nodes="none")
    rows = {r.snippet_id: r for r in TK.parse_status(p).collect()}
    assert not rows[3].valid and rows[3].reason.startswith("SyntaxError")
    assert {t: rows[t].n_nodes for t in NODES} == NODES
    dl = {r.snippet_id: r.dl for r in p.select("snippet_id", "dl").collect()}
    assert {t: dl[t] for t in TERMS} == TERMS


def test_nodes_and_type_sequence(spark):
    p = TK.parse_code(_docs(spark).where("snippet_id = 0"), keep_nodes="all")
    seq = TK.type_sequence(p).first().type_sequence
    assert seq.startswith("Module Assign Name Store Call Attribute Name Load Load")
    n = TK.nodes(p)
    assert n.count() == 17
    # independent height cross-check by interval self-join (TOK4)
    h = TK.height_by_self_join(n).withColumnRenamed("height", "h2")
    bad = n.join(h, ["snippet_id", "pre"]).where(F.col("height") != F.col("h2")).count()
    assert bad == 0
    assert TK.height_filter(n).count() == 2  # Module and Assign
    assert TK.drop_roots(TK.height_filter(n)).count() == 1


def test_term_stream_positions(spark):
    p = TK.parse_code(_docs(spark), keep_nodes="terms", with_text=True)
    ts = TK.term_stream(p).where("snippet_id = 7").orderBy("pos").collect()
    assert [r.pos for r in ts] == [0, 1, 2, 3]
    assert ts[1].term.startswith("Expr(value=Call(func=Attribute(value=Name(ctx=Load()), attr='fast'")


def test_results_do_not_depend_on_partitioning(spark):
    a = TK.parse_code(_docs(spark).repartition(1), keep_nodes="none").select("snippet_id", "dl", "n_nodes")
    b = TK.parse_code(_docs(spark).repartition(5), keep_nodes="none").select("snippet_id", "dl", "n_nodes")
    assert sorted(a.collect()) == sorted(b.collect())


def test_word_tokenizer_and_text_hash(spark):
    d = spark.createDataFrame([(1, " a  bb\nccc a ")], "snippet_id long, content string")
    rows = TK.word_tokenizer()(d).orderBy("pos").collect()
    assert [(r.pos, r.term) for r in rows] == [(0, "a"), (1, "bb"), (2, "ccc"), (3, "a")]
    v = xxhash.xxh64_intdigest(b"bb", seed=42)
    assert rows[1].term_hash == (v - (1 << 64) if v >= (1 << 63) else v)


def test_structural_tokenizer_interface(spark):
    ts = TK.structural_tokenizer()(_docs(spark))
    assert set(ts.columns) == {"snippet_id", "pos", "term_hash", "term"}
    assert ts.count() == sum(TERMS.values())


def test_term_texts_audit(spark):
    t = {r.term_hash: r.term for r in TK.term_texts(_docs(spark)).collect()}
    assert len(t) == sum(TERMS.values())  # every template term is distinct
    assert any(v.startswith("Assign(targets=[Name(ctx=Store())], value=Call(") for v in t.values())


def test_spread_small_inputs_only(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").alias("snippet_id"), F.col("text").alias("content")).coalesce(1)
    want = spark.sparkContext.defaultParallelism * 2
    assert TK.spread(d, "snippet_id").rdd.getNumPartitions() == want
    monkeypatch.setattr(TK, "SPREAD_MAX_BYTES", 1)  # pretend the input is large: keep its splits
    assert TK.spread(d, "snippet_id").rdd.getNumPartitions() == 1


def test_output_slices_by_text_size(spark, monkeypatch):
    """Output batches are cut by source bytes; results do not depend on the cut."""
    monkeypatch.setattr(TK, "OUTPUT_SLICE_BYTES", 40)
    a = sorted(tuple(r) for r in TK.parse_code(_docs(spark), keep_nodes="none").select("snippet_id", "valid", "dl", "n_nodes").collect())
    assert [list(TK._slices(["aaaa", None, "bb", "c" * 50, "d"], 5))] == [[(0, 3), (3, 4), (4, 5)]]
    monkeypatch.setattr(TK, "OUTPUT_SLICE_BYTES", 8 << 20)
    b = sorted(tuple(r) for r in TK.parse_code(_docs(spark), keep_nodes="none").select("snippet_id", "valid", "dl", "n_nodes").collect())
    assert a == b and len(a) == 8


def test_bad_rows_never_fail_the_job(spark):
    bad = [(1, "x = 1\x00"), (2, "(" * 300 + ")" * 300), (3, "a" + ".b" * 20000), (4, "-" * 20000 + "1"),
           (5, None), (6, "y = a.f()")]
    rows = {r.snippet_id: r for r in TK.parse_status(
        TK.parse_code(spark.createDataFrame(bad, "snippet_id long, content string"), keep_nodes="none")).collect()}
    assert rows[6].valid and rows[6].n_nodes > 1
    for i in range(1, 6):
        assert not rows[i].valid and rows[i].reason


def test_status_without_hashes_matches(spark):
    full = TK.parse_code(_docs(spark), keep_nodes="none").select("snippet_id", "valid", "n_nodes", "dl")
    fast = TK.parse_code(_docs(spark), keep_nodes="none", hashes=False).select("snippet_id", "valid", "n_nodes", "dl")
    assert sorted(full.collect()) == sorted(fast.collect())


def test_terms_and_counts_without_hashes_equal_those_with(spark):
    """A pass whose result needs no hash makes none; nodes, positions and counts are the same."""
    from pyspark.sql import functions as F

    from shapeindex.operators import terms as TK

    texts = ["x = a.f()\ny = b.g(1)\n", "def f(a):\n    return a.b.c()\n", "def (:\n", "", None, "match a:\n    case {'k': v, **r} if v.x.y:\n        pass\n",
             "type A[T] = list[T]\nasync def f[T: int](*a, b=1, **k) -> int:\n    global g\n    return f'{a.b.c()!r:>{k}}'\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "snippet_id long, content string")
    kept = ["snippet_id", "pre", "size", "parent", "depth", "height", "node_type", "lineno", "pos"]
    got = {h: sorted(map(tuple, TK.nodes(TK.parse_code(docs, keep_nodes="terms", hashes=h)).select(*kept).collect())) for h in (True, False)}
    assert got[True] == got[False] and len(got[True]) > 8
    status = {k: sorted(map(str, TK.parse_code(docs, keep_nodes=k, hashes=k == "index").select("snippet_id", "valid", "reason", "n_nodes", "dl").collect())) for k in ("none", "index")}
    assert status["none"] == status["index"]
    assert TK.parse_code(docs, keep_nodes="terms", hashes=False).where(F.size("postings") > 0).count() == 0


def test_a_task_of_a_spread_input_does_not_grow_with_it(spark, monkeypatch):
    from shapeindex.operators import terms as TK

    monkeypatch.setattr(TK, "SPREAD_TASK_BYTES", 16_000, raising=False)
    least = 2 * spark.sparkContext.defaultParallelism
    big = spark.range(4 * least * 2000, numPartitions=1)  # 8 bytes a row
    monkeypatch.setattr(TK, "SPREAD_MAX_BYTES", 1 << 40)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert TK.spread(big, "id").rdd.getNumPartitions() == 4 * least
        assert TK.spread(spark.range(10), "id").rdd.getNumPartitions() == least
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_types_alone_are_those_of_the_whole_records(spark):
    for keep in ("all", "terms"):
        whole = TK.parse_code(_docs(spark), keep_nodes=keep, hashes=False)
        types = TK.parse_code(_docs(spark), keep_nodes=keep, hashes=False, types_only=True)
        assert types.schema["nodes"].dataType.elementType.names == ["node_type"]
        own = ("snippet_id", "valid", "reason", "n_nodes", "dl", "nodes.node_type")
        assert sorted(map(str, types.select(*own).collect())) == sorted(map(str, whole.select(*own).collect()))
