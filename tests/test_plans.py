"""Scale properties of the physical plans of the registered queries (sf0.001)."""
import pytest

from shapeindex.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def _plan_text(df):
    qe = df._jdf.queryExecution()
    formatted = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return qe.explainString(formatted) + "\n" + qe.executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: _plan_text(fn(spark, SF)) for name, fn in QUERIES.items()}


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = {n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p}
    assert not bad


def test_python_only_in_the_parse_passes(plans):
    for name, p in plans.items():
        if "ArrowEvalPython" in p or "BatchEvalPython" in p:  # row-at-a-time or scalar Python UDFs
            pytest.fail(f"{name} uses a Python UDF")


def test_search_prunes_buckets_and_limits_early(spark):
    from shapeindex.plans import registry as R
    from shapeindex.plans.corpus import code_queries
    from shapeindex.operators import search as S
    from shapeindex.config import SearchOptions
    from pyspark.sql import functions as F
    idx = R._index(spark, SF, "structural")
    prepared = S.prepare_queries(idx, code_queries(spark, SF).select("query_id", "code"))
    st_sig = S.signature_terms(prepared).cache()
    n = st_sig.count()
    buckets = [r[0] for r in st_sig.select(F.pmod("term_hash", F.lit(idx.term_buckets)).cast("int")).distinct().collect()]
    n_docs, total = idx.stats_row()
    st = S.term_side(idx, st_sig, n, buckets, SearchOptions(), total / n_docs, n_docs)
    top = S.top_k(S.score_candidates(idx, st, n, buckets, SearchOptions(), total / n_docs), 10)
    p = _plan_text(top)
    import re
    assert re.search(r"PartitionFilters: \[[^\n]*term_bucket#\d+ IN(SET)? ", p)
    assert p.count("WindowGroupLimit") >= 2  # partial (before the shuffle) and final
    assert "BroadcastExchange" in p
    # column pruning: scoring never reads positions or document text
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", p)
    assert schemas and not any("positions" in x or "content" in x for x in schemas)


def test_few_terms_are_filtered_in_the_scan(spark, monkeypatch):
    """The values of a small term set reach the Parquet reader, which has a Bloom filter for them; a large set is joined."""
    import re

    from shapeindex.config import SearchOptions
    from shapeindex.operators import search as S
    from shapeindex.plans import registry as R
    from shapeindex.plans.corpus import code_queries
    idx = R._index(spark, SF, "structural")
    qs = code_queries(spark, SF).select("query_id", "code")
    sig = S.signature_terms(S.prepare_queries(idx, qs)).cache()
    some = S.touched(idx, sig, list(range(idx.term_buckets)))
    assert some.terms and len(some.terms) == sig.select("term_hash").distinct().count()
    plan = _plan_text(S._postings(idx, some))
    assert re.search(r"PushedFilters: \[[^\n]*(In|Or)\([^\n]*term_hash", plan)
    hits = {tuple(r)[:4] for r in S.search(idx, qs, SearchOptions(), decorate_hits=False)[0].collect()}
    monkeypatch.setattr(S, "PUSHED_TERMS", 1)
    assert S.touched(idx, sig, [0]).terms is None
    assert {tuple(r)[:4] for r in S.search(idx, qs, SearchOptions(), decorate_hits=False)[0].collect()} == hits


def test_first_wins_dedup_limits_before_shuffle(plans):
    assert plans["events_first_wins"].count("WindowGroupLimit") >= 2
