import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from shapeindex.session import local_session
    s = local_session("*", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fixture_index(spark):
    """Index of one snippet per fixture template T0-T7 (T3 is rejected)."""
    from shapeindex.operators import index as I
    from shapeindex.plans.fixtures import template_text
    from shapeindex.session import scratch_path
    docs = spark.createDataFrame(
        [(t, f"repo f{t}.py", f"https://github.com/x/repo/blob/abc/f{t}.py", template_text(t, t)) for t in range(8)],
        "snippet_id long, title string, url string, content string")
    idx = I.create_index(spark, scratch_path(spark, "fixture-index"))
    accepted, rejected = I.add_documents(idx, docs)
    assert (accepted, rejected) == (7, 1)
    return idx
