"""Processes that parse are ended and begun anew: what they keep of the names they read is bounded, results are the same."""
import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shapeindex.functions import renewal
from shapeindex.operators import terms as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def batch(*texts):
    return pa.RecordBatch.from_pydict({"content": pa.array(texts, pa.string())})


def size(b):
    return sum(len(x or "") for x in b.column(0).to_pylist())


def test_results_come_in_order_from_several_processes(monkeypatch):
    monkeypatch.setattr(renewal, "_taken", 0)
    mark = lambda b: (pa.RecordBatch.from_pydict({"pid": [os.getpid()], "text": [x]}) for x in b.column(0).to_pylist())
    batches = [batch("a" * 4, f"b{k}") for k in range(6)] + [batch()]
    out = [r.to_pylist()[0] for r in renewal.renewed(mark, batches, size, 12)]
    assert [r["text"] for r in out] == [x for k in range(6) for x in ("aaaa", f"b{k}")]
    pids = [r["pid"] for r in out][::2]
    assert pids[:2] == [os.getpid()] * 2 and pids[2] == pids[3] != pids[4] == pids[5] and os.getpid() not in pids[2:]


def test_errors_and_early_ends(monkeypatch):
    monkeypatch.setattr(renewal, "_taken", 99)

    def run(b):
        yield b
        raise ValueError("no such text")

    rows = renewal.renewed(run, [batch("x")], size, 1)
    assert next(rows).num_rows == 1
    with pytest.raises(RuntimeError, match="no such text"):
        next(rows)
    made = []
    begin = renewal._Child.__init__
    monkeypatch.setattr(renewal._Child, "__init__", lambda self, f: (begin(self, f), made.append(self.pid))[0])
    rows = renewal.renewed(lambda b: iter([b] * 500), [batch("x" * 10_000)] * 3, size, 1)
    next(rows)
    rows.close()  # the child is waited for
    with pytest.raises(ChildProcessError):
        os.waitpid(made[-1], os.WNOHANG)
    dies = renewal.renewed(lambda b: os._exit(3), [batch("x")], size, 1)
    with pytest.raises(RuntimeError, match="before it was done"):
        next(dies)


def test_a_parsing_process_does_not_keep_all_names():
    """In a process of its own: 200,000 snippets of distinct names, which the parser would keep (some 30 MB)."""
    code = """
import pyarrow as pa
from shapeindex.config import DEFAULT_OPTIONS
from shapeindex.operators import terms as T
rss = lambda: int(open('/proc/self/statm').read().split()[1]) * 4096
from shapeindex.functions import renewal
renewal.RENEW_BYTES = 1 << 18
batches = lambda k: (pa.RecordBatch.from_pydict({"content": [f"name{k}_{a}_{i} = other{k}_{a}_{i}" for i in range(5000)]}) for a in range(20))
done = lambda k: [0 for b in T._parse_batches(batches(k), "content", DEFAULT_OPTIONS, "none", False, False, hashes=False)]
done(0)
before = rss()
done(1)
print(rss() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 5 << 20


def test_parse_pass_is_the_same(spark):
    texts = [(i, f"x{i} = f{i}(a.b).c({i})" if i % 3 else f"def (: {i}") for i in range(3000)]
    df = spark.createDataFrame(texts, "snippet_id long, content string")
    whole = T.parse_code(df, keep_nodes="index").select("snippet_id", "valid", "reason", "n_nodes", "dl", F.to_json("nodes").alias("n"), F.to_json("postings").alias("p"))

    def small(batches):
        was = renewal.RENEW_BYTES, renewal._taken  # the worker goes on to other tests
        renewal.RENEW_BYTES = renewal._taken = 1000
        try:
            yield from T._parse_batches(batches, "content", T.DEFAULT_OPTIONS, "index", False, False)
        finally:
            renewal.RENEW_BYTES, renewal._taken = was

    schema = T.parse_code(df, keep_nodes="index").schema
    again = T.spread(df, "snippet_id").mapInArrow(small, schema).select(*[F.to_json(c).alias(c[0]) if c in ("nodes", "postings") else c for c in ("snippet_id", "valid", "reason", "n_nodes", "dl", "nodes", "postings")])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))
