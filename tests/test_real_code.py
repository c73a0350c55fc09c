"""Real Python code (standard library files of this interpreter; read-only, small sample).

Checks on real syntax: the bottom-up hash equals text equality; self-retrieval; and the hit
lines / anchors of search equal a brute force that walks every node of the hit directly.
"""
import ast
import os
import textwrap

import pytest
from pyspark.sql import functions as F

from shapeindex.config import DEFAULT_OPTIONS as O
from shapeindex.config import SearchOptions
from shapeindex.functions.pyast import analyze, dump_text
from shapeindex.operators import index as I
from shapeindex.operators import search as S
from shapeindex.session import scratch_path

STDLIB = os.path.dirname(os.__file__)
FILES = ["bisect.py", "colorsys.py", "keyword.py", "fnmatch.py", "glob.py", "heapq.py", "shlex.py",
         "textwrap.py", "this.py", "graphlib.py", "sched.py", "stringprep.py", "genericpath.py", "numbers.py"]


def _texts():
    out = []
    for i, f in enumerate(FILES):
        p = os.path.join(STDLIB, f)
        if os.path.exists(p):
            with open(p, encoding="utf-8") as fh:
                out.append((i, f"stdlib {f}", f"https://github.com/x/stdlib/blob/h/{f}", fh.read()))
    return out


def _preorder(node):
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(reversed(list(ast.iter_child_nodes(n))))


def _height(node):
    return max((_height(c) + 1 for c in ast.iter_child_nodes(node)), default=0)


def _first_term_text(node):
    for sub in _preorder(node):
        if _height(sub) >= O.min_depth and type(sub).__name__ not in O.drop_node_names:
            return dump_text(sub, O)
    return None


def brute_lines(code, matched_texts):
    """Every node whose own first term is matched contributes all line numbers below it; then
    keep from the first longest step-1 run to the end; anchor from the first run of those."""
    lines = set()
    for node in ast.walk(ast.parse(code)):
        if _first_term_text(node) in matched_texts:
            lines |= {n.lineno for n in ast.walk(node) if hasattr(n, "lineno")}
    seq = sorted(lines)
    best_i, best_n, i = 0, 1, 0
    while i < len(seq):
        j = i
        while j + 1 < len(seq) and seq[j + 1] - seq[j] == 1:
            j += 1
        if j - i + 1 > best_n:
            best_i, best_n = i, j - i + 1
        i = j + 1
    kept = seq[best_i:]
    e = 0
    while e + 1 < len(kept) and kept[e + 1] - kept[e] == 1:
        e += 1
    anchor = f"#L{kept[0]}" if e == 0 else f"#L{kept[0]}-L{kept[e]}"
    return kept, anchor


@pytest.fixture(scope="module")
def real(spark):
    docs = _texts()
    if len(docs) < 5:
        pytest.skip("standard library sources not available")
    df = spark.createDataFrame(docs, "snippet_id long, title string, url string, content string")
    idx = I.create_index(spark, scratch_path(spark, "stdlib"))
    assert I.add_documents(idx, df) == (len(docs), 0)
    return idx, docs


def test_hash_equality_is_text_equality_on_real_code(real):
    _, docs = real
    by_hash, by_text = {}, {}
    for _, _, _, code in docs:
        p = analyze(code, O, with_text=True)
        for h, t in zip(p.term_hash, p.term_text):
            if h is not None:
                by_hash.setdefault(h, set()).add(t)
                by_text.setdefault(t, set()).add(h)
    assert all(len(v) == 1 for v in by_hash.values()) and all(len(v) == 1 for v in by_text.values())


def test_queries_from_real_code_match_brute_force(spark, real):
    idx, docs = real
    queries = []
    for sid, _, _, code in docs:
        tree = ast.parse(code)
        defs = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.ClassDef))][:2]
        for k, d in enumerate(defs):
            queries.append((sid * 10 + k, ast.get_source_segment(code, d)))
        # inner statements, comprehensions first (their line-less `comprehension` nodes can match)
        inner = [n for f in defs for n in ast.walk(f) if isinstance(n, ast.stmt) and n is not f]
        inner.sort(key=lambda n: not any(isinstance(x, ast.comprehension) for x in ast.walk(n)))
        for k, st in enumerate(inner[:4]):
            text = textwrap.dedent(ast.get_source_segment(code, st, padded=True))
            queries.append((sid * 10 + 2 + k, text))
    qs = spark.createDataFrame(queries, "query_id long, code string")
    hits, _ = S.search(idx, qs, SearchOptions(k=3))
    rows = hits.collect()
    by_id = {sid: code for sid, _, _, code in docs}
    qtext = dict(queries)
    corpus_terms = set()
    for _, _, _, code in docs:
        corpus_terms |= {t for t in analyze(code, O, with_text=True).term_text if t}
    findable = {q for q, c in queries if corpus_terms & {t for t in analyze(c, O, with_text=True).term_text if t}}
    assert {r.query_id for r in rows if r.rank == 1} == findable
    for r in rows:
        q_terms = set(t for t in analyze(qtext[r.query_id], O, with_text=True).term_text if t)
        doc_terms = set(t for t in analyze(by_id[r.snippet_id], O, with_text=True).term_text if t)
        assert r.matched_tokens_count == len(q_terms & doc_terms)
        kept, anchor = brute_lines(by_id[r.snippet_id], q_terms & doc_terms)
        assert r.lines == kept, (r.query_id, r.snippet_id)
        assert r.url.endswith(anchor)
        assert r.preview.line_start == kept[0]
