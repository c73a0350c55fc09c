"""Ranked search against exhaustive scores; pair bounds against what documents hold."""
from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shapeindex.llm import maxscore

DOC = "doc_id long, text string, score long, rank string"
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(i, Counter(words(t))) for i, t, *_ in docs]
    bags = [(i, c) for i, c in bags if c]
    n_docs, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(w for _, c in bags for w in c)
    asked = {}
    for i, t, *_ in items:
        asked.setdefault(i, set()).update(words(t))
    out = {}
    for item, terms in asked.items():
        found = []
        for i, c in bags:
            m = 8 * (10 + 90 * sum(c.values()) * n_docs // total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + m)) for w in terms if w in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out[item] = [(r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return {i: r for i, r in out.items() if r}


def tables(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(120)]
    draw = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([6, 30, 120])]) for _ in range(n))
    docs = [(i, draw(rng.choice([1, 3, 20, 80])), 1, "x") for i in range(300)]
    docs += [(1000 + i, docs[4][1], 1, "x") for i in range(120)]  # ties
    docs += [(300, None, 1, "x"), (301, "", 1, "x"), (302, " .,- ", 1, "x"), (None, docs[3][1], 1, "x"), (None, draw(9), 1, "x"), (5, draw(30), 1, "x"), docs[7], docs[7],
             (303, "ÄB Äb äB " + "abc " * 5000, 1, "x"), (304, "É3 é3 e3", 1, "x")]
    items = [(i, draw(rng.choice([1, 4, 25])), 2, "y") for i in range(25)]
    items += [(30, None, 2, "y"), (31, "", 2, "y"), (32, "nowhere", 2, "y"), (None, draw(5), 2, "y"), (2, draw(3), 2, "y"), items[4], (33, "äB É3 -äb", 2, "y"), (34, docs[4][1], 2, "y")]
    return docs, items


@pytest.mark.parametrize("block_docs,group_terms", [(16, 40), (4096, 200_000)])
def test_ranking_equals_exhaustive(spark, block_docs, group_terms):
    docs, items = tables(block_docs)
    index = maxscore.build_index(spark.createDataFrame(docs, DOC).repartition(3), block_docs=block_docs)
    got = maxscore.search(index, spark.createDataFrame(items, "item_id long, text string, doc_id long, term string"), 10, group_terms).collect()
    want = brute(docs, items, 10)
    assert {(r.item_id, r.rank): (r.doc_id, r.score) for r in got} == {(i, r): (d, s) for i, rows in want.items() for r, d, s in rows}
    assert len(got) == sum(map(len, want.values()))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert maxscore.search(maxscore.build_index(docs), items).count() == 0
    full = maxscore.build_index(spark.createDataFrame([(1, "a", 1, "x")], DOC))
    assert maxscore.search(full, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in maxscore.search(full, items).collect()] == [(1, 1, 1)]


def lists_of(docs, terms):
    rows = next(maxscore._index(1 << 30, 1 << 30)([pa.RecordBatch.from_pydict({"id": pa.array([d[0] for d in docs], pa.int64()), "text": [d[1] or "" for d in docs]})]))
    n_docs, total = len(rows.column(0)[0].as_py()), sum(rows.column(1)[0].as_py())
    vocabulary = pa.array(terms, pa.binary())
    plain = maxscore.Lists(rows, vocabulary, n_docs, total)
    w = np.array([maxscore.weight(plain.size(t), n_docs) if t in plain.place else 0 for t in range(len(terms))])
    return lambda: maxscore.Lists(rows, vocabulary, n_docs, total, w)


def test_pair_bounds_skip_more_than_single_ones():
    """Two frequent terms that no document has together: their joint bound lets the documents of both be skipped."""
    docs = [(i, ("red " if i % 2 else "blue ") + f"x{i} " * 3, 0, "") for i in range(2000)] + [(5000 + i, "red rare blue", 0, "") for i in range(3)]
    terms = [b"blue", b"rare", b"red"]
    fresh = lists_of([d for d in docs], terms)
    lists = fresh()
    top = np.array([int(lists.impacts(t)[1].max()) for t in range(3)])
    order = sorted(range(3), key=lambda t: (top[t], t))
    a, b = order[:2]
    together = maxscore.joint(lists, a, b)
    pair = {(a, b): max(int(together.max()), int(top[a]), int(top[b]))}
    assert pair[a, b] <= top[a] + top[b]
    apart = lists_of(docs[:2000], [b"blue", b"red"])()
    assert len(maxscore.joint(apart, 0, 1)) == 0
    best = sorted((int(s) for s in maxscore.score_block(fresh(), maxscore.Item(order, 0), 0, top, pair)[1]), reverse=True)[2]
    for bounds in (pair, {(a, b): int(top[a] + top[b])}):
        lists = fresh()
        found, score = maxscore.score_block(lists, maxscore.Item(order, 0), best, top, bounds)
        assert sorted(lists.ids[found]) == [5000, 5001, 5002] and (score >= best).all()


@pytest.mark.parametrize("seed", range(5))
def test_prefix_bounds_hold(seed):
    docs, items = tables(seed)
    terms = sorted({w.encode() for i in items for w in words(i[1])})
    lists = lists_of(docs, terms)()
    top = np.array([int(lists.impacts(t)[1].max()) if t in lists.place else 0 for t in range(len(terms))])
    order = [t for t in sorted(range(len(terms)), key=lambda t: (top[t], t)) if top[t] > 0]
    pair = {}
    for k in range(0, len(order) - 1, 2):
        j = maxscore.joint(lists, order[k], order[k + 1])
        pair[order[k], order[k + 1]] = max([*j.tolist(), int(top[order[k]]), int(top[order[k + 1]])])
    here, bounds = maxscore.prefix_bounds(order, lists.place, top, pair)
    sums = np.zeros(len(lists), np.int64)
    for n, t in enumerate(here):
        docs_, impact = lists.impacts(t)
        sums[docs_] += impact
        assert sums.max() <= bounds[n + 1] <= sum(int(top[x]) for x in here[: n + 1])


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(maxscore, "PIECE", 7)
    text = "Ab,cd-EF éÉ x1 " * 50
    assert maxscore.term_counts(text) == Counter(w.encode() for w in words(text))


def test_a_row_group_is_a_block(spark):
    """A reader decodes a whole row group: many blocks of one task must not stand in one."""
    docs = spark.createDataFrame([(i, f"w{i % 7} x{i}", 1, "x") for i in range(64)], DOC).coalesce(1)
    blocks = maxscore.build_index(docs, block_docs=4).blocks
    sizes = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    groups = [m.row_group(g).num_rows for m in sizes for g in range(m.num_row_groups)]
    assert groups == [1] * 16


def test_passes_send_small_batches(spark, monkeypatch):
    seen = []
    whole = maxscore._passes
    monkeypatch.setattr(maxscore, "_passes", lambda s, *a: seen.append(s.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) or whole(s, *a))
    index = maxscore.build_index(spark.createDataFrame([(1, "a b", 1, "x")], DOC))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    assert maxscore.search(index, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 1
    assert seen == ["8m"] and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
