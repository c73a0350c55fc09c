"""Operators of the llm folder against brute force, on small tables with nulls, empty texts, ties and repeats."""
from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeindex.llm import bitsliced, components, decontaminate, neardup, repeats, sharding, suffixes, token_counts, tokenizer, toxicity, wrapper

DOC = "doc_id long, text string, lang string, source string, n_chars long, shard_hint string"


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """Texts with shared passages, exact and near copies, nulls, empty texts, a long text, repeated ids and rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(14, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))))
            if rng.random() < 0.5:
                parts.append(rng.choice(passages))
        sep = rng.choice([" ", "\n", "  ", "\t "])
        rows.append((i, sep.join(parts), "en", f"s{i % 3}", 1, "x"))
    rows += [(n, rows[5][1], "en", "s0", 1, None), (n + 1, rows[5][1] + " end", "en", None, None, "y"), (n + 2, None, None, None, None, None), (n + 3, "", "en", "s1", 0, ""),
             (None, rows[7][1], "en", "s1", 2, "z"), (n + 4, "aa " * 4000, "en", "s2", 3, "w"), (n + 5, " \t\n", "de", "s2", 3, "w"), rows[9], rows[9], (9, "another text of the same id " + passages[0], "en", "s1", 2, "q")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus(3)
    return rows, spark.createDataFrame(rows, DOC).repartition(5).cache()


def ordered(i):
    return (1 << 63) - 1 if i is None else i


# 1


def test_shards(spark, docs):
    rows, df = docs
    out = sharding.interleave(df, 7, ties=("text",), bucket_rows=10).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(7))
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in counts.items())
    for s in {r.source for r in out}:  # the mixture of each shard
        share = sum(r.source == s for r in out) / len(out)
        assert all(abs(sum(r.source == s for r in out if r.shard == k) - share * n) < 2 for k, n in counts.items())
    assert sharding.interleave(df.limit(0), 7).count() == 0
    assert sharding.interleave(df.limit(2), 40, bucket_rows=1).agg(F.max("slot")).first()[0] == 0
    with pytest.raises(ValueError, match="clash"):
        sharding.interleave(df.withColumn("slot", F.lit(1)), 3)


def test_shards_do_not_depend_on_buckets(spark, docs):
    a, b = ({(r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs[1], 5, ties=("text",), bucket_rows=n).collect()} for n in (4, 10_000))
    assert a == b


# 2


@pytest.mark.parametrize("seed", range(3))
def test_bitsliced_index(seed):
    rng = np.random.default_rng(seed)
    n, d = 300, 9
    values = rng.integers(-200, 150, (n, d))
    values[50:80] = values[50]
    ids = rng.permutation(n).astype(np.int64)
    index = bitsliced.Index(ids, values, -200, 9)
    for r in range(0, n, 37):
        q = values[r].astype(object)
        score = values @ values[r]
        want = sorted(((-int(s), int(i)) for s, i in zip(score, ids) if i != ids[r]))[:7]
        got, scores = index.top(q, 7, int(ids[r]))
        assert sorted(zip((-s for s in scores), got.tolist())) == want


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=5)], 1) for i in range(120)] + [(120, None, 1), (121, [1.0, None, 1.0, 1.0, 1.0], 1), (122, [float("nan")] * 5, 1), (None, [1.0] * 5, 1),
                                                                             (123, [], 1), (124, [9.5, -7.25], 1), (30, [0.5] * 5, 1), (31, [0.5] * 5, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    v = bitsliced.quantised(df, "vec_id", "embedding")
    got = bitsliced.top_k(v, v.where("id % 50 = 0"), 5, block_rows=20, chunk_queries=2).collect()
    q = [(r[0], [int(np.floor(256 * x)) for x in r[1]]) for r in rows if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    want = []
    for a, x in q:
        if a % 50 == 0:
            best = sorted((-sum(s * t for s, t in zip(x, y)), b) for b, y in q if b != a)[:5]
            want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert bitsliced.top_k(v.limit(0), v.limit(0), 5).count() == 0


# 3


def contaminated(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in decontaminate.UPPER else c for c in t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for s in range(max(0, len(w) - 13) + 1):
            if w:
                wins[tuple(w[s : s + 13])].add(i if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if own := wins.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination(spark, docs):
    rows, df = docs
    rng = random.Random(5)
    items = [(1, None), (2, ""), (None, rows[3][1]), (10, "no such words here"), (10, "no such words here"), (11, "one")]
    for k in range(8):
        w = (rows[rng.randint(0, 50)][1] or "").split()
        a = rng.randint(0, max(0, len(w) - 15))
        items.append((20 + k, "!" + "; ".join(w[a : a + rng.choice([1, 2, 5, 12, 13, 30])]).upper() + "."))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df.withColumn("n_words", F.lit("clash")), b)
    key = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(map(tuple, got.select(key).collect())) == Counter(contaminated([(r[0], r[1]) for r in rows], items))
    assert set(got.columns) == {*key, "lang", "source", "n_chars", "shard_hint"}
    clean = {(r.doc_id, r.text) for r in decontaminate.decontaminate(df, b).collect()}
    assert clean == {(r[0], r[1]) for r, c in zip(rows, contaminated([(r[0], r[1]) for r in rows], items)) if not c[-1]}
    assert decontaminate.contamination(df, b.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), b).count() == 0


def test_contamination_shuffled(spark, docs):
    """Beyond the broadcast bound both sides are shuffled: the same hits."""
    windows = decontaminate.benchmark_windows(docs[1].limit(9), "doc_id", "text").cache()
    d = docs[1].withColumn("_key", decontaminate.row_key("doc_id", "text"))
    a, b = ({(r["_key"], r.n_hit, tuple(r["items"])) for r in decontaminate.hits(d, ["_key"], windows, broadcast_rows=n).collect()} for n in (0, 1_000_000))
    assert a == b and a


def test_fingerprints_keep_every_window(spark):
    """Any 13 words in a row share a fingerprint with themselves alone, also beyond 65,536 words."""
    text = " ".join(f"w{i % 71}x{i % 977}" for i in range(70_000))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    w = text.split()
    b = spark.createDataFrame([(s, " ".join(w[s : s + 13])) for s in (0, 30_000, 65_530, 65_537, 69_987)], "item_id long, text string")
    assert decontaminate.contamination(d, b).first().n_items == 5


# 4


def test_probmin_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    h = rng.integers(1, 1 << 63, 400).astype(np.uint64)
    a, b = np.sort(h[:300]), np.sort(h[60:])
    wa, wb = rng.integers(1, 4, 300), rng.integers(1, 4, 340)
    exact = neardup.probability_jaccard(a, wa, b, wb)
    kept = neardup.signatures(2, np.repeat([0, 1], [300, 340]), np.concatenate([a, b]), np.concatenate([wa, wb]), 4096)
    assert abs((kept[0] == kept[1]).mean() - exact) < 0.03
    x, y = dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist()))
    every = x.keys() | y.keys()
    brute = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys())
    assert brute == pytest.approx(exact)


def brute_classes(rows):
    sets = []
    for i, t in rows:
        w = [x for x in re.split(r"[ \t-\r]+", (t or "").lower()) if x]
        sets.append(Counter(tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))) if w else Counter())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if rows[a][1] == rows[b][1] and x:
            up[root(b)] = root(a)
        elif x and y and len(x.keys() & y.keys()) * 3 > min(len(x), len(y)):
            s = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
            if s >= 0.8 - 1e-12:
                up[root(b)] = root(a)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root(k)].append(ordered(i))
    return [(i, min(least[root(k)])) if sets[k] else (i, ordered(i)) for k, (i, _) in enumerate(rows)]


def test_near_duplicate_classes(spark, docs):
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in docs[0]]
    base = [rng.choice("abcdefgh") + str(rng.randint(0, 500)) for _ in range(120)]
    for k in range(40):  # a group of near copies, some further from each other than from the base
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = f"edit{k}"
        rows.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, ordered(r.class_id)) for r in neardup.classes(df).collect())
    assert got == Counter(brute_classes(rows))
    kept = Counter((ordered(r.doc_id), r.text) for r in neardup.deduplicate(df).collect())
    assert kept == Counter({(ordered(i), t) for (i, c), (_, t) in zip(brute_classes(rows), rows) if ordered(i) == c})
    assert neardup.classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("block_rows,block_bytes", [(7, 1 << 20), (4096, 3000), (4096, 8 << 20)])
def test_templates_make_no_pairs(spark, monkeypatch, block_rows, block_bytes):
    """Texts that share seven tenths with one another, but for two that are closer: no pair of the others becomes a row, whatever
    the size of blocks."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    head = [word() for _ in range(100)]
    rows = [(i, " ".join(head + [word() for _ in range(21)])) for i in range(90)]
    rows.append((90, rows[40][1] + " end"))
    made = []
    real = neardup.across

    def counted(at, sets, threshold):
        out = real(at, sets, threshold, block_rows, block_bytes)
        made.append((out.count(), at.count()))
        return out

    monkeypatch.setattr(neardup, "across", counted)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 40 if i == 90 else i for i in range(91)}
    assert made[0][0] <= 1 and made[0][1] > 300  # members of open buckets, and the pairs made of them


def test_shared_shingles_bound_the_similarity():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ({rng.randint(0, 30): rng.choice([1, 1, 1, 2, 7]) for _ in range(rng.randint(1, 25))} for _ in range(2))
        x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
        wx, wy = (np.array([s[k] for k in sorted(s)], dtype=np.int32) for s in (a, b))
        s = neardup.probability_jaccard(x, wx, y, wy)
        pairs = lambda t: neardup.possible_links([b"a", b"b"], [1, 2], [True, True], [0], [v.tobytes() for v in (x, y)], [wx.tobytes(), wy.tobytes()], t)
        assert {x[:2] for x in pairs(s)} == {(b"a", b"b")} or s == 0
        if (wx == 1).all() and (wy == 1).all():
            assert not pairs(s + 1e-6)


def test_links_of_a_block_are_few():
    """Many texts that are all alike, in components of their own: as many links as connect them."""
    rng = np.random.default_rng(4)
    base = np.sort(rng.integers(0, 1 << 62, 400, dtype=np.uint64))
    hs = []
    for _ in range(60):
        own = base.copy()
        own[rng.integers(0, 400, 6)] = rng.integers(0, 1 << 62, 6, dtype=np.uint64)
        hs.append(np.sort(own).tobytes())
    nodes = [bytes([k]) for k in range(60)]
    links = neardup.possible_links(nodes, list(range(60)), [True] * 60, list(range(60)), hs, [b""] * 60, 0.8)
    assert len(links) == 59
    up = list(range(60))
    for a, b, *_ in links:
        x, y = up[a[0]], up[b[0]]
        up = [x if u == y else u for u in up]
    assert len(set(up)) == 1


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, rng.randint(101, 140)) for _ in range(30)] + [(7, 100)] * 0
    df = components.components(spark.createDataFrame(links, "a long, b long"))
    got = {r.node: r.comp for r in df.collect()}
    assert all(got[i] == 0 for i in range(41)) and all(c == 100 for n, c in got.items() if n >= 100)


# 5 and 8


def removed(seqs, ids, span):
    first = {}
    for i, s in zip(ids, seqs):
        for p in range(len(s) - span + 1):
            k = tuple(s[p : p + span])
            first[k] = min(first.get(k, ordered(None)), ordered(i))
    out = []
    for i, s in zip(ids, seqs):
        gone = [False] * len(s)
        for p in range(len(s) - span + 1):
            if first[tuple(s[p : p + span])] < ordered(i):
                gone[p : p + span] = [True] * span
        out.append(gone)
    return out


@pytest.mark.parametrize("chunk_bytes", [2000, 1 << 21])
def test_repeated_words(spark, docs, chunk_bytes):
    rows, df = docs
    words = [[w for w in re.split(r"[\x20\x09-\x0d]+", r[1] or "") if w] for r in rows]
    gone = removed(words, [r[0] for r in rows], 13)
    want = Counter((r[0], r[5], len(w), sum(g), " ".join(x for x, d in zip(w, g) if not d)) for r, w, g in zip(rows, words, gone))
    out = repeats.remove_repeats(df.withColumn("kept", F.lit(1)), chunk_bytes=chunk_bytes)
    assert Counter((r.doc_id, r.shard_hint, r.n_words, r.n_removed, r.kept) for r in out.collect()) == want
    assert sum(map(sum, gone)) > 500
    assert repeats.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk_bytes", [2000, 1 << 21])
def test_repeated_bytes(spark, docs, chunk_bytes):
    rows, df = docs
    texts = [(r[1] or "").encode() for r in rows]
    gone = removed(texts, [r[0] for r in rows], 50)
    spans = [sum(a and not b for a, b in zip(g, [False, *g])) for g in gone]
    want = Counter((r[0], len(t), sum(g), n, bytes(b for b, d in zip(t, g) if not d)) for r, t, g, n in zip(rows, texts, gone, spans))
    out = suffixes.remove_repeats(df, chunk_bytes=chunk_bytes)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()) == want
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab\x00" if seed % 2 else b"a") for _ in range(rng.randint(1, 70))) for _ in range(40)]
    flat = b"".join(strings)
    size = np.array([len(s) for s in strings])
    first = np.cumsum(size) - size
    left = np.repeat(first + size, size) - np.arange(len(flat))
    symbols = np.frombuffer(flat, dtype=np.uint8)
    order, rank = suffixes.suffix_array(symbols, left)
    tails = [flat[p : p + left[p]] for p in range(len(flat))]
    assert order.tolist() == sorted(range(len(flat)), key=lambda p: (tails[p], p))
    lcp = suffixes.common_prefixes(symbols, left, first, size, order, rank)
    for k in range(1, len(order)):
        a, b = tails[order[k - 1]], tails[order[k]]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# 6


def test_token_counts(spark, tmp_path):
    rng = np.random.default_rng(3)
    (tmp_path / "files").mkdir()
    want = Counter()
    for f in range(4):
        ids = rng.integers(0, 40, [0, 1, 700, 5000][f]).astype("<u2")
        if f == 3:
            ids[1000:3000] = 5  # a document over many blocks
        (tmp_path / "files" / f"{f}.bin").write_bytes(ids.tobytes())
        run = 0
        for x in ids.tolist():
            if x == 0:
                want[f, run] += 1
                run = 0
            else:
                run += 1
        if run:
            want[f, run] += 1
    for block in (1, 64, 10_000) if spark else ():
        blocks = token_counts.read_blocks(spark, str(tmp_path / "files"), 2, block)
        got = token_counts.document_counts(blocks.repartition(3), 0).collect()
        assert Counter((int(r.file[-5]), r.n_tokens) for r in got) == want
        assert all(sorted(r.doc for r in got if r.file[-5] == str(f)) == list(range(sum(n for (g, _), n in want.items() if g == f))) for f in range(4))


def test_token_files_of_documents(spark, docs):
    rows, df = docs
    path = tokenizer.vocabulary_path()
    bpe = tokenizer.WordBpe(tokenizer.load_spec(path))
    files = token_counts.write_flat(df, path, 49407, block_tokens=50, file_docs=7).cache()
    got = token_counts.document_counts(files.select("file", "block", "tokens"), 49407).collect()
    want = []
    for r in rows:
        out: list = []
        bpe.encode_ordinary(r[1] or "", out)
        want.append(sum(map(len, out)) // 4)
    assert sorted(r.n_tokens for r in got) == sorted(want)


# 7


def page(nav, body, tail="", inner=""):
    return f"<html><head><title>x</title><script>var a='<p>';</script></head><body><nav><ul><li>{nav}</ul></nav><div class='ad'>buy</div>{inner}{body}<footer>f {nav}</footer>{tail}</body></html>"


def test_main_text(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"http://a.org/{i}", page(f"n{i}", f"<article><h1>T{i} &amp; co</h1><p><b>first   {i}<br><p>sec<i>o</i>nd&nbsp;{i}</p><div class=notice>cookies</div><p>Follow us now</p><section class='comments'><p>nice</p></section></article>")))
        rows.append((100 + i, f"https://b.org/{i}?x", page("m", f"<div><p>Imprint of b</p><p>text {i} <ul><li>one {i}<li>two {i}</ul></div>", inner="<p>Welcome to b</p>")))
    rows += [(200, "http://c.org/", None), (201, None, "plain &lt;text&gt;"), (202, "odd", ""), (203, "http://c.org/2", "<p>" + "<div>" * 3000 + "deep" + "</div>" * 3000), (0, "http://a.org/0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = defaultdict(set)
    for r in wrapper.main_text(df.repartition(3)).collect():
        got[r.page_id].add((r.text, r.n_chars))
    for i in range(12):
        want = f"T{i} & co\nfirst {i}\nsecond {i}"
        assert got[i] == {(want, len(want))}
        assert got[100 + i] == {(t, len(t)) for t in [f"text {i}\none {i}\ntwo {i}"]}
    assert got[200] == got[202] == {("", 0)} and got[201] == {("plain <text>", 12)} and got[203] == {("deep", 4)}
    assert wrapper.main_text(df.limit(0)).count() == 0


def test_simple_tree_matching():
    a, b = wrapper.Page("<div><p>x<p>y</div><ul><li>1<li>2</ul>"), wrapper.Page("<div><p>x</div><h1>t</h1><ul><li>1<li>2<li>3</ul>")
    pairs = wrapper.align(a, b)
    assert all(a.tag[x] == b.tag[y] for x, y in pairs.items()) and len(pairs) == 1 + 1 + 2 + 1 + 4
    same = wrapper.align(a, a)
    assert same == {i: i for i in range(len(a.tag))}


def test_tree_matching_of_long_lists(monkeypatch):
    text = [f"<p>a {i}" for i in range(150)]
    a = wrapper.Page("<article><table><tr><td>t</table>" + "".join(text) + "<div>end</div></article>")
    b = wrapper.Page("<article>" + "".join(text[:90]) + "<table><tr><td>t</table><h2>h</h2><div>end</div></article>")
    pairs = wrapper.align(a, b)
    assert sum(a.text[x].startswith("a ") for x in pairs) == 90 and pairs[a.text.index("end")] == b.text.index("end")
    rng = random.Random(4)
    x, y = (wrapper.Page("<div>" + "".join(rng.choice(["<p>x</p>", "<ul><li>1</ul>", "<h2>h</h2>"]) for _ in range(n)) + "</div>") for n in (90, 70))
    left, right = ([p.tag[c] for c in p.children[1]] for p in (x, y))
    best = [[0] * 71 for _ in range(91)]
    for i, j in itertools.product(range(90), range(70)):
        pair = best[i][j] + (3 if left[i] == "ul" else 2) if left[i] == right[j] else 0
        best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], pair)
    for cells in (wrapper.CELLS, 50):  # in one table, and by halves
        monkeypatch.setattr(wrapper, "CELLS", cells)
        got = wrapper.align(x, y)
        order = [got[c] for c in x.children[1] if c in got]
        assert len(got) == 2 + best[90][70] and order == sorted(set(order)) and all(x.tag[c] == y.tag[d] for c, d in got.items())


def test_names_that_mark_no_content():
    def text(html):
        p = wrapper.Page(html)
        return [p.text[i] for i in p.blocks()]

    body = "<h2 id='search-algorithms'>Search algorithms</h2><p>long text</p><h2 id=search>S</h2><section id='social-policy'><p>policy</p></section><h2 id='related-work'>Related</h2>"
    want = ["Search algorithms", "long text", "S", "policy", "Related"]
    marked = "<nav>n</nav><div class='site-footer'>f</div><div class='x cookie-banner'>c</div><p id=ad-2>buy</p><div class=comments>no</div>"
    for around in ("content no-sidebar", "has-sidebar", "widget"):
        assert text(f"<body><nav>menu menu menu</nav><div class='{around}'>{body}</div></body>") == want
    assert text(f"<article>{body}{marked}</article>") == want == text(f"<div>{body}{marked}</div>")
    assert text("<div class=comments>only what readers say</div>") == []
    assert text("<div><p>The main text of the page</p></div><article><p>teaser</p></article>") == ["The main text of the page", "teaser"]


# 9


def distance(a, b):
    """Edits with swaps of neighbours (each letter in one edit at most)."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_levenshtein_automaton():
    rng = random.Random(8)
    terms = [("".join(rng.choice("abc") for _ in range(rng.randint(3, 8))), rng.random() < 0.4) for _ in range(12)]
    terms = list({t: (t, s) for t, s in terms}.values())
    lex = toxicity.Lexicon(terms)
    for _ in range(3000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 10)))
        word = min([distance(w, t) for t, s in terms if not s and (len(t) >= 5 or w == t)] + [2])
        stem = min([distance(w[:n], t) for t, s in terms if s for n in range(len(w) + 1) if len(t) >= 6 or w[:n] == t] + [2])
        assert lex.match(w) == (min(word, 2), min(stem, 2)), w


def test_quotation_scores_less():
    s = toxicity.Scorer([("idiot", False)])
    plain, quoted, reported = (s.features(t)[0] for t in ("you are an idiot my friend", "the word “idiot” is old", "he said you idiot"))
    assert plain > reported > 0 and plain > quoted > 0


def test_toxicity_learns(spark):
    rng = random.Random(6)
    clean = ["".join(rng.choice("lmnoprst") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(clean) for _ in range(30)]
        bad = i % 5 == 0
        for _ in range(2 * bad):
            w.insert(rng.randrange(30), rng.choice(["zznasty", "zzvile"]))
        rows.append((i, " ".join(w), "a"))
        labels.append((i, 1, int(bad)))
    rows += [(None, None, None), (900, "", "b"), (901, "a zznasty and zzvile zznasty thing", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, lab)
    out = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    assert all((out[i] >= 0.5) == bool(t) for i, _, t in labels) and out[900] < 0.5 and out[None] < 0.5 and out[901] >= 0.5
    none = toxicity.learn(docs, lab.limit(0))
    assert {r.score for r in toxicity.score_texts(docs, none).collect()} == {0.0}
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


def test_toxic_words_of_any_length(spark):
    rng = random.Random(16)
    clean = ["".join(rng.choice("lmnoprst") for _ in range(5)) for _ in range(300)] + ["der"] * 60 + ["hello"] * 10
    bad, rows, labels = ["zzk", "zzvolksverhetzen", "hell"], [], []
    for i in range(900):
        n = 30 if i % 6 else 200  # frequent words have many neighbours in the long texts
        w = [rng.choice(clean) for _ in range(n)]
        if i % 6 == 0:
            for _ in range(9):
                w.insert(rng.randrange(n), bad[i // 6 % 3])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    rows += [(1000 + k, f"a {w} and {w} here {w}") for k, w in enumerate(bad)] + [(1010, "der hello der hello"), (1011, "volksverhetzen zz hello der")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, lab)
    assert {(w, False) for w in bad} <= set(model["terms"]) and not {"der", "hello"} & {t for t, _ in model["terms"]}
    out = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    assert all(out[1000 + k] >= 0.5 for k in range(len(bad))) and out[1010] < 0.5 and out[1011] < 0.5
    assert all((out[i] >= 0.5) == bool(t) for i, t in labels)


# 10


def test_bpe_equals_library(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer.vocabulary_path()
    lib, own = Tokenizer.from_file(path), tokenizer.WordBpe(tokenizer.load_spec(path))
    rng = random.Random(9)
    texts = [r[1] or "" for r in docs[0]] + ["<|endoftext|>a <|startoftext|>b<|ENDOFTEXT|>", "ΣΑΣ ΟΔΟΣ İstanbul ǅ don't we'll I'M x1234\x85　\x1c á​", "👍🏽 日本語テキスト", "a" * 3000, "<|", "'S 'Ll"]
    texts += ["".join(rng.choice("abcdeinorst'") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x3000, 0xD7FF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(20)) for _ in range(300)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        ids = np.frombuffer(own.encode(t), dtype="<u4")
        assert ids.tolist() == want, t
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)
    out = tokenizer.encode_documents(docs[1], path).collect()
    assert Counter((r.doc_id, r.shard_hint, tuple(r.ids), r.decoded) for r in out) == Counter(
        (r[0], r[5], tuple(lib.encode(r[1] or "", add_special_tokens=False).ids), lib.decode(lib.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in docs[0])
    with pytest.raises(ValueError, match="clash"):
        tokenizer.encode_documents(docs[1].withColumn("ids", F.lit(1)), path)


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe"]
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema.fields] == [f.dataType for f in docs.schema.fields]
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and len(ids) > 100


def test_crc_of_texts(spark, docs):
    got = docs[1].select("text", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("c")).collect()
    assert all(r.c == zlib.crc32((r.text or "").encode()) for r in got)


def thue_morse(n: int) -> tuple[str, str]:
    """Two texts of ``2 ** n`` letters, complements of each other, that polynomial hashes modulo 2 ** 64 cannot tell apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_defeat_polynomial_hashes(spark):
    x, y = thue_morse(10)
    head = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{head} {x}"), (2, f"{head} {y}"), (3, f"{head} {x}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeats.remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 13}
    df = spark.createDataFrame([(1, f"{x} b c d e"), (2, f"{y} b c d e"), (3, f"{x} b c d e")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_items_of_null_id_hit(spark):
    docs_ = spark.createDataFrame([(1, "alpha beta gamma"), (2, "other words")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "alpha beta gamma"), (None, "beta gamma"), (7, "gamma")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs_, items).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (3, 2, sha("7"), True), 2: (0, 0, sha(""), False)}
    only = decontaminate.contamination(docs_, items.where("item_id is null")).collect()
    assert {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in only} == {1: (3, 1, sha("")), 2: (0, 0, sha(""))}


def test_queries_of_one_id_are_told_apart(spark):
    v = spark.createDataFrame([(i, [i, 1]) for i in range(20)], "id long, v array<long>")
    q = spark.createDataFrame([(50, [-1, 256]), (50, [-2, 256]), (50, [-1, 256])], "id long, v array<long>")
    got = Counter((r.query_id, r.rank) for r in bitsliced.top_k(v, q, 5).collect())
    assert got == {(50, r): 2 for r in range(1, 6)}
    big = spark.createDataFrame([(1, [1 << 40, 1]), (2, [-(1 << 40), 1])], "id long, v array<long>")
    scores = {r.vec_id: r.score for r in bitsliced.top_k(big, spark.createDataFrame([(9, [1 << 40, 1])], "id long, v array<long>"), 5).collect()}
    assert scores == {1: (1 << 63) - 1, 2: -(1 << 63)}


# 7, further


@pytest.mark.parametrize("html", ["<div " * 200_000, "<a x='" * 100_000, "<b>" * 20_000 + "</i>" * 20_000, "<b>" * 8000 + "<div></div>" * 8000, "<!-- " * 100_000, "</" * 100_000,
                                  "<title>" * 30_000, "<li>" * 30_000, "<p title='>" * 30_001])
def test_hostile_pages_take_linear_time(html):
    import time

    began = time.process_time()
    wrapper.Page(html)
    wrapper.layout(html)
    assert time.process_time() - began < 5


def test_tags_with_quotes():
    texts = lambda h: [wrapper.Page(h).text[i] for i in wrapper.Page(h).blocks()]
    assert texts("<p title='a > b'>x</p><p class=\"it's\">y</p>") == ["x", "y"]
    assert texts("<p>a</p><script>if (a<b && '\"') {<p>}</script><p title='1>2'>z</p><!-- <p>c -->d") == ["a", "z", "d"]
    assert texts("a < b <3 c <p>d</p> <") == ["a < b <3 c", "d", "<"]
    assert texts("<p>The formula <math><mi>E</mi>=<mi>mc</mi></math> holds</p>") == ["The formula E = mc holds".replace(" = ", "=")]


def slots(pages):
    """A template by brute force: a block is constant if its text stands at the same place (way of tags with their numbers) of most
    pages, and of two at least."""
    seen = defaultdict(set)
    cut = []
    for text in pages:
        p = wrapper.Page(text or "")
        ways = {}
        for i, up in enumerate(p.parent):
            ways[i] = () if up < 0 else (*ways[up], (p.tag[i], sum(p.tag[j] == p.tag[i] for j in p.children[up] if j < i)))
        cut.append([(ways[i], p.text[i]) for i in p.blocks()])
        for b in cut[-1]:
            seen[b].add(tuple(cut[-1]))
    n = len({tuple(c) for c in cut})
    return ["\n".join(t for w, t in c if not (len(seen[w, t]) >= 2 and len(seen[w, t]) >= 0.6 * n)) for c in cut]


def marked_free(k, n, other=False):
    """A page without any mark: constant head, menu and imprint in plain elements around a text of its own."""
    body = "".join(f"<p>story {k} line {j} of {n}</p>" for j in range(3))
    if other:
        return f"<div><div><p>Section of b</p></div><section><h2>news {k}</h2>{body}</section></div><div><p>Imprint of b</p></div>"
    return f"<div><div>Home of a</div><div>Topics today</div></div><div><h1>title {k}</h1>{body}</div><div><div><p>Imprint of a.org</p></div></div>"


@pytest.mark.parametrize("n", [2, 7, 50])
def test_templates_without_marks(spark, n):
    """Hosts of two, seven and fifty pages, two layouts, an empty page that would be the reference: constant nodes alone decide."""
    a = [marked_free(k, n) for k in range(n)]
    b = [marked_free(k, n, True) for k in range(n)]
    rows = [(i, "https://a.org/x", h) for i, h in enumerate(a + b)] + [(1000 + i, "https://a.org/x", None if i % 2 else "") for i in range(12)]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[i] for i in range(2 * n)] == slots(a) + slots(b)
    assert got[0].split("\n")[0] == "title 0" and got[n].split("\n")[0] == "news 0" and "Imprint" not in "".join(got.values())
    assert all(got[1000 + i] == "" for i in range(12))


def test_one_page_tells_no_template(spark):
    df = spark.createDataFrame([(1, "https://a.org/", "<div><p>only</p></div>"), (2, "https://a.org/", "<div><p>only</p></div>"), (3, "https://b.org/", "<p>x</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrapper.main_text(df).collect()} == {1: "only", 2: "only", 3: "x"}
