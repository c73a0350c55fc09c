"""Operator 12, ranked lexical search by MaxScore with pair bounds.

The index is cut by documents: a block of bounded text holds inverted lists of all its terms (document numbers and counts,
in order). Three passes over the blocks answer a group of items; a pass sends nothing but one row per task and term, pair or
hit.
1. Document frequencies and the greatest impact of every term of the group.
2. An item's terms stand in ascending order of greatest impact, and neighbours in this order are pairs. For every pair the
   lists are intersected: how many documents hold both, the greatest joint impact and the best ``k`` joint impacts.
3. MaxScore per block. The bound of a prefix of terms adds, per pair, the larger of the joint maximum and the two single
   ones, which is never more than the sum of two term maxima and mostly much less: a document seldom has both. Documents
   with no term behind the longest prefix whose bound is below the threshold are never looked at; the others drop out as
   soon as their sum and the bound of what is left fall below it. The threshold is the best ``k``-th joint impact of the
   item's pairs at first and then what the task's own hits give. Everything left out scores less than ``k`` others.

Integer arithmetic decides throughout, bounds are compared strictly, so ties are kept.
"""
from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import prepare, slices, small_batches, stored, table

BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 4096
#: Distinct (item, term) rows of a group of items, about; more items make more groups.
GROUP_TERMS = 200_000
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of terms, A-Z lowered; all others are a space.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
PIECE = 1 << 22
LAST = (1 << 63) - 1
BLOCKS = "doc_ids array<long>, lengths array<long>, terms array<binary>, starts array<int>, docs array<int>, counts array<int>"


def term_counts(text: str) -> Counter:
    """Terms of a whole text with their counts, long texts in pieces that end where a term does."""
    data = text.encode().translate(BYTES)
    out: Counter = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


def _block(ids: list, lengths: list, codes: list, counts: list, sizes: list, names: dict):
    code = np.array(codes, dtype=np.int64)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    order = np.argsort(code, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(names)))]).astype(np.int32)
    one = lambda x, t: pa.array([x], type=pa.list_(t))
    return pa.RecordBatch.from_arrays(
        [one(ids, pa.int64()), one(lengths, pa.int64()), one(list(names), pa.binary()), one(starts, pa.int32()), one(doc[order], pa.int32()),
         one(np.array(counts, dtype=np.int32)[order], pa.int32())], names=["doc_ids", "lengths", "terms", "starts", "docs", "counts"])


def _index(block_bytes: int, block_docs: int):
    def run(batches):
        ids, lengths, codes, counts, sizes, names, held = [], [], [], [], [], {}, 0
        for whole in batches:
            for b in slices(whole, 1):
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    c = term_counts(text)
                    if not c:
                        continue
                    codes += [names.setdefault(w, len(names)) for w in c]
                    counts += c.values()
                    ids.append(i)
                    sizes.append(len(c))
                    lengths.append(sum(c.values()))
                    held += len(text)
                    if held >= block_bytes or len(ids) >= block_docs:
                        yield _block(ids, lengths, codes, counts, sizes, names)
                        ids, lengths, codes, counts, sizes, names, held = [], [], [], [], [], {}, 0
        if ids:
            yield _block(ids, lengths, codes, counts, sizes, names)

    return run


class Index:
    """Blocks of inverted lists in a folder, with the number of documents and of terms in all."""

    def __init__(self, blocks: DataFrame, n_docs: int, n_terms: int) -> None:
        self.blocks, self.n_docs, self.n_terms = blocks, n_docs, n_terms


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> Index:
    """Index of (doc_id, text); other columns are ignored. Every row is a document of its own, those of one id as well.

    Null and empty texts and texts without a term are not documents. A null id is kept. No two tasks share a block, and
    a block is about ``block_bytes`` of text (more only for a single text).
    """
    spark = prepare(docs)
    path = scratch_path(spark, "lists")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    # a row group a block: a reader decodes a whole group, and the writer looks at a group's size after a hundred rows only
    with small_batches(spark):
        rows.mapInArrow(_index(block_bytes, block_docs), BLOCKS).write.option("parquet.block.row.count.limit", 1).parquet(path)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    n = blocks.agg(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    return Index(blocks, n[0] or 0, n[1] or 0)


class Lists:
    """Inverted lists of a group's terms in one block; impacts are made when a list is first needed."""

    def __init__(self, row: pa.RecordBatch, vocabulary: pa.Array, n_docs: int, n_terms: int, weight=None) -> None:
        def flat(name):
            return row.column(row.schema.get_field_index(name)).flatten()

        lengths = flat("lengths").to_numpy()
        self.damp = 8 * (10 + (90 * lengths * n_docs) // n_terms)
        ids = flat("doc_ids")
        self.ids = pc.fill_null(ids, LAST).to_numpy()
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.starts, self.docs, self.counts = flat("starts").to_numpy(), flat("docs").to_numpy(), flat("counts").to_numpy()
        at = pc.index_in(vocabulary, value_set=flat("terms"))
        self.place = {t: c for t, c in enumerate(at.to_pylist()) if c is not None}
        self.weight = weight
        self.known: dict[int, tuple] = {}
        self.touched = 0  # list entries whose impact was computed

    def __len__(self) -> int:
        return len(self.damp)

    def size(self, t: int) -> int:
        c = self.place[t]
        return int(self.starts[c + 1] - self.starts[c])

    def factors(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        c = self.place[t]
        a, b = self.starts[c], self.starts[c + 1]
        docs, tf = self.docs[a:b], self.counts[a:b].astype(np.int64)
        self.touched += int(b - a)
        return docs, (1_000_000_000 * tf) // (1000 * tf + self.damp[docs])

    def impacts(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        if t not in self.known:
            docs, f = self.factors(t)
            self.known[t] = docs, self.weight[t] * f
        return self.known[t]

    def lookup(self, t: int, wanted: np.ndarray) -> np.ndarray:
        """Impacts of a term in some documents of the block (ascending), 0 where it is not."""
        docs, impact = self.impacts(t)
        at = np.searchsorted(docs, wanted)
        at[at == len(docs)] = 0
        return np.where(docs[at] == wanted, impact[at], 0)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _rows(batches):
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1)


def _term_pass(shipped):
    def run(batches):
        g = shipped.value
        df, top = Counter(), defaultdict(int)
        vocabulary = pa.array(g["terms"], type=pa.binary())
        for row in _rows(batches):
            lists = Lists(row, vocabulary, g["n_docs"], g["n_terms"])
            for t in lists.place:
                _, f = lists.factors(t)
                df[t] += len(f)
                top[t] = max(top[t], int(f.max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int32()), pa.array(list(df.values()), pa.int64()), pa.array([top[t] for t in df], pa.int64())], names=["t", "df", "top"])

    return run


def joint(lists: Lists, a: int, b: int) -> np.ndarray:
    """Joint impacts of two terms in the documents that hold both."""
    (da, ia), (db, ib) = lists.impacts(a), lists.impacts(b)
    if len(da) > len(db):
        (da, ia), (db, ib) = (db, ib), (da, ia)
    at = np.searchsorted(db, da)
    at[at == len(db)] = 0
    both = db[at] == da
    return ia[both] + ib[at[both]]


def _pair_pass(shipped):
    def run(batches):
        g = shipped.value
        k, pairs, weights = g["k"], g["pairs"], g["weights"]
        n, best = Counter(), {}
        vocabulary = pa.array(g["terms"], type=pa.binary())
        for row in _rows(batches):
            lists = Lists(row, vocabulary, g["n_docs"], g["n_terms"], weights)
            for p, (a, b) in enumerate(pairs):
                if a in lists.place and b in lists.place:
                    j = joint(lists, a, b)
                    if len(j):
                        n[p] += len(j)
                        j = j if len(j) <= k else np.partition(j, len(j) - k)[-k:]
                        best[p] = np.sort(np.concatenate([best.get(p, j[:0]), j]))[::-1][:k]
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([best[p] for p in n], pa.list_(pa.int64()))], names=["p", "both", "best"])

    return run


class Item:
    """Terms of an item in ascending order of greatest impact, two and two a pair; its first threshold."""

    def __init__(self, terms: list[int], threshold: int) -> None:
        self.terms, self.threshold = terms, threshold


def prefix_bounds(terms: list[int], place, top, pair_top) -> tuple[list[int], list[int]]:
    """The terms that a block has, and the bound of every prefix of them."""
    here, bounds, total = [], [0], 0
    for k in range(0, len(terms), 2):
        two = [t for t in terms[k : k + 2] if t in place]
        if two:
            here.append(two[0])
            bounds.append(total + int(top[two[0]]))
        if len(two) == 2:
            here.append(two[1])
            bounds.append(total + pair_top[two[0], two[1]])
        total = bounds[-1]
    return here, bounds


def score_block(lists: Lists, item: Item, threshold: int, top, pair_top) -> tuple[np.ndarray, np.ndarray]:
    """(document numbers, scores): all documents of a block that score ``threshold`` at least, and more than 0."""
    terms, bounds = prefix_bounds(item.terms, lists.place, top, pair_top)
    first = 0
    while first < len(terms) and bounds[first + 1] < threshold:
        first += 1
    none = np.empty(0, np.int64)
    if first == len(terms):
        return none, none
    sums = np.zeros(len(lists), np.int64)
    for t in terms[first:]:
        docs, impact = lists.impacts(t)
        sums[docs] += impact
    found = np.flatnonzero(sums)
    score = sums[found]
    for j in range(first - 1, -1, -1):
        stay = score + bounds[j + 1] >= threshold
        found, score = found[stay], score[stay]
        if not len(found):
            return found, score
        score = score + lists.lookup(terms[j], found)
    stay = (score >= threshold) & (score > 0)
    return found[stay], score[stay]


def _score_pass(shipped):
    def run(batches):
        g = shipped.value
        k, items = g["k"], [Item(*x) for x in g["items"]]
        hits: dict[int, tuple] = {}
        vocabulary = pa.array(g["terms"], type=pa.binary())
        for row in _rows(batches):
            lists = Lists(row, vocabulary, g["n_docs"], g["n_terms"], g["weights"])
            for q, item in enumerate(items):
                have = hits.get(q)
                threshold = max(item.threshold, int(have[0][-1]) if have and len(have[0]) == k else 0)
                docs, score = score_block(lists, item, threshold, g["top"], g["pair_top"])
                if len(docs):
                    score, ids, null = (np.concatenate([x, y]) for x, y in zip(have or (score[:0], lists.ids[:0], lists.null[:0]), (score, lists.ids[docs], lists.null[docs]), strict=True))
                    order = np.lexsort((null, ids, -score))[:k]
                    hits[q] = score[order], ids[order], null[order]
        for q, (score, ids, null) in hits.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q), pa.int32()), pa.array(ids, pa.int64(), mask=null), pa.array(score, pa.int64())], names=["q", "doc_id", "score"])

    return run


def pair_lists(index: Index, terms: list[bytes], pairs: list[tuple], weights: np.ndarray, k: int) -> DataFrame:
    """(p, both, best): per pair of term numbers the documents that hold both and their ``k`` best joint impacts, by task."""
    spark = index.blocks.sparkSession
    shipped = spark.sparkContext.broadcast({"terms": terms, "pairs": pairs, "weights": weights, "n_docs": index.n_docs, "n_terms": index.n_terms, "k": k})
    return index.blocks.mapInArrow(_pair_pass(shipped), "p int, both long, best array<long>")


def _answer(index: Index, items: dict, k: int) -> DataFrame:
    """Hits of one group of items: {item_id: terms}. All passes are run here, so that a task never has more than a few blocks on
    their way."""
    spark = index.blocks.sparkSession
    with small_batches(spark):
        return _passes(spark, index, items, k)


def _passes(spark, index: Index, items: dict, k: int) -> DataFrame:
    send = spark.sparkContext.broadcast
    terms = sorted({t for ts in items.values() for t in ts})
    base = {"terms": terms, "n_docs": index.n_docs, "n_terms": index.n_terms, "k": k}
    seen = index.blocks.mapInArrow(_term_pass(send(base)), "t int, df long, top long").groupBy("t").agg(F.sum("df"), F.max("top")).collect()
    weights, top = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for t, df, factor in seen:
        weights[t] = weight(df, index.n_docs)
        top[t] = weights[t] * factor
    number = {t: n for n, t in enumerate(terms)}
    order = {i: sorted((number[t] for t in ts if top[number[t]] > 0), key=lambda t: (top[t], t)) for i, ts in items.items()}
    pairs = sorted({(ts[n], ts[n + 1]) for ts in order.values() for n in range(0, len(ts) - 1, 2)})
    best: dict[int, list] = defaultdict(list)
    if pairs:
        w = Window.partitionBy("p").orderBy(F.desc("v"))
        values = pair_lists(index, terms, pairs, weights, k).select("p", F.explode("best").alias("v")).withColumn("_r", F.row_number().over(w)).where(f"_r = 1 or _r = {k}")
        for p, v, _ in values.orderBy("p", "_r").collect():
            best[p].append((v, _))
    pair_top, kth = {}, {}
    for p, (a, b) in enumerate(pairs):
        found = dict((r, v) for v, r in best.get(p, []))
        pair_top[a, b] = max(found.get(1, 0), int(top[a]), int(top[b]))
        kth[a, b] = found.get(k, 0)
    asked = [(ts, max([kth[ts[n], ts[n + 1]] for n in range(0, len(ts) - 1, 2)], default=0)) for ts in order.values()]
    hits = index.blocks.mapInArrow(_score_pass(send({**base, "items": asked, "weights": weights, "top": top, "pair_top": pair_top})), "q int, doc_id long, score long")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    hits = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(n, i) for n, i in enumerate(order)], "q int, item_id long")
    return stored(spark, hits.join(ids, "q").select("item_id", "rank", "doc_id", "score"), "ranked")


def search(index: Index, items: DataFrame, k: int = 10, group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0; ties by doc_id, null last.

    Rows of one item_id are one item with the terms of all; a null item_id is an item too. Items without a term that a
    document holds give no row; so does an empty index. Items are answered in groups of about ``group_terms`` terms, dealt
    by a hash; terms, pairs and bounds of a group are what is broadcast.
    """
    spark = prepare(items)
    schema = "item_id long, rank int, doc_id long, score long"
    lowered = F.translate(F.col("text").cast("string"), LETTERS, LETTERS.lower())
    rows = items.select(F.col("item_id").cast("long"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    total = rows.count()
    if not total or not index.n_docs:
        return spark.createDataFrame([], schema)
    groups = -(-total // group_terms)
    rows = rows.withColumn("_g", F.pmod(F.xxhash64("item_id"), F.lit(groups)))
    out = None
    for g in range(groups):
        asked = defaultdict(set)
        for i, t in rows.where(F.col("_g") == g).select("item_id", "term").collect():
            asked[i].add(t.encode())
        if asked:
            got = _answer(index, {i: asked[i] for i in sorted(asked, key=lambda i: LAST if i is None else i)}, k)
            out = got if out is None else out.unionByName(got)
    return out


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    index = build_index(table(spark, sf_dir, "documents"))
    return search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP12_SQL = rf"""
with d as (
  select row_number() over () as row_, doc_id, regexp_extract_all(translate(text, '{LETTERS}', '{LETTERS.lower()}'), '{TERM}') as ws from documents
), c as (
  select row_, doc_id, ws, len(ws)::bigint as n, count(*) over ()::bigint as docs, sum(len(ws)) over ()::bigint as total from d where len(ws) > 0
), q as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, '{LETTERS}', '{LETTERS.lower()}'), '{TERM}')) as term from benchmark
), p as (
  select row_, doc_id, n, docs, total, term, count(*)::bigint as tf from (select row_, doc_id, n, docs, total, unnest(ws) as term from c)
  where term in (select term from q) group by all
), f as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p group by term, docs
), s as (
  select item_id, row_, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::bigint as score
  from q join p using (term) join f using (term) group by item_id, row_, doc_id
), r as (
  select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from s where score > 0
)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10
"""
