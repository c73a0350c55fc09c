"""Operator 4, MinHash near-dedup by ProbMinHash.

A text is a weighted set: its shingles of five words, weighted by how often they occur. Each shingle starts a Poisson
process whose rate is its weight; every arrival falls into one of ``REGISTERS`` registers, and a register keeps the shingle
that came first. Arrivals later than the latest register end a shingle's process early. Two texts agree in a register with
probability equal to their probability Jaccard similarity (for plain sets: the Jaccard similarity).

Registers are banded. Texts that share a band are candidates; their exact similarity is computed from the shingles.
Equal texts are one node. In a band's bucket all members are compared with the first one. Where members of more than one
component are left, whoever is outside the bucket's largest component is compared with all members of other components:
members that are linked already need no comparing, and no cross-component pair of a bucket stays unseen. For that a bucket is
cut into blocks of bounded rows and bytes, and a task meets two blocks with an index of their shingles: what they
share is computed per pair in numpy, and only pairs that link two components become rows, about as many as components. Classes are the
components of the links with similarity of ``THRESHOLD`` or more.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, small_batches, stored, table
from .components import components
from .textbytes import MIX1, MIX2, MUL, U64, first_of_groups, grams, mix, word_hashes, word_table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4  # a pair at 0.8 shares no band with probability (1 - 0.8 ** 4) ** 24 = 3e-6
REGISTERS = BANDS * ROWS
#: Pairs with fewer registers (of a byte each) in common are not verified: at 0.8 that has a probability below 1e-10.
LEAST_EQUAL = 50
BATCH_BYTES = 1 << 20
#: Members and bytes of shingles of a block.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
#: Candidate nodes (16 bytes each) are broadcast to fetch their texts up to this many, else the join shuffles.
BROADCAST_NODES = 400_000


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, count), sorted by index and shingle. Words are separated by ASCII white space; a text of fewer
    than SHINGLE words has one shingle of all of them, one without words none."""
    buf, starts, ends, row = word_table(texts)
    h = word_hashes(buf, starts, ends)
    g, k = grams(h, SHINGLE), SHINGLE - 1
    inside = row[:-k] == row[k:] if len(h) > k else np.zeros(0, dtype=bool)
    rows, values = [row[: len(inside)][inside]], [g[inside]]
    n = np.bincount(row, minlength=len(texts))
    first = np.cumsum(n) - n
    for short in range(1, SHINGLE):
        own = np.flatnonzero(n == short)
        if len(own):
            rows.append(own)
            values.append(grams(h, short)[first[own]])
    r, v = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((v, r))
    r, v = r[order], v[order]
    lead = np.flatnonzero(first_of_groups(r, v))
    return r[lead], v[lead], np.diff(np.append(lead, len(r)))


def signatures(n_texts: int, row: np.ndarray, h: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that each register keeps, by text; zeros for a text without shingles."""
    time = np.full(n_texts * registers, np.inf)
    kept = np.zeros(n_texts * registers, dtype=U64)
    t, latest, arrival = np.zeros(len(h)), np.full(n_texts, np.inf), 0
    w = weight.astype(float)
    while len(h):
        arrival += 1
        rnd = mix(h + U64(arrival * int(MUL) & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((rnd >> U64(11)).astype(float) + 0.5) * 2.0**-53) / w
        alive = t < latest[row]
        row, h, w, t, rnd = row[alive], h[alive], w[alive], t[alive], rnd[alive]
        at = row * registers + (mix(rnd ^ MIX1) % U64(registers)).astype(np.int64)
        np.minimum.at(time, at, t)
        won = time[at] == t
        kept[at[won]] = h[won]
        latest = time.reshape(n_texts, registers).max(axis=1)
    return kept.reshape(n_texts, registers)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact similarity of two weighted sets (sorted distinct shingles and their weights)."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = x.astype(float), y.astype(float)
    cx, cy = x[i], y[j]
    only = x.sum() - cx.sum(), y.sum() - cy.sum()
    total = 0.0
    for ratio in np.unique(cy / cx):
        own = cy / cx == ratio
        total += cx[own].sum() / (np.maximum(cx, cy / ratio).sum() + only[0] + only[1] / ratio)
    return total


def _batches(texts: list[bytes]):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= BATCH_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _lower(column: pa.Array) -> list[bytes]:
    return [(x or "").lower().encode() for x in column.to_pylist()]


def sketches(docs: DataFrame, threshold_bands: tuple[int, int] = (BANDS, ROWS)) -> DataFrame:
    """(_node, doc_id, bands, sig) per row: one hash per band and a byte of each register; none for texts without words."""
    n_bands, n_rows = threshold_bands

    def run(batches):
        for b in batches:
            texts = _lower(b.column(2))
            out, sigs = [], []
            for lo, hi in _batches(texts):
                row, h, n = shingles(texts[lo:hi])
                kept = signatures(hi - lo, row, h, n, n_bands * n_rows).reshape(hi - lo, n_bands, n_rows)
                short = mix(kept.reshape(hi - lo, -1)).astype(np.uint8)
                acc = np.arange(1, n_bands + 1, dtype=U64) * MIX2
                acc = np.broadcast_to(acc, kept.shape[:2]).copy()
                for k in range(n_rows):
                    acc = mix(acc * MUL + kept[:, :, k])
                some = np.bincount(row, minlength=hi - lo) > 0
                out += [v.view(np.int64) if s else [] for v, s in zip(acc, some, strict=True)]
                sigs += [v.tobytes() if s else None for v, s in zip(short, some, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, type=pa.list_(pa.int64())), pa.array(sigs, type=pa.binary())],
                                             names=["_node", "doc_id", "bands", "sig"])

    return docs.select("_node", "doc_id", "text").mapInArrow(run, "_node binary, doc_id long, bands array<long>, sig binary")


def shingle_sets(nodes: DataFrame) -> DataFrame:
    """(_node, h, n): the sorted shingles and counts of each text as bytes."""

    def run(batches):
        for b in batches:
            texts = _lower(b.column(1))
            hs, ns = [], []
            for lo, hi in _batches(texts):
                row, h, n = shingles(texts[lo:hi])
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                hs += [h[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                ns += [n[x:y].astype(np.int32).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hs, type=pa.binary()), pa.array(ns, type=pa.binary())], names=["_node", "h", "n"])

    return nodes.select("_node", "text").mapInArrow(run, "_node binary, h binary, n binary")


def likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) with LEAST_EQUAL equal registers or more."""

    def run(batches):
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(k).to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1) for k in (2, 3))
                keep = pa.array((x == y).sum(axis=1) >= LEAST_EQUAL * x.shape[1] // REGISTERS)
                yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], names=["a", "b"])

    left, right = sigs.select(F.col("_node").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("_node").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) with a similarity of ``threshold`` or more."""

    def run(batches):
        for t in batches:
            a, b, ha, na, hb, nb = (t.column(k) for k in range(6))
            keep = []
            for i in range(t.num_rows):
                x, y = np.frombuffer(ha[i].as_py(), dtype=U64), np.frombuffer(hb[i].as_py(), dtype=U64)
                s = probability_jaccard(x, np.frombuffer(na[i].as_py(), dtype=np.int32), y, np.frombuffer(nb[i].as_py(), dtype=np.int32))
                keep.append(s >= threshold - 1e-12)
            keep = pa.array(keep, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    left = sets.select(F.col("_node").alias("a"), F.col("h").alias("ha"), F.col("n").alias("na"))
    right = sets.select(F.col("_node").alias("b"), F.col("h").alias("hb"), F.col("n").alias("nb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ha", "na", "hb", "nb")
    with small_batches(sets.sparkSession):
        return stored(sets.sparkSession, both.mapInArrow(run, "a binary, b binary"), "similar")


def slim_sets(sets: DataFrame) -> DataFrame:
    """(_node, hs, ws): the shingles, and the counts unless all are 1."""

    def run(batches):
        for t in batches:
            hs, ws = [], []
            for h, n in zip(t.column(1), t.column(2), strict=True):
                hs.append(h.as_py())
                n = np.frombuffer(n.as_buffer(), dtype=np.int32)
                ws.append(b"" if (n == 1).all() else n.tobytes())
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(hs, pa.binary()), pa.array(ws, pa.binary())], names=["_node", "hs", "ws"])

    return sets.select("_node", "h", "n").mapInArrow(run, "_node binary, hs binary, ws binary")


def possible_links(nodes: list, comps: list, index: list[bool], probes: list[int], hs: list[bytes], ws: list[bytes], threshold: float) -> set:
    """(a, b, component of a, of b): pairs of a probe and an index row of another component that reach ``threshold``, as many as link all
    components of the block that any such pair links.

    With shares p and q of the weights in common, the probability Jaccard similarity is at most p q / (p + q - p q): each shingle's
    part of it is a concave function of its two shares, homogeneous of degree 1, so their sum is largest if all have one ratio. Where
    all weights are 1 it is just that; else it is computed for the pairs that may reach the threshold.
    """
    own = [k for k, i in enumerate(index) if i]
    sets = [np.frombuffer(h, dtype=U64) for h in hs]
    weights = [np.frombuffer(w, dtype=np.int32) if w else np.ones(len(s), dtype=np.int32) for w, s in zip(ws, sets, strict=True)]
    total = np.array([float(w.sum()) for w in weights])
    h = np.concatenate([sets[k] for k in own])
    order = np.argsort(h, kind="stable")
    h, w = h[order], np.concatenate([weights[k] for k in own])[order]
    row = np.repeat(np.arange(len(own)), [len(sets[k]) for k in own])[order]
    of = total[own]
    kinds = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    comp = np.array([kinds[c] for c in comps])
    up = np.arange(len(kinds))  # components that pairs of this block have linked
    out = set()
    for k in probes:
        lo, hi = np.searchsorted(h, sets[k], "left"), np.searchsorted(h, sets[k], "right")
        n = hi - lo
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        p = np.minimum(1, np.bincount(row[at], np.repeat(weights[k], n), len(own)) / total[k])
        q = np.minimum(1, np.bincount(row[at], w[at], len(own)) / of)
        most = p * q / np.maximum(p + q - p * q, 1e-300)
        found = np.flatnonzero((most >= threshold - 1e-9) & (up[comp[own]] != up[comp[k]]))
        if not len(found):
            continue
        score = most[found]
        for i, j in enumerate(found.tolist()):
            if ws[k] or ws[own[j]]:
                (x, a), (y, b) = ((sets[r], weights[r]) for r in (k, own[j]))
                score[i] = probability_jaccard(x, a, y, b)
        reach = score >= threshold - 1e-12
        for i in np.argsort(-score, kind="stable").tolist():
            r = own[found[i]]
            if not reach[i] or up[comp[r]] == up[comp[k]]:
                continue
            a, b = sorted(((nodes[k], comps[k]), (nodes[r], comps[r])))
            out.add((a[0], b[0], a[1], b[1]))
            up[up == up[comp[r]]] = up[comp[k]]
    return out


def across(at: DataFrame, sets: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b, ca, cb): pairs of members of one bucket and different components that reach ``threshold``, and their components, for all
    members outside the bucket's largest component; no more than link the components of a block. ``at``: (band, _node, comp) of the buckets with more than one component."""
    spark = at.sparkSession
    at = at.join(slim_sets(sets), "_node")
    at = stored(spark, at, "open-sets")
    size = F.length("hs") + F.length("ws") + 64
    sizes = at.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("_rows"), F.sum("s").alias("_bytes"))

    def blocks(rows, size_):
        return F.greatest(F.ceil(rows / F.lit(block_rows)), F.ceil(size_ / F.lit(block_bytes)), F.lit(1)).cast("int")

    out_rows, out_bytes = F.col("_rows") - F.col("m.n"), F.col("_bytes") * (F.col("_rows") - F.col("m.n")) / F.col("_rows")
    plan = largest.select("band", F.col("m.comp").alias("_main"), blocks(F.col("_rows"), F.col("_bytes")).alias("_nb"), blocks(out_rows, out_bytes).alias("_ob"))
    x = at.join(plan, "band").withColumn("out", F.col("comp") != F.col("_main"))
    one = (F.col("_nb") == 1) & (F.col("_ob") == 1)
    place = F.xxhash64("_node")
    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    cols = ["band", "_node", "comp", "hs", "ws"]
    index = x.select(*cols, F.pmod(place, F.col("_nb")).cast("int").alias("i"), every("_ob").alias("o"), F.lit(True).alias("index"), (one & F.col("out")).alias("probe"))
    probe = x.where(~one & F.col("out")).select(*cols, every("_nb").alias("i"), F.pmod(place, F.col("_ob")).cast("int").alias("o"), F.lit(False).alias("index"), F.lit(True).alias("probe"))

    def run(batches):
        key, held = None, []

        def done():
            if not held:
                return None
            nodes, comps, hs, ws, index_, probe_ = zip(*held, strict=True)
            if not any(index_):
                return None
            pairs = possible_links(nodes, comps, index_, [k for k, p in enumerate(probe_) if p], hs, ws, threshold)
            if not pairs:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs, strict=True)], names=["a", "b", "ca", "cb"])

        for t in batches:
            for r in zip(*[t.column(c).to_pylist() for c in range(9)], strict=True):
                if r[:3] != key:
                    if (found := done()) is not None:
                        yield found
                    key, held = r[:3], []
                held.append(r[3:])
        if (found := done()) is not None:
            yield found

    rows = index.unionByName(probe).select("band", "i", "o", "_node", "comp", "hs", "ws", "index", "probe")
    with small_batches(spark):
        return stored(spark, rows.repartition("band", "i", "o").sortWithinPartitions("band", "i", "o").mapInArrow(run, "a binary, b binary, ca binary, cb binary"), "possible")


def classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, _node, class_id) per row of ``df``: class_id is the smallest id of the row's class.

    Equal texts are one class; texts without words (null, empty, white space) have no similarity, so each such row is its
    own class. A null id is later than all others; a class of null ids only has a null class_id. Repeated rows
    repeat in the result. An empty table gives an empty result.
    """
    spark = prepare(df)
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(body.cast("binary"))).alias("_node"), body.alias("text"))
    with small_batches(spark):
        rows = stored(spark, sketches(docs), "sketches")
    # one node per distinct text, found again by (text hash, smallest id): a text that most rows share is no hot key
    nodes = rows.where(F.size("bands") > 0).groupBy("_node").agg(F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("_id"))
    nodes = rows.withColumn("_id", F.coalesce("doc_id", F.lit((1 << 63) - 1))).join(nodes, ["_node", "_id"]).dropDuplicates(["_node", "_id"])
    banded = nodes.select("_node", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("_n"), F.min("_node").alias("_first")).where("_n > 1")
    buckets = stored(spark, banded.join(sizes, "band").select("band", "_node", "_first"), "buckets")
    members = stored(spark, buckets.select("_node").distinct(), "members")
    few = members.count() <= BROADCAST_NODES
    with small_batches(spark):
        sets = stored(spark, shingle_sets(_one_per_node(docs, nodes, members, few)), "shingles")

    sigs = nodes.join(members, "_node", "left_semi").select("_node", "sig")
    pairs = buckets.where("_first != _node").select(F.col("_first").alias("a"), F.col("_node").alias("b")).distinct()
    links = verified(stored(spark, likely(pairs, sigs), "likely"), sets, threshold)
    comp = components(links)
    at = buckets.join(comp, buckets["_node"] == comp["node"], "left").select("band", "_node", F.coalesce("comp", "_node").alias("comp"))
    open_ = at.groupBy("band").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo != _hi").select("band")
    met = across(at.join(open_, "band"), sets, threshold)
    # links between components: many buckets find the same ones, by other pairs
    upper = components(met.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    # class of a node, then of a row; the smallest id of a class is an aggregation over nodes
    byid = nodes.select("_node", "_id").join(comp, nodes["_node"] == comp["node"], "left").select("_node", "_id", F.coalesce("comp", "_node").alias("_c"))
    byid = byid.join(upper, byid["_c"] == upper["node"], "left").select("_node", "_id", F.coalesce("comp", "_c").alias("comp"))
    byid = stored(spark, byid, "node-classes")
    least = byid.groupBy("comp").agg(F.min("_id").alias("class_id"))
    own = byid.join(least, "comp").select("_node", F.nullif("class_id", F.lit((1 << 63) - 1)).alias("class_id"))
    out = rows.select("doc_id", "_node", F.size("bands").alias("_w")).join(own, "_node", "left")
    return out.select("doc_id", "_node", F.when(F.col("_w") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def _one_per_node(docs: DataFrame, nodes: DataFrame, members: DataFrame, few: bool) -> DataFrame:
    """One text per member node: the row of the node's smallest id."""
    ids = nodes.select("_node", "_id").join(members, "_node", "left_semi")
    keyed = docs.withColumn("_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    return keyed.join(F.broadcast(ids) if few else ids, ["_node", "_id"], "left_semi").dropDuplicates(["_node", "_id"])


def deduplicate(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with one row of each class: that of the smallest id (and of rows equal in id and text, one)."""
    got = classes(df, id_col, text, threshold).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    keep = got.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_id"), "_node").distinct()
    own = df.withColumns({"_id": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)),
                          "_node": F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))})
    return own.join(keep, ["_id", "_node"], "left_semi").dropDuplicates(["_id", "_node"]).select(*df.columns)


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every whole document with its class and whether it stays."""
    out = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("keep"))
