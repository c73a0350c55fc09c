"""Operator 8, exact substring dedup of bytes with suffix arrays per shard.

A string of ``span`` bytes (a window) goes if it also starts in a document with a smaller id. Comparing all windows of all
texts would move every byte many times, so windows are first dealt to shards by their content: of the short grams in a
window the one with the smallest hash is its anchor, and equal windows have equal anchors.

1. Each chunk of documents sends the hashes of its distinct anchors to the shards that own them; a shard merges the sorted
   lists and answers which anchors are in several documents (binary search in the merged list). All others are done.
2. For those a chunk sends the bytes around each anchor (its windows, as one string per distinct context). Where all contexts
   of an anchor are equal bytes, their smallest document is the answer to all of its windows. A shard sorts all suffixes of
   its other contexts with Larsson-Sadakane refinement (ranks of 7 symbols, then doubling of the groups that are not
   yet single), takes the common prefixes of neighbours with Kasai's scan, and cuts the order where they fall below
   ``span``: each part is one window, whose smallest document is the answer.
3. The chunk finds its contexts in the answers by binary search and removes the bytes.

The decision is on bytes; hashes only choose what is compared. Contexts travel once per chunk with their smallest and largest
document, so a passage that most documents share is one context per chunk. Texts are shuffled once.
"""
from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, table
from .repeats import NO_ID, chunks, own_columns, rows_of
from .textbytes import BYTE, MUL, U64, first_of_groups, minimizers, mix

SPAN = 50
GRAM = 20
#: What a chunk sends of its contexts: bytes, their sizes, the smallest documents, which have others and the largest of those, and half of
#: the anchors' hashes (anchors that fall together are compared like one).
SENT = ("bytes", "sizes", "lo", "hi", "anchor")
ANSWER = "_chunk int, shard int, kind byte, a binary, b binary, c binary"


def byte_grams(buf: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of k bytes, by doubling."""
    power = {1: MUL}
    h, size = BYTE[buf], 1
    levels = {1: h}
    while size * 2 <= k:
        p = power[size]
        h = h[:-size] * p + h[size:]
        power[size * 2], size = p * p, size * 2
        levels[size] = h
    n = len(buf) - k + 1
    out, done = levels[size][:n], size
    while done < k:
        size = max(s for s in levels if s <= k - done)
        out = out * power[size] + levels[size][done : done + n]
        done += size
    return mix(out)


class Windows:
    """Windows of the texts of one chunk, in runs (contexts) that share an anchor."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], span: int, gram: int) -> None:
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.raw = b"".join(texts)
        self.anchor, self.doc = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        self.at = self.until = np.zeros(0, dtype=np.int64)
        n = len(self.raw) - span + 1
        if n <= 0:
            return
        with np.errstate(over="ignore"):
            g = byte_grams(np.frombuffer(self.raw, dtype=np.uint8), gram)
            place = minimizers(g, span - gram + 1)
        row = np.repeat(np.arange(len(texts)), self.size)
        inside = row[:n] == row[span - 1 :]
        lead = np.empty(n, dtype=bool)
        lead[0] = True
        lead[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
        self.at = np.flatnonzero(lead & inside)  # first window of each run
        ends = np.flatnonzero(inside & np.append(lead[1:] | ~inside[1:], True))
        self.until = ends + span  # end of its last window
        self.anchor = g[place[self.at]]
        self.doc = ids[row[self.at]]

    def contexts(self, wanted: np.ndarray):
        """For runs with an anchor in the sorted ``wanted``: the runs, the distinct contexts (equal bytes have equal anchors) and
        their anchors in order, which of them each run is, and their smallest and largest document."""
        hit = np.minimum(np.searchsorted(wanted, self.anchor), max(0, len(wanted) - 1))
        runs = np.flatnonzero(wanted[hit] == self.anchor) if len(wanted) else np.zeros(0, dtype=np.int64)
        raw, seen = self.raw, {}
        strings = [raw[a:b] for a, b in zip(self.at[runs].tolist(), self.until[runs].tolist(), strict=True)]
        which = np.array([seen.setdefault(x, len(seen)) for x in strings], dtype=np.int64)
        doc = self.doc[runs]
        lo, hi = np.full(len(seen), NO_ID, dtype=np.int64), np.full(len(seen), -(1 << 63), dtype=np.int64)
        np.minimum.at(lo, which, doc)
        np.maximum.at(hi, which, doc)
        anchor = np.zeros(len(seen), dtype=U64)
        anchor[which] = self.anchor[runs]
        return runs, list(seen), anchor, which, lo, hi


def suffix_array(symbols: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and rank of all suffixes of many strings laid end to end; ``left`` is the number of symbols from each place to its
    string's end, where a suffix stops. Equal suffixes come in the order of their places."""
    n = len(symbols)
    key = np.zeros(n, dtype=U64)
    for j in range(7):  # 9 bits a symbol: 0 stands for the end
        own = np.zeros(n, dtype=U64)
        own[: n - j] = symbols[j:].astype(U64) + U64(1)
        own[left <= j] = 0
        key = (key << U64(9)) | own
    order = np.argsort(key, kind="stable")
    lead = first_of_groups(key[order])
    group = np.empty(n, dtype=np.int64)  # place of a suffix's group in the order, from 1
    start = np.flatnonzero(lead)
    sizes = np.diff(np.append(start, n))
    group[order] = np.repeat(start + 1, sizes)
    open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places of the order in groups of several
    longest, h = int(left.max()) if n else 0, 7
    while h < longest and len(open_):
        at = order[open_]
        more = left[at] > h
        second = np.zeros(len(at), dtype=np.int64)
        second[more] = group[at[more] + h]
        pair = (group[at] << np.int64(32)) | second
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[open_] = at
        lead = first_of_groups(pair)
        start = np.flatnonzero(lead)
        sizes = np.diff(np.append(start, len(at)))
        group[at] = np.repeat(open_[start] + 1, sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        h *= 2
    # equal suffixes: by place
    if len(open_):
        at = order[open_]
        order[open_] = at[np.lexsort((at, group[at]))]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    return order, rank


def common_prefixes(symbols: np.ndarray, left: np.ndarray, first: np.ndarray, size: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Kasai's scan: for each place of the order, the symbols that its suffix shares with the one before. The scan goes through all
    strings at once, one symbol further in each step; what was shared at a suffix is, less one, shared at the next."""
    lcp = np.zeros(len(order), dtype=np.int64)
    by = np.argsort(-size, kind="stable")
    first, size = first[by], size[by]
    shared = np.zeros(len(first), dtype=np.int64)
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))  # strings longer than j
        here = first[:n] + j
        r = rank[here]
        before = order[np.maximum(r - 1, 0)]
        h = np.maximum(shared[:n] - 1, 0)
        most = np.where(r > 0, np.minimum(left[here], left[before]), 0)
        h = np.minimum(h, most)
        go = np.flatnonzero(h < most)
        while len(go):
            go = go[symbols[here[go] + h[go]] == symbols[before[go] + h[go]]]
            h[go] += 1
            go = go[h[go] < most[go]]
        lcp[r] = h
        shared[:n] = h
    return lcp


def window_firsts(strings: list[bytes], docs: np.ndarray, span: int) -> np.ndarray:
    """For each place of the strings laid end to end: the smallest document of the window that starts there."""
    symbols = np.frombuffer(b"".join(strings), dtype=np.uint8)
    size = np.array([len(s) for s in strings], dtype=np.int64)
    first = np.cumsum(size) - size
    left = np.repeat(first + size, size) - np.arange(len(symbols))
    order, rank = suffix_array(symbols, left)
    lcp = common_prefixes(symbols, left, first, size, order, rank)
    out = np.full(len(symbols), NO_ID, dtype=np.int64)
    part = np.flatnonzero(lcp < span)
    least = np.minimum.reduceat(np.repeat(docs, size)[order], part)
    out[order] = np.repeat(least, np.diff(np.append(part, len(order))))
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, chunk_bytes: int = 2 << 20) -> DataFrame:
    """All rows and columns of ``df`` with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (binary).

    Rows of one id are one document's texts, not earlier than each other; a null id is later than all others. Null,
    empty and short texts lose nothing. Columns of ``df`` named like the four are replaced.
    """
    prepare(df)
    made = {"n_bytes", "n_removed", "n_spans", "kept"}
    keep = [c for c in df.columns if c.lower() not in made]
    docs, n_chunks = chunks(df.select(*keep), id_col, text, chunk_bytes)
    shards = max(1, n_chunks // 2)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // 8))

    def shard_of(h: np.ndarray) -> np.ndarray:
        return ((h >> U64(32)) % U64(shards)).astype(np.int32)

    def packed(chunk: int, shard: np.ndarray, make) -> dict:
        """Columns with a row for each shard that has any of the (sorted by shard) entries."""
        cut = np.flatnonzero(first_of_groups(shard))
        rows = [(chunk, int(shard[a]), *make(a, b)) for a, b in zip(cut, np.append(cut[1:], len(shard)), strict=True)]
        return list(zip(*rows, strict=True)) or [[]] * 8

    def send_anchors(t: pa.Table) -> pa.Table:
        chunk = t.column("_chunk")[0].as_py()
        _, ids, texts = rows_of(t)
        w = Windows(ids, texts, span, gram)
        order = np.lexsort((w.doc, w.anchor))
        h, d = w.anchor[order], w.doc[order]
        lead = np.flatnonzero(first_of_groups(h))
        last = np.append(lead[1:], len(h)) - 1 if len(lead) else lead
        h, several, d = h[lead], d[lead] != d[last], d[lead]
        shard = shard_of(h)
        by = np.argsort(shard, kind="stable")
        h, several, shard = h[by], several[by], shard[by]
        c = packed(chunk, shard, lambda a, b: (h[a:b].tobytes(), np.packbits(several[a:b]).tobytes()))
        return pa.table({"_chunk": pa.array(c[0], pa.int32()), "shard": pa.array(c[1], pa.int32()), "h": pa.array(c[2], pa.binary()), "several": pa.array(c[3], pa.binary())})

    def merge_anchors(t: pa.Table) -> pa.Table:
        """A chunk holds whole documents, so an anchor is in several if it is in several chunks, or in several of one chunk."""
        lists = [np.frombuffer(x.as_py(), dtype=U64) for x in t.column("h")]
        flags = [np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8))[: len(h)].astype(bool) for x, h in zip(t.column("several"), lists, strict=True)]
        every = np.sort(np.concatenate(lists), kind="stable")
        twice = every[1:][every[1:] == every[:-1]]
        repeated = np.unique(np.concatenate([twice, *[h[f] for h, f in zip(lists, flags, strict=True)]]))
        out = []
        for chunk, h in zip(t.column("_chunk").to_pylist(), lists, strict=True):
            at = np.minimum(np.searchsorted(repeated, h), max(0, len(repeated) - 1))
            if len(repeated) and len(own := h[repeated[at] == h]):
                out.append((chunk, own.tobytes()))
        shard = t.column("shard")[0].as_py()
        return answer([(c, shard, 0, b, b"", b"") for c, b in out])

    def answer(rows: list[tuple]) -> pa.Table:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = (pa.int32(), pa.int32(), pa.int8(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("_chunk", "shard", "kind", "a", "b", "c"), cols, types, strict=True)})

    def wanted_of(answers: pa.Table) -> np.ndarray:
        own = [np.frombuffer(x, dtype=U64) for x, k in zip(answers.column("a").to_pylist(), answers.column("kind").to_pylist(), strict=True) if k == 0]
        return np.sort(np.concatenate(own)) if own else np.zeros(0, dtype=U64)

    def by_shard(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts in the order of their shards, and the shards."""
        shard = shard_of(anchor)
        order = np.argsort(shard, kind="stable")
        return order, shard[order]

    def send_contexts(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"_chunk": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in SENT}})
        chunk = t.column("_chunk")[0].as_py()
        _, ids, texts = rows_of(t)
        _, keys, anchor, _, lo, hi = Windows(ids, texts, span, gram).contexts(wanted_of(answers))
        order, shard = by_shard(anchor)

        def make(a, b):
            own = order[a:b]
            strings = [keys[k] for k in own]
            more = hi[own] != lo[own]  # mostly a context is in one document of the chunk
            return (b"".join(strings), np.array([len(s) for s in strings], dtype=np.uint16).tobytes(), lo[own].tobytes(),
                    np.packbits(more).tobytes() + hi[own][more].tobytes(), anchor[own].astype(np.uint32).tobytes())

        c = packed(chunk, shard, make)
        return pa.table({"_chunk": pa.array(c[0], pa.int32()), "shard": pa.array(c[1], pa.int32()), **{n: pa.array(c[k], pa.binary()) for k, n in enumerate(SENT, 2)}})

    def merge_contexts(t: pa.Table) -> pa.Table:
        """Runs of windows of each context with an earlier document: (number of the context in the chunk's list, first window,
        windows) and that document."""
        seen: dict[bytes, int] = {}
        sent, lows, anchors = [], [], []
        for chunk, raw, sizes, lo, hi, anchor in zip(*[t.column(c).to_pylist() for c in ("_chunk", *SENT)], strict=True):
            ends = np.cumsum(np.frombuffer(sizes, dtype=np.uint16).astype(np.int64)).tolist()
            own = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip([0, *ends], ends, strict=False)], dtype=np.int64)
            lo = np.frombuffer(lo, dtype=np.int64)
            most, flags = lo.copy(), (len(lo) + 7) // 8
            more = np.unpackbits(np.frombuffer(hi[:flags], dtype=np.uint8))[: len(lo)].astype(bool)
            most[more] = np.frombuffer(hi[flags:], dtype=np.int64)
            sent.append((chunk, own, most))
            lows.append(lo)
            anchors.append(np.frombuffer(anchor, dtype=np.uint32))
        strings = list(seen)
        if not strings:
            return answer([])
        least = np.full(len(strings), NO_ID, dtype=np.int64)
        np.minimum.at(least, np.concatenate([own for _, own, _ in sent]), np.concatenate(lows))
        anchor = np.zeros(len(strings), dtype=np.uint32)
        anchor[np.concatenate([own for _, own, _ in sent])] = np.concatenate(anchors)
        size = np.array([len(s) for s in strings], dtype=np.int64)
        # contexts whose anchor has no other: all of their windows have one first document
        _, which, times = np.unique(anchor, return_inverse=True, return_counts=True)
        branch = np.flatnonzero(times[which] > 1)
        firsts = np.repeat(least, size)
        if len(branch):
            firsts[np.repeat(times[which] > 1, size)] = window_firsts([strings[k] for k in branch], least[branch], span)
        # runs of windows with the same first document, per distinct context
        string = np.repeat(np.arange(len(strings)), size)
        offset = np.arange(len(firsts)) - np.repeat(np.cumsum(size) - size, size)
        window = offset <= size[string] - span
        string, offset, firsts = string[window], offset[window], firsts[window]
        lead = np.flatnonzero(first_of_groups(string, firsts))
        n = np.diff(np.append(lead, len(string)))
        string, offset, firsts = string[lead], offset[lead], firsts[lead]
        low, high = np.searchsorted(string, np.arange(len(strings))), np.searchsorted(string, np.arange(len(strings)), side="right")
        shard, out = t.column("shard")[0].as_py(), []
        for chunk, own, hi in sent:
            count = high[own] - low[own]
            context = np.repeat(np.arange(len(own)), count)
            run = np.repeat(low[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            some = firsts[run] < hi[context]
            context, run = context[some], run[some]
            if len(run):
                out.append((chunk, shard, 1, context.astype(np.uint32).tobytes(), (offset[run] << 16 | n[run]).astype(np.uint32).tobytes(), firsts[run].tobytes()))
        return answer(out)

    def apply(t: pa.Table, answers: pa.Table) -> pa.Table:
        t, ids, texts = rows_of(t)
        w = Windows(ids, texts, span, gram)
        cover = np.zeros(len(w.raw) + 1, dtype=np.int32)
        if answers.num_rows and len(texts):
            runs, keys, anchor, which, _, _ = w.contexts(wanted_of(answers))
            order, shard = by_shard(anchor)
            place = np.empty(len(keys), dtype=np.int64)  # of a context in the order that was sent
            place[order] = np.arange(len(keys))
            found = [[], [], []]
            for s, kind, a, b, c in zip(*[answers.column(x).to_pylist() for x in ("shard", "kind", "a", "b", "c")], strict=True):
                if kind == 1:
                    found[0].append(np.frombuffer(a, dtype=np.uint32).astype(np.int64) + np.searchsorted(shard, s))
                    found[1].append(np.frombuffer(b, dtype=np.uint32).astype(np.int64))
                    found[2].append(np.frombuffer(c, dtype=np.int64))
            if found[0]:
                context, spot, first = (np.concatenate(x) for x in found)
                by = np.argsort(context, kind="stable")
                context, spot, first = context[by], spot[by], first[by]
                mine = place[which]
                low, high = np.searchsorted(context, mine), np.searchsorted(context, mine, side="right")
                count = high - low
                run = np.repeat(runs, count)
                at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                gone = first[at] < w.doc[run]
                run, at = run[gone], at[gone]
                start = w.at[run] + (spot[at] >> 16)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + (spot[at] & 0xFFFF) + span - 1, -1)
        gone = np.cumsum(cover[:-1]) > 0
        buf = np.frombuffer(w.raw, dtype=np.uint8)
        n_removed, n_spans, kept = [], [], []
        for a, n, text_ in zip(w.first.tolist(), w.size.tolist(), texts, strict=True):
            own = gone[a : a + n]
            removed = int(own.sum())
            n_removed.append(removed)
            n_spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0)
            kept.append(buf[a : a + n][~own].tobytes() if removed else text_)
        t = own_columns(t, keep, text)
        for name, values, kind in (("n_bytes", w.size, pa.int64()), ("n_removed", n_removed, pa.int64()), ("n_spans", n_spans, pa.int64()), ("kept", kept, pa.binary())):
            t = t.append_column(name, pa.array(values, kind))
        return t

    by = docs.groupBy("_chunk")
    anchors = by.applyInArrow(send_anchors, "_chunk int, shard int, h binary, several binary").repartition(parts, "shard")
    first = anchors.groupBy("shard").applyInArrow(merge_anchors, ANSWER)
    contexts = by.cogroup(first.groupBy("_chunk")).applyInArrow(send_contexts, "_chunk int, shard int, " + ", ".join(f"{c} binary" for c in SENT)).repartition(parts, "shard")
    second = contexts.groupBy("shard").applyInArrow(merge_contexts, ANSWER)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return by.cogroup(first.unionByName(second).groupBy("_chunk")).applyInArrow(apply, f"{schema}, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every whole document without the bytes that an earlier one has in a string of 50."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
