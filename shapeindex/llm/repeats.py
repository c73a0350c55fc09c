"""Operator 5, substring dedup by de Bruijn compaction.

Every window of ``span`` words is an edge of a de Bruijn graph over tokens. Of the short grams inside an edge the one
with the smallest hash is its anchor; consecutive edges of a text with the same anchor are a path segment. Grouping the
segments of all texts by anchor (a Spark window over the anchor) tells

* anchors in one document only: not repeated, dropped;
* anchors whose segments are all equal: the path doesn't branch here, and the compacted segment as a whole is the
  repeat: its smallest document decides for all its edges;
* anchors with different segments: the path branches or ends here. Only these segments are taken apart into edges,
  which are grouped one by one.

An edge determines its anchor, so equal edges always meet. Edges are told apart by the hash of the anchor and an independent
hash of all the window's words together (128 bits, both over the words' bytes); at the source coordinates each covered word is
then removed.

Rows lie in chunks by a hash of the id, of about ``CHUNK_BYTES`` each. A chunk sends each of its distinct segments or
edges once (with its smallest and its largest document), so a passage that most documents share is one row per chunk;
answers come back per chunk. Texts are shuffled once, all passes read that exchange.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, table
from .textbytes import MIX2, MUL, U64, first_of_groups, grams, lookup, minimizers, mix, word_hashes, word_table

SPAN = 13
GRAM = 5
CHUNK_BYTES = 2 << 20
NO_ID = (1 << 63) - 1  # stands for a null id: later than all others


class Chunk:
    """Words, edges and path segments of the texts of one chunk."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], span: int, gram: int) -> None:
        self.ids = ids
        self.buf, self.starts, self.ends, self.row = word_table(texts)
        h = word_hashes(self.buf, self.starts, self.ends)
        n = len(h) - span + 1
        if n <= 0:
            self.at = np.zeros(0, dtype=np.int64)
            self.edge = self.anchor = np.zeros(0, dtype=U64)
            self.segment_of = self.at
            return
        g = grams(h, gram)
        anchor_at = minimizers(g, span - gram + 1)[:n]
        inside = self.row[:n] == self.row[span - 1 :]
        self.at = np.flatnonzero(inside)  # word where each edge starts
        # by an independent hash of the words: a clash of words in one of the two does not carry over to the other
        self.edge = grams(word_hashes(self.buf, self.starts, self.ends, seed=1), span)[self.at]
        place = anchor_at[self.at]
        self.anchor = g[place]
        self.segment_of = np.cumsum(first_of_groups(place)) - 1

    def docs(self) -> np.ndarray:
        return self.ids[self.row[self.at]]

    def segments(self):
        """(anchor, hash of the segment, document, first edge) of each path segment."""
        first = np.flatnonzero(first_of_groups(self.segment_of)) if len(self.at) else self.at
        last = np.append(first[1:], len(self.at)) - 1 if len(first) else first
        # its first and last edge overlap, so they and their distance tell all its words
        seg = mix(self.edge[first] * MUL + mix(self.edge[last] + (last - first).astype(U64) * MIX2))
        return self.anchor[first], seg, self.docs()[first], first


def both(edge: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """One key of an edge's two hashes, to look up answers within a chunk."""
    return mix(edge ^ mix(anchor))


def smallest_and_largest(keys: list[np.ndarray], docs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per distinct key: a row with its smallest document and, if it is another, one with its largest."""
    order = np.lexsort((docs, *keys[::-1]))
    keys, docs = [k[order] for k in keys], docs[order]
    lead = first_of_groups(*keys)
    tail = np.append(lead[1:], True)[: len(lead)]
    pick = lead | (tail & ~_same_as_lead(lead, docs))
    return [k[pick] for k in keys], docs[pick]


def _same_as_lead(lead: np.ndarray, docs: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(lead)
    return docs == docs[first[np.cumsum(lead) - 1]] if len(first) else lead


def rows_of(t: pa.Table) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """A chunk's rows sorted by id and text (the same order in every pass), ids and texts in UTF-8."""
    t = t.sort_by([("_id", "ascending"), ("_text", "ascending")])
    ids = t.column("_id").to_numpy()
    return t, ids, [x.encode() if x is not None else b"" for x in t.column("_text").to_pylist()]


def own_columns(t: pa.Table, keep: list[str], text: str) -> pa.Table:
    """The columns that the chunk's rows came with."""
    return pa.table({c: t.column("_text" if c == text else c) for c in keep})


def chunks(df: DataFrame, id_col: str, text: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``df`` with _chunk and _id, its text renamed to _text (it travels once), partitioned by chunk; and the number of chunks."""
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, math.ceil(total / chunk_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 32))
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    out = df.withColumns({"_id": own, "_chunk": F.pmod(F.xxhash64(own), F.lit(n)).cast("int")}).withColumnRenamed(text, "_text")
    return out.repartition(parts, "_chunk"), n


def _answers(sent: DataFrame, key: list[str], n_chunks: int, branches: bool) -> DataFrame:
    """For rows (key columns, [seg], doc) dealt by key: which key is in several documents, and the first of them, back to the
    chunks that hold later ones. With ``branches``: kind 1 for keys whose segments differ."""
    # one exchange: the window reads what was dealt by key, where a join would deal it a second time
    own = Window.partitionBy(*key)
    aggs = {"first": F.min("doc").over(own), "_last": F.max("doc").over(own)}
    if branches:
        aggs["_branch"] = F.min("seg").over(own) != F.max("seg").over(own)
    met = sent.repartition(key[0]).withColumns(aggs).where("first < _last")
    branch = F.col("_branch") if branches else F.lit(False)
    met = met.where(branch | (F.col("doc") > F.col("first")))
    kind = F.when(branch, 1).otherwise(0 if branches else 2)
    return met.select(F.pmod(F.xxhash64("doc"), F.lit(n_chunks)).cast("int").alias("_chunk"), kind.cast("byte").alias("kind"), *key, "first")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM,
                   chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All rows and columns of ``df`` with ``n_words``, ``n_removed`` and ``kept`` (the kept words joined by one space).

    A word goes if a window of ``span`` words that covers it also starts in a document with a smaller id. Rows of one id are
    one document's texts, not earlier than each other; a null id is later than all others. Null and empty texts, and
    texts of fewer than ``span`` words, lose nothing. Columns of ``df`` named like the three are replaced.
    """
    prepare(df)
    made = {"n_words", "n_removed", "kept"}
    keep = [c for c in df.columns if c.lower() not in made]
    docs, n_chunks = chunks(df.select(*keep), id_col, text, chunk_bytes)

    def send_segments(t: pa.Table) -> pa.Table:
        _, ids, texts = rows_of(t)
        anchor, seg, doc, _ = Chunk(ids, texts, span, gram).segments()
        (anchor, seg), doc = smallest_and_largest([anchor, seg], doc)
        return pa.table({"anchor": anchor.view(np.int64), "seg": seg.view(np.int64), "doc": doc})

    def send_edges(t: pa.Table, answers: pa.Table) -> pa.Table:
        _, ids, texts = rows_of(t)
        c = Chunk(ids, texts, span, gram)
        branching = np.unique(answers.column("anchor").to_numpy().view(U64))
        which = np.flatnonzero(lookup(branching, np.ones(len(branching), dtype=np.int64), c.anchor, 0))
        (edge, anchor), doc = smallest_and_largest([c.edge[which], c.anchor[which]], c.docs()[which])
        return pa.table({"edge": edge.view(np.int64), "anchor": anchor.view(np.int64), "doc": doc})

    def apply(t: pa.Table, answers: pa.Table) -> pa.Table:
        t, ids, texts = rows_of(t)
        c = Chunk(ids, texts, span, gram)
        kind, first = answers.column("kind").to_numpy(), answers.column("first").to_numpy()
        anchor, edge = (answers.column(x).to_numpy().view(U64) for x in ("anchor", "edge"))
        gone = np.zeros(len(c.starts), dtype=bool)
        if len(kind):
            docs_of = c.docs()
            hit = np.zeros(len(c.at), dtype=bool)
            for k, asked, keys in ((0, anchor, c.anchor), (2, both(edge, anchor), both(c.edge, c.anchor))):
                own = kind == k
                if own.any():
                    hk = asked[own]
                    order = np.argsort(hk)
                    hit |= lookup(hk[order], first[own][order], keys, NO_ID) < docs_of
            cover = np.zeros(len(c.starts) + span + 1, dtype=np.int32)
            np.add.at(cover, c.at[hit], 1)
            np.add.at(cover, c.at[hit] + span, -1)
            gone = np.cumsum(cover)[: len(c.starts)] > 0
        kept, n_words = [], np.bincount(c.row, minlength=len(texts))
        n_removed = np.bincount(c.row[gone], minlength=len(texts))
        ends = np.cumsum(n_words)
        raw = c.buf.tobytes()
        for i in range(len(texts)):
            own = np.arange(ends[i] - n_words[i], ends[i])
            own = own[~gone[own]]
            kept.append(b" ".join([raw[a:b] for a, b in zip(c.starts[own].tolist(), c.ends[own].tolist(), strict=True)]).decode())
        t = own_columns(t, keep, text)
        return t.append_column("n_words", pa.array(n_words.astype(np.int64))).append_column("n_removed", pa.array(n_removed.astype(np.int64))).append_column("kept", pa.array(kept, type=pa.string()))

    by = docs.groupBy("_chunk")
    segments = by.applyInArrow(send_segments, "anchor long, seg long, doc long")
    first = _answers(segments, ["anchor"], n_chunks, branches=True)
    edges = by.cogroup(first.where("kind = 1").groupBy("_chunk")).applyInArrow(send_edges, "edge long, anchor long, doc long")
    second = _answers(edges, ["edge", "anchor"], n_chunks, branches=False)
    none = F.lit(0).cast("long").alias("edge")
    answers = first.where("kind = 0").select("_chunk", "kind", none, "anchor", "first").unionByName(second)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return by.cogroup(answers.groupBy("_chunk")).applyInArrow(apply, f"{schema}, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every whole document without the words that an earlier one has in a window of 13."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
with d as (
  select doc_id, row_number() over () r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') w from documents
), g as (
  select doc_id, r, unnest(range(1, len(w) - 11)) p, unnest(list_transform(range(1, len(w) - 11), lambda p: array_to_string(w[p:p + 12], ' '))) win
  from d where len(w) >= 13
), firsts as (
  select win, min(doc_id) f from g group by win having count(distinct coalesce(doc_id::varchar, 'null')) > 1
), gone as (
  select r, list(distinct q) q from (select r, unnest(range(p, p + 13)) q from g join firsts using (win) where f < doc_id or (doc_id is null and f is not null)) group by r
)
select doc_id, len(w)::bigint n_words, coalesce(len(q), 0)::bigint n_removed,
       sha256(array_to_string(case when q is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(q, i)), lambda i: w[i]) end, ' ')) kept_sha256
from d left join gone using (r)
"""
