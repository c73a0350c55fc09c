"""Operator 2, exact top-k inner products with a bit-sliced index.

Components are quantised to integers. A block of rows is an index of its own: for each dimension and each bit of the
quantised value (less the smallest value of the table, so none is negative) a bitmap over the block's rows. A query's score
over all rows is a sum of slices shifted by the bits of its own components, made with bitmap adders only: all
slices of one weight are added three by two until one is left per weight. A negative component adds the complement
of its dimension's slices. The result is the score, again bit-sliced.

The top rows are read from the most significant slice down: rows with the bit set win while no more than k do; when more
do, only they stay candidates. What is left after the last slice ties at the boundary, and the smallest ids are taken.
Each block gives k rows, and the k best of all blocks are exact.

Queries come in chunks. A Spark task has one block and one chunk; blocks and chunks are replicated to a grid that grows with
rows x queries, as the work does.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored, table

SCALE = 256
BLOCK_ROWS = 8192
CHUNK_QUERIES = 256


def pack(bits: np.ndarray) -> np.ndarray:
    """Bitmaps along the last axis, as 64-bit words."""
    n = bits.shape[-1]
    out = np.packbits(bits, axis=-1, bitorder="little")
    pad = -(-n // 64) * 8 - out.shape[-1]
    return np.ascontiguousarray(np.pad(out, [(0, 0)] * (out.ndim - 1) + [(0, pad)])).view(np.uint64)


class Index:
    """Bit slices of one block: ``slices[d, i]`` has bit i of dimension d (value - base) for every row."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, base: int, width: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], (values[order] - base).astype(np.uint64)
        self.rows, self.dims, self.base, self.width = len(ids), values.shape[1], base, width
        shifts = np.arange(width, dtype=np.uint64)[None, :, None]
        self.slices = pack(((values.T[:, None, :] >> shifts) & np.uint64(1)).astype(np.uint8))
        self.all = pack(np.ones(self.rows, dtype=np.uint8))

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the score, lowest bit first, and the constant to add to it."""
        query = np.asarray(query, dtype=object)
        top = (1 << self.width) - 1
        # sum of q (v - base): for negative q the complement, |q| (top - (v - base)), less |q| top
        offset = sum(int(q) * self.base - (abs(int(q)) * top if q < 0 else 0) for q in query)
        weights: dict[int, list[np.ndarray]] = {}
        size = np.abs(query).astype(np.uint64) if len(query) else np.zeros(0, dtype=np.uint64)
        negative = np.array([q < 0 for q in query], dtype=bool)
        for j in range(int(size.max()).bit_length() if len(size) else 0):
            own = ((size >> np.uint64(j)) & np.uint64(1)).astype(bool)
            plus, minus = self.slices[: len(query)][own & ~negative], ~self.slices[: len(query)][own & negative]
            for i in range(self.width):
                weights.setdefault(i + j, []).extend([plus[:, i], minus[:, i]])
        out, carry, w = [], None, 0
        while weights or carry is not None:
            parts = [p for p in weights.pop(w, []) if len(p)]
            if carry is not None and len(carry):
                parts.append(carry)
            column = np.concatenate(parts) if parts else np.zeros((0, self.slices.shape[2]), dtype=np.uint64)
            carries = []
            while len(column) > 1:
                third = len(column) // 3
                if third:  # full adders: three slices of a weight make one of it and one of the next
                    a, b, c = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
                    ab = a ^ b
                    carries.append((a & b) | (ab & c))
                    column = np.concatenate([ab ^ c, column[3 * third :]])
                else:  # a half adder for the last two
                    carries.append((column[0] & column[1])[None])
                    column = (column[0] ^ column[1])[None]
            out.append(column[0] if len(column) else np.zeros(self.slices.shape[2], dtype=np.uint64))
            carry = np.concatenate(carries) if carries else None
            w += 1
        return out, offset

    def top(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the k best rows (ties to smaller ids), without rows of id ``own``."""
        slices, offset = self.scores(query)
        edge, sure = self.all.copy(), np.zeros_like(self.all)
        if own is not None:
            lo, hi = np.searchsorted(self.ids, [own, own + 1]) if own < (1 << 63) - 1 else (np.searchsorted(self.ids, own), len(self.ids))
            for r in range(int(lo), int(hi)):
                edge[r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        for s in reversed(slices):
            both = edge & s
            n = int(np.bitwise_count(both).sum() + np.bitwise_count(sure).sum())
            if n > k:
                edge = both
            else:
                sure |= both
                edge &= ~s
                if n == k:
                    edge[:] = 0
                    break
        missing = k - int(np.bitwise_count(sure).sum())
        rows = self._rows(sure, k)
        if missing > 0:
            rows = np.concatenate([rows, self._rows(edge, missing)])  # rows are sorted by id: the smallest come first
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        score = [offset + sum(int((s[w] >> b) & np.uint64(1)) << i for i, s in enumerate(slices)) for w, b in zip(word, bit, strict=True)]
        return self.ids[rows], score

    @staticmethod
    def _rows(bitmap: np.ndarray, most: int) -> np.ndarray:
        words = np.flatnonzero(bitmap)[:most]  # each has a row at least
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return (words[at] * 64 + bit)[:most]


LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


def quantised(df: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component as long. Rows with a null id, a null vector, or null, NaN or infinite
    components have no part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    d = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    d = d.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return d.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for quantised ``vectors`` and ``queries`` (id, v): the k highest inner products with
    rows of another id, ties to smaller ids; all rows, if fewer.

    Vectors of fewer dimensions count as zero in the others; empty vectors score 0. Rows of one id are rows of their own,
    and so are queries of one id that differ in their vector (equal ones are one query). Empty tables give no rows. Scores
    beyond 64 bits are the least or the greatest long.
    """
    spark = prepare(vectors)
    stats = vectors.agg(F.count("*").alias("n"), F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"), F.max(F.size("v")).alias("dims")).first()
    # queries of one id are told apart by their number among those of the id
    queries = queries.dropDuplicates(["id", "v"]).withColumn("q", F.row_number().over(Window.partitionBy("id").orderBy("v")).cast("long"))
    n_queries = queries.count()
    base, width = min(0, stats["lo"] or 0), max(1, (max(0, stats["hi"] or 0) - min(0, stats["lo"] or 0)).bit_length())
    dims = stats["dims"] or 0
    blocks, groups = max(1, math.ceil((stats["n"] or 0) / block_rows)), max(1, math.ceil(n_queries / chunk_queries))
    cell = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(groups)).cast("int")
    left = vectors.select("id", "v", cell[0].alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("chunk"))
    right = queries.select("id", "v", "q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), cell[1].alias("chunk"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks * groups, 4096))

    def matrix(t: pa.Table) -> np.ndarray:
        v = t.column("v").combine_chunks()
        n = np.diff(v.offsets.to_numpy())
        out = np.zeros((len(n), dims), dtype=np.int64)
        at = np.repeat(np.arange(len(n)), n)
        out[at, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = v.flatten().to_numpy()
        return out

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            index = Index(rows.column("id").to_numpy(), matrix(rows), base, width)
            for qid, q, number in zip(*[asked.column(c).to_pylist() for c in ("id", "v", "q")], strict=True):
                ids, scores = index.top(np.array(q[:dims], dtype=object), k, qid)
                out += [(qid, number, int(i), max(LEAST, min(GREATEST, s))) for i, s in zip(ids, scores, strict=True)]
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({c: pa.array(x, type=pa.int64()) for c, x in zip(("query_id", "_q", "vec_id", "score"), cols, strict=True)})

    cells = left.repartition(parts, "block", "chunk").groupBy("block", "chunk").cogroup(right.repartition(parts, "block", "chunk").groupBy("block", "chunk"))
    best = cells.applyInArrow(search, "query_id long, _q long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "_q").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_bitsliced_topk(spark, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for every vector whose id is divisible by 50."""
    v = stored(spark, quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "quantised")
    return top_k(v, v.where("id % 50 = 0"), 5)


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id query_id, v.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]))::bigint score
  from v q, v where q.vec_id % 50 = 0 and v.vec_id != q.vec_id
), r as (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
