"""Operator 13, packing along a space-filling curve.

A document's token counts are hashed into a short vector, its square roots normed and projected to four dimensions by a fixed
random matrix. The cell of the point has a place on the Hilbert curve. Documents go to range buckets of the curve, are
sorted in them and follow one another in sequences; neighbours on the curve are neighbours in a sequence. A document that
does not fit is cut and goes on in the next sequence, so all sequences of a bucket are full but for its end, which is cut
into sequences of powers of two: no padding at all.

Tokens are made once and shuffled once. Bucket limits come from a bounded sample of documents, weighed by their tokens (they
decide on nothing but the size of buckets). The place has some bits of a hash of the row below it, so that copies, which have
one place on the curve, still spread over buckets. A task streams its bucket and holds one sequence.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, table
from .tokenizer import _bpe, load_spec, vocabulary_path

SEQUENCE = 2048
END_ID = 1
#: Texts of a bucket in bytes, documents of the sample a bucket, and the most buckets (whose limits are broadcast).
BUCKET_BYTES, SAMPLE_DOCS, MAX_BUCKETS = 8 << 20, 40, 1 << 15
HASHED, DIMENSIONS, BITS, SALT_BITS = 256, 4, 12, 15
SEED = 29
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points, one a row, each coordinate below ``2 ** bits``."""
    x = points.T.astype(np.int64).copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):  # undo rotations and reflections, from the coarsest cell down
        low = (1 << b) - 1
        for i in range(d):
            up = (x[i] >> b & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            place = place << 1 | (x[i] >> b & 1)
    return place


def matrix() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((HASHED, DIMENSIONS))


def hashed_vector(ids: np.ndarray) -> np.ndarray:
    """Square roots of the counts of hashed ids, of length 1."""
    h = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
    v = np.sqrt(np.bincount(h, minlength=HASHED))
    return v / np.sqrt(len(ids))


def places(vectors: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Places of documents: four standard deviations of the projection span the grid."""
    grid = np.clip((vectors @ projection + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(grid.astype(np.int64), BITS)


def _tokens(path: str, shipped, limits=None):
    """(doc_id, salt, text) to (doc_id, place, bucket, n, ids); without ``limits``, for the sample, to (place, n)."""
    sample = limits is None

    def run(batches):
        bpe = _bpe(path, shipped)
        projection = matrix()
        edges = None if sample else np.array(limits.value, dtype=np.int64)
        width = "<u2" if len(bpe.offset) <= 1 << 16 else "<u4"
        for whole in batches:
            for b in slices(whole, 2):
                ids = [np.append(np.frombuffer(bpe.encode(t or ""), dtype="<u4"), np.uint32(END_ID)) for t in b.column(2).to_pylist()]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                place = places(np.array([hashed_vector(x) for x in ids]), projection) << SALT_BITS | b.column(1).to_numpy()
                if sample:
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(n)], names=["place", "n"])
                else:
                    bucket = np.searchsorted(edges, place, side="right").astype(np.int32)
                    raw = pa.array([x.astype(width).tobytes() for x in ids], pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place), pa.array(bucket), pa.array(n), raw], names=["doc_id", "place", "bucket", "n", "ids"])

    return run


class Bucket:
    """Pieces of a bucket; holds those of the sequence that is not full yet."""

    def __init__(self, number: int, sequence: int) -> None:
        self.next, self.sequence, self.fill = number << 40, sequence, 0
        self.held: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            take = min(self.sequence - self.fill, n - at)
            self.held.append((doc_id, at, ids[at : at + take], n))
            self.fill += take
            at += take
            if self.fill == self.sequence:
                self._close(self.sequence)

    def _close(self, size: int) -> None:
        """The first ``size`` ids that are held become a sequence; the piece across its end is cut."""
        offset, k = 0, 0
        while offset < size:
            doc_id, start, ids, n = self.held[k]
            take = min(len(ids), size - offset)
            self.out.append((doc_id, start, take, zlib.crc32(ids[:take].astype("<u4").tobytes()), n, self.next, offset))
            offset += take
            if take < len(ids):
                self.held[k] = (doc_id, start + take, ids[take:], n)
            else:
                k += 1
        del self.held[:k]
        self.fill -= size
        self.next += 1

    def end(self) -> None:
        while self.fill:
            self._close(1 << (self.fill.bit_length() - 1))


def _cut(sequence: int, wide: bool):
    def batch(rows):
        types = [pa.int64()] * 7
        names = [f.split(" ")[0] for f in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        number, now = None, None
        for whole in batches:
            for b in slices(whole, 2):
                for k, doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if k != number:
                        if now is not None:
                            now.end()
                            yield batch(now.out)
                        number, now = k, Bucket(k, sequence)
                    now.add(doc_id, np.frombuffer(raw.as_buffer(), dtype="<u4" if wide else "<u2"))
                    if len(now.out) >= 10_000:
                        yield batch(now.out)
                        now.out = []
        if now is not None:
            now.end()
            if now.out:
                yield batch(now.out)

    return run


def bucket_limits(sample: list, buckets: int) -> list[int]:
    """Places that cut the sample's tokens into equal parts; equal limits fall together."""
    if not sample:
        return []
    place, n = np.array(sample, dtype=np.int64).T
    order = np.argsort(place, kind="stable")
    total = np.cumsum(n[order])
    at = np.searchsorted(total, np.arange(1, buckets) * (total[-1] / buckets))
    return sorted(set(place[order][at].tolist()))


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Pieces of all rows of (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text (null and empty texts: none) and the id 1. Every id lies in one piece. Every sequence
    has ``sequence`` ids or, at the end of a bucket, a smaller power of two. Rows of one id are documents of their own; a null
    id stays null. Equal rows lie beside one another. Other columns are ignored. An empty table gives an empty result.
    """
    spark = prepare(docs)
    spec = load_spec(path)
    shipped = spark.sparkContext.broadcast(spec)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = min(MAX_BUCKETS, 1 + int(size + 16 * n) // bucket_bytes)
    h = F.xxhash64("doc_id", "text")
    rows = rows.select("doc_id", F.shiftrightunsigned(h, 64 - SALT_BITS).alias("salt"), "text", h.alias("_h"))
    some = rows.where(F.pmod("_h", F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, buckets * SAMPLE_DOCS / max(1, n))) if buckets > 1 else 0)).drop("_h")
    limits = bucket_limits([tuple(r) for r in some.mapInArrow(_tokens(path, shipped), "place long, n long").collect()] if buckets > 1 else [], buckets)
    made = rows.drop("_h").mapInArrow(_tokens(path, shipped, spark.sparkContext.broadcast(limits)), "doc_id long, place long, bucket int, n long, ids binary")
    sent = made.repartitionById(len(limits) + 1, F.col("bucket")).sortWithinPartitions("bucket", "place", "doc_id")
    return sent.select("bucket", "doc_id", "ids").mapInArrow(_cut(sequence, len(spec["vocab"]) + len(spec["special"]) > 1 << 16), PIECES)


def op13_curve_packing(spark, sf_dir: str) -> DataFrame:
    """Every whole document, in sequences of 2048 ids at most."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
