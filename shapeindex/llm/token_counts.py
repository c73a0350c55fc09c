"""Operator 6, token counts by a separator scan.

A token file is a flat run of little-endian ids without an index; each document ends with the end-of-document id. Files are
cut into blocks of a fixed number of tokens, without regard to documents. A task searches whole blocks for the
separator (numpy) and reports, per block, the tokens before the first separator, between neighbouring ones and after the
last. A prefix scan over the blocks of a file (one narrow row per block) then stitches documents that cross borders: what is
open at a block's start is the tail of the last block with a separator and all blocks without one since.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored, table
from .tokenizer import WordBpe, load_spec, vocabulary_path

BLOCK_TOKENS = 1 << 18
FILE_DOCS = 4096  # documents in a token file of the query


def read_blocks(spark, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens) of flat token files: blocks of ``block_tokens`` ids of ``width`` bytes."""
    size = width * block_tokens
    d = spark.read.format("binaryFile").load(path).where("length > 0")
    d = d.select(F.col("path").alias("file"), "content", F.explode(F.expr(f"sequence(0L, (length - 1) div {size})")).alias("block"))
    return d.select("file", "block", F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("tokens"))


def scan_blocks(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """(file, block, separators, head, inner, tail) of each block: tokens before the first separator (all, if there is none),
    between neighbouring ones, and after the last (null: no separator). A null or empty block has no tokens."""
    prepare(blocks)
    kind = {1: "<u1", 2: "<u2", 4: "<u4"}[width]

    def run(batches):
        for b in batches:
            head, inner, tail, n = [], [], [], []
            for x in b.column(2).to_pylist():
                ids = np.frombuffer(x or b"", dtype=kind)
                at = np.flatnonzero(ids == separator)
                n.append(len(at))
                head.append(int(at[0]) if len(at) else len(ids))
                inner.append(np.diff(at) - 1)
                tail.append(len(ids) - 1 - int(at[-1]) if len(at) else None)
            columns = [pa.array(n, pa.int64()), pa.array(head, pa.int64()), pa.array(inner, pa.list_(pa.int64())), pa.array(tail, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["file", "block", "separators", "head", "inner", "tail"])

    return blocks.select(F.coalesce("file", F.lit("")).alias("file"), F.col("block").cast("long").alias("block"), "tokens").mapInArrow(
        run, "file string, block long, separators long, head long, inner array<long>, tail long")


def document_counts(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """(file, doc, block, n_tokens) for the documents of flat token files in ``blocks`` (file, block, tokens): ``doc`` counts
    from 0 in a file, ``block`` is where it ends; the separator is no token.

    Tokens after a file's last separator are a document of their own; nothing after it is none. Empty files and an empty
    table give no rows; a null file name is the empty one. (file, block) must be unique.
    """
    s = stored(blocks.sparkSession, scan_blocks(blocks, separator, width), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    narrow = s.select("file", "block", "separators", "head", "tail")
    # tokens of blocks without a separator, summed up so far; the sum known at the last separator is taken off again
    narrow = narrow.withColumn("_sum", F.coalesce(F.sum(F.when(F.col("separators") == 0, F.col("head")).otherwise(0)).over(before), zero))
    mark = F.max(F.when(F.col("separators") > 0, F.struct("block", "tail", "_sum"))).over(before)
    narrow = narrow.withColumns({"_mark": mark, "_first": F.coalesce(F.sum("separators").over(before), zero)})
    narrow = narrow.withColumn("_open", F.col("_sum") + F.coalesce(F.col("_mark.tail") - F.col("_mark._sum"), zero))
    closed = narrow.where("separators > 0").join(s.select("file", "block", "inner"), ["file", "block"])
    closed = closed.select("file", "block", "_first", F.posexplode(F.concat(F.array(F.col("_open") + F.col("head")), "inner")).alias("_i", "n_tokens"))
    closed = closed.select("file", (F.col("_first") + F.col("_i")).alias("doc"), "block", "n_tokens")
    last = F.max(F.struct("block", (F.col("_first") + F.col("separators")).alias("doc"), F.coalesce(F.col("tail"), F.col("_open") + F.col("head")).alias("n_tokens")))
    ends = narrow.groupBy("file").agg(last.alias("e")).select("file", "e.doc", "e.block", "e.n_tokens").where("n_tokens > 0")
    return closed.unionByName(ends)


def write_flat(docs: DataFrame, path: str, separator: int, block_tokens: int = BLOCK_TOKENS, file_docs: int = FILE_DOCS) -> DataFrame:
    """(file, block, tokens, ids): texts encoded with a vocabulary of less than 65,536 ids, run together with the separator
    after each, in files of ``file_docs`` documents cut into blocks. Special strings in a text are ordinary text. ``ids`` lists the
    doc_id of each document that ends in the block: a manifest to compare with, which the scan does not read."""
    shipped = prepare(docs).sparkContext.broadcast(load_spec(path))
    size, end = 2 * block_tokens, np.array([separator], dtype="<u2").tobytes()

    def run(batches):
        from pyspark import TaskContext

        bpe, part = WordBpe(shipped.value), TaskContext.get().partitionId()
        number = in_file = block = 0
        flat, ids, ends = bytearray(), [], []  # bytes from the current block on; its documents and where they end

        def cut(flush: bool):
            nonlocal block
            rows = []
            while len(flat) >= size or flush and flat:
                n = sum(e <= size for e in ends)
                rows.append((f"{part:06d}-{number:06d}", block, bytes(flat[:size]), ids[:n]))
                del flat[:size], ids[:n], ends[:n]
                ends[:] = [e - size for e in ends]
                block += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], names=["file", "block", "tokens", "ids"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out: list[bytes] = []
                bpe.encode_ordinary(text or "", out)
                flat += np.frombuffer(b"".join(out), dtype="<u4").astype("<u2").tobytes() + end
                ids.append(doc_id)
                ends.append(len(flat))
                in_file += 1
                if in_file == file_docs:
                    yield cut(True)
                    number, in_file, block = number + 1, 0, 0
                elif len(flat) >= size:
                    yield cut(False)
        yield cut(True)

    return docs.select("doc_id", "text").mapInArrow(run, "file string, block long, tokens binary, ids array<long>")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents as flat token files; then the number of tokens of each document, from a scan of the files alone. The
    manifest of the files names each document that the scan found."""
    path = vocabulary_path()
    separator = load_spec(path)["special"]["<|endoftext|>"]
    files = stored(spark, write_flat(table(spark, sf_dir, "documents"), path, separator), "token-files")
    counts = document_counts(files.select("file", "block", "tokens"), separator)
    nth = F.row_number().over(Window.partitionBy("file", "block").orderBy("doc")) - 1
    named = files.select("file", "block", F.posexplode("ids").alias("_i", "doc_id"))
    return counts.withColumn("_i", nth).join(named, ["file", "block", "_i"]).select("doc_id", "file", "doc", "n_tokens")
