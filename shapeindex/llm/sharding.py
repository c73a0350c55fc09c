"""Operator 1, sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source. ``(rank - 1/2) / rows of the source`` is the
row's fractional rank: sorting all rows by it interleaves the sources in proportion, so any stretch of the order has the
mixture of the whole. Cutting the order into equal stretches gives shards whose counts differ by one at most and whose
share of each source is within a row or two of its share of the table.

Neither ranking collects a source or the table in one task: rows fall into buckets of the hash (and then of the
fractional rank) of about ``bucket_rows`` rows, only bucket counts are summed up over buckets, and the exact order is
made within a bucket.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BUCKET_ROWS = 8192
SEED = 17


def _offsets(counts: DataFrame, by: list, order: str) -> DataFrame:
    """Adds ``_before``: the sum of ``_n`` over earlier buckets of the same ``by``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0).cast("long")))


def interleave(df: DataFrame, n_shards: int, stratum: str = "source", key: str = "doc_id", ties: tuple = (),
               seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in a shard).

    Shard counts differ by one at most; fewer rows than shards leave the last shards empty. A null ``stratum`` is a
    stratum of its own. Rows are ordered by md5 of seed and ``key`` (null: as the text "null"), then ``key``, then the
    ``ties`` columns; rows equal in all of these are interchangeable. An empty table gives an empty result. Columns named
    ``shard``, ``slot`` or with the prefix ``_il_`` must not exist; rename them first.
    """
    clash = [c for c in df.columns if c.lower() in ("shard", "slot") or c.lower().startswith("_il_")]
    if clash:
        raise ValueError(f"columns {clash} clash with the result's")
    d = df.withColumn("_il_s", F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("")))
    d = d.withColumn("_il_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary")))
    total = df.count()
    buckets = max(1, total // bucket_rows)
    d = d.withColumn("_il_b", F.floor(F.conv(F.substring("_il_h", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * buckets).cast("long"))
    counts = d.groupBy("_il_s", "_il_b").agg(F.count("*").alias("_n"))
    counts = _offsets(counts, ["_il_s"], "_il_b").withColumn("_il_n", F.sum("_n").over(Window.partitionBy("_il_s")))
    order = [F.col("_il_h"), F.col(key).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    d = d.withColumn("_il_r", F.row_number().over(Window.partitionBy("_il_s", "_il_b").orderBy(*order)))
    d = d.join(counts.select("_il_s", "_il_b", "_before", "_il_n"), ["_il_s", "_il_b"])
    d = d.withColumn("_il_f", (F.col("_il_r") + F.col("_before") - F.lit(0.5)) / F.col("_il_n")).drop("_il_r", "_before", "_il_b", "_il_n")
    # second ranking: the whole table by fractional rank, in buckets of it
    d = d.withColumn("_il_g", F.floor(F.col("_il_f") * buckets).cast("long"))
    starts = _offsets(d.groupBy("_il_g").agg(F.count("*").alias("_n")), [], "_il_g").select("_il_g", "_before")
    d = d.withColumn("_il_p", F.row_number().over(Window.partitionBy("_il_g").orderBy("_il_f", "_il_s", *order)))
    d = d.join(starts, "_il_g").withColumn("_il_p", (F.col("_il_p") + F.col("_before") - 1).cast("long"))
    d = d.withColumn("shard", F.expr(f"cast((_il_p * {n_shards}) div {max(1, total)} as int)"))
    d = d.withColumn("slot", F.expr(f"_il_p - (cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}"))
    return d.select(*df.columns, "shard", "slot")


def op1_shard_interleave(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the ``rows`` law; a null text has no bytes (size 16, CRC of nothing)."""
    d = table(spark, sf_dir, "documents")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    d = d.select("doc_id", "source", (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"),
                 F.crc32(text).cast("long").alias("text_crc32"))
    out = interleave(d, 40, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source")


#: DuckDB has no CRC: ``crc_table`` holds the remainders of a byte (CRC-32, reflected), ``c`` runs over a text's bytes.
OP1_SQL = """
with crc_table as (
  select list(v order by i) t from (
    select i, list_reduce([i::bigint, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v
    from range(256) r(i))
), d as (
  select doc_id, source, strlen(coalesce(text, '')) + 16 as size, coalesce(text, '') as x,
         md5('17:' || coalesce(doc_id::varchar, 'null')) h, 's' || source as s0
  from documents
), c as (
  select doc_id, source, size, h, coalesce(s0, '') s,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(x)), '..'),
             lambda b: ('0x' || b)::bigint)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::bigint as text_crc32
  from d, crc_table
), r as (
  select *, (row_number() over (partition by s order by h, doc_id nulls last, size, text_crc32) - 0.5::double)
            / count(*) over (partition by s) f, count(*) over () n from c
), p as (
  select *, row_number() over (order by f, s, h, doc_id nulls last, size, text_crc32) - 1 p from r
)
select doc_id, size::bigint size, text_crc32, 'rows' as law, (p * 40 // n)::int as shard,
       (p - ((p * 40 // n) * n + 39) // 40)::bigint as slot, null::int as grown_shard, source from p
"""
