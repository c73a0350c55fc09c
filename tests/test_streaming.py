"""Structured Streaming: dedup stream equals batch dedup; streamed index equals batch build."""
import os

from pyspark.sql import functions as F

from shapeindex.operators import index as I
from shapeindex.session import scratch_path
from shapeindex.streaming.items import ITEM_STREAM_SCHEMA, clean_stream, dedup_stream, index_stream


def _write_feed(spark, rows, path):
    spark.createDataFrame(rows, ITEM_STREAM_SCHEMA).coalesce(1).write.json(path)


def test_dedup_and_clean_stream(spark):
    src = scratch_path(spark, "feed")
    _write_feed(spark, [("a", "u1", [], 0), ("b", "u1", ["x = a.b()"], 1), ("c", "u2", ["def (:"], 2),
                        ("d", "u3", ["y = c.d()", "z"], 3)], src + "/0")
    stream = spark.readStream.schema(ITEM_STREAM_SCHEMA).json(src + "/*")
    out = scratch_path(spark, "feed-out")
    q = (dedup_stream(clean_stream(stream)).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "-ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.url, r.code_snippets) for r in spark.read.parquet(out).collect())
    assert got == [("u1", ["x = a.b()"]), ("u3", ["y = c.d()", "z"])]


def test_index_stream_equals_batch(spark):
    src = scratch_path(spark, "feed2")
    rows = [(f"t{i}", f"u{i}", [f"v = o.m{i % 3}()", "def (:"], i) for i in range(6)]
    _write_feed(spark, rows[:3], os.path.join(src, "0"))
    _write_feed(spark, rows[3:], os.path.join(src, "1"))
    spath = scratch_path(spark, "sidx")
    I.create_index(spark, spath)
    stream = spark.readStream.schema(ITEM_STREAM_SCHEMA).option("maxFilesPerTrigger", 1).json(src + "/*")
    index_stream(stream, spath, spath + "-ck").awaitTermination()
    bpath = scratch_path(spark, "bidx")
    b = I.create_index(spark, bpath)
    I.add_items(b, spark.createDataFrame(rows, ITEM_STREAM_SCHEMA))
    s = I.open_index(spark, spath)
    assert s.stats_row() == I.open_index(spark, bpath).stats_row() == (6, 6)
    assert sorted(tuple(r) for r in s.terms().select("term_hash", "df").collect()) == \
        sorted(tuple(r) for r in I.open_index(spark, bpath).terms().select("term_hash", "df").collect())
    assert list(s.meta["streams"].values()) == [1]


def test_dedup_within_watermark(spark):
    src = scratch_path(spark, "wm")
    rows = [("u1", "2024-01-01 00:00:00", 1), ("u1", "2024-01-01 00:00:05", 2), ("u2", "2024-01-01 00:00:01", 3)]
    (spark.createDataFrame(rows, "url string, ts string, n int").withColumn("ts", F.to_timestamp("ts"))
     .coalesce(1).write.parquet(src))
    stream = spark.readStream.schema("url string, ts timestamp, n int").parquet(src)
    out = scratch_path(spark, "wm-out")
    q = (dedup_stream(stream, watermark=("ts", "1 hour")).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "-ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["u1", "u2"]


def test_index_stream_upsert(spark):
    src = scratch_path(spark, "feed3")
    _write_feed(spark, [("t", "u1", ["a = x.f()"], 0), ("t", "u2", ["b = y.g()"], 1)], os.path.join(src, "0"))
    _write_feed(spark, [("t", "u1", ["c = z.h()", "d = w.k()"], 0)], os.path.join(src, "1"))
    path = scratch_path(spark, "uidx")
    I.create_index(spark, path)
    stream = spark.readStream.schema(ITEM_STREAM_SCHEMA).option("maxFilesPerTrigger", 1).json(src + "/*")
    index_stream(stream, path, path + "-ck", upsert=True).awaitTermination()
    idx = I.open_index(spark, path)
    assert sorted((r.url, r.content) for r in I.iter_documents(idx).collect()) == [
        ("u1", "c = z.h()"), ("u1", "d = w.k()"), ("u2", "b = y.g()")]
    assert I.index_len(idx) == 3


def test_two_streams_feed_one_index(spark):
    """Each stream has its own checkpoint; the second one's batch 0 is not taken for a replay."""
    spath = scratch_path(spark, "two-streams")
    I.create_index(spark, spath)
    for k in range(2):
        src = scratch_path(spark, f"feed{k}")
        rows = [(f"t{k}{i}", f"u{k}{i}", [f"v = o.m{i % 3}()"], i) for i in range(4)]
        _write_feed(spark, rows, os.path.join(src, "0"))
        stream = spark.readStream.schema(ITEM_STREAM_SCHEMA).json(src + "/*")
        index_stream(stream, spath, f"{spath}-ck{k}").awaitTermination()
        assert I.index_len(I.open_index(spark, spath)) == 4 * (k + 1)
    idx = I.open_index(spark, spath)
    assert len(idx.meta["streams"]) == 2
