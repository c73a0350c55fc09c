"""Incremental indexing with Structured Streaming (STR1-STR3)."""
from __future__ import annotations

from contextlib import contextmanager
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import index as I
from ..operators.html import is_valid_snippet
from ..session import ship_package


#: State on executors' disks in RocksDB; a checkpoint of a micro-batch holds its changes only.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


@contextmanager
def rocksdb_state(spark):
    """Streams that start while this holds keep their state in RocksDB (:data:`ROCKSDB`) instead of the executors' heap, so the urls of
    all time need not fit in memory. A stream stays with what its checkpoint was begun with."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_rows(query) -> int:
    """Keys in the state of a stream's stateful operators after its last micro-batch that reported any."""
    reports = [[op["numRowsTotal"] for op in p["stateOperators"]] for p in query.recentProgress]
    return max((sum(r) for r in reports if r), default=0)


def dedup_stream(items: DataFrame, watermark: tuple[str, str] | None = None, url_col: str = "url", hashed: bool = False) -> DataFrame:
    """STR1: first item per url wins. Without a watermark the state is every url ever seen (as
    the batch build); with ``(event_time_col, delay)`` state is bounded by the watermark. With ``hashed`` the state holds the
    SHA-256 of a url (32 bytes) instead of its text; a null url stays null."""
    key = url_col
    if hashed:
        key = "_url_key"
        items = items.withColumn(key, F.unhex(F.sha2(F.col(url_col), 256)))
    if watermark is None:
        out = items.dropDuplicates([key])
    else:
        col, delay = watermark
        out = items.withWatermark(col, delay).dropDuplicatesWithinWatermark([key])
    return out.drop("_url_key") if hashed else out


def _valid_batches(batches, col: str):
    for b in batches:
        vals = b.column(col).to_pylist()
        kept = [[s for s in (v or []) if is_valid_snippet(s)] for v in vals]
        idx = b.schema.get_field_index(col)
        yield b.set_column(idx, col, pa.array(kept, pa.list_(pa.string())))


def clean_stream(items: DataFrame, col: str = "code_snippets") -> DataFrame:
    """STR2: keep valid snippets of each item (stateless pass), then drop items left empty."""
    ship_package(items.sparkSession)
    valid = items.mapInArrow(partial(_valid_batches, col=col), items.schema)
    return valid.where(F.size(col) > 0)


def index_stream(items: DataFrame, index_path: str, checkpoint: str, upsert: bool = False,
                 trigger: dict | None = None, documents: bool = False):
    """STR3: each micro-batch is added (or upserted) as one index commit. The index
    metadata keeps the last batch of each stream, so a replayed batch is not indexed twice and
    any number of streams can feed one index.
    ``documents=True`` takes document rows (title, url, content[, snippet_id]) instead of items."""
    def sink(batch: DataFrame, batch_id: int):
        idx = I.open_index(batch.sparkSession, index_path)
        # the id of the query lives in its checkpoint: another stream, or a fresh checkpoint, has another one
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        done = idx.meta.get("streams", {})
        if batch_id <= done.get(stream, -1):
            return
        idx.meta = dict(idx.meta, streams={**done, stream: batch_id})
        if documents:
            I.add_documents(idx, batch)
        else:
            (I.update_items if upsert else I.add_items)(idx, batch)

    w = items.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


ITEM_STREAM_SCHEMA = T.StructType([T.StructField("title", T.StringType()), T.StructField("url", T.StringType()),
                                   T.StructField("code_snippets", T.ArrayType(T.StringType())),
                                   T.StructField("item_ord", T.LongType())])
