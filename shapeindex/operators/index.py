"""Index build and maintenance (SRC6, IDX1-IDX10).

An index is a folder of immutable segments plus versioned metadata::

    <path>/_meta/v000001.json            kind, tokenizer options, python version, buckets,
                                         live segments, tombstones, terms/stats tables
    <path>/seg-000001-<id>/snippets/     doc_bucket=.../part-*.parquet   (one row per document)
    <path>/seg-000001-<id>/nodes/        doc_bucket=.../                 (pruned AST nodes, QRY7)
    <path>/seg-000001-<id>/postings/     term_bucket=.../                (sorted by term_hash)
    <path>/tomb-000002-<id>/             snippet ids replaced by an upsert
    <path>/terms-…/, stats-…/            document frequencies and collection statistics
    <path>/parsed-stage-…/               parsed rows of a segment, read while it is written

A commit writes new folders and then a new metadata file (``overwrite=False``), so readers see
either the old or the new version. Statistics are kept incrementally: previous values, plus the new segment's, minus
those of replaced documents.
"""
from __future__ import annotations

import json
import sys
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from ..config import DEFAULT_OPTIONS, TITLE_STOP_WORDS, TokenizerOptions
from ..schemas import INDEX_NODE, INDEX_POSTING, SNIPPET, TERM_STAT
from ..sources import store
from . import terms as tok

KINDS = ("structural", "words", "tokens")  # "tokens": a tokenizer given by the caller

_DOC_BUCKET = T.StructField("doc_bucket", T.IntegerType())
TABLE_SCHEMAS = {
    "snippets": T.StructType(SNIPPET.fields + [_DOC_BUCKET]),
    "nodes": T.StructType(INDEX_NODE.fields + [_DOC_BUCKET]),
    "postings": INDEX_POSTING,
}
TERMS_SCHEMA = T.StructType(TERM_STAT.fields + [T.StructField("term_bucket", T.IntegerType())])
STATS_SCHEMA = T.StructType([T.StructField("n_docs", T.LongType()), T.StructField("total_len", T.LongType())])
TOMB_SCHEMA = T.StructType([T.StructField("snippet_id", T.LongType())])


def python_tag() -> str:
    return "%d.%d" % sys.version_info[:2]


def options_to_json(o: TokenizerOptions) -> dict:
    return {"annotate_fields": o.annotate_fields, "include_attributes": o.include_attributes,
            "drop_field_names": sorted(o.drop_field_names), "drop_field_values": sorted(o.drop_field_values),
            "drop_node_names": sorted(o.drop_node_names), "min_depth": o.min_depth, "max_depth": o.max_depth}


def options_from_json(d: dict) -> TokenizerOptions:
    return TokenizerOptions(annotate_fields=d["annotate_fields"], include_attributes=d["include_attributes"],
                            drop_field_names=frozenset(d["drop_field_names"]),
                            drop_field_values=frozenset(d["drop_field_values"]),
                            drop_node_names=frozenset(d["drop_node_names"]), min_depth=d["min_depth"],
                            max_depth=d["max_depth"])


def term_bucket(term_hash, buckets: int):
    return F.pmod(term_hash, F.lit(buckets)).cast("int")


def doc_bucket(snippet_id, buckets: int):
    return F.pmod(F.xxhash64(snippet_id), F.lit(buckets)).cast("int")


@dataclass
class Index:
    spark: SparkSession
    path: str
    meta: dict = field(default_factory=dict)
    tokenizer: tok.TokenizerSpec | None = None

    # ---- metadata
    @property
    def kind(self) -> str:
        return self.meta["kind"]

    @property
    def options(self) -> TokenizerOptions:
        return options_from_json(self.meta["options"])

    @property
    def term_buckets(self) -> int:
        return self.meta["term_buckets"]

    @property
    def doc_buckets(self) -> int:
        return self.meta["doc_buckets"]

    @property
    def version(self) -> int:
        return self.meta["version"]

    def _p(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def _read(self, rel: str, schema=None) -> DataFrame:
        r = self.spark.read
        return (r.schema(schema) if schema is not None else r).parquet(self._p(rel))

    def _union(self, table: str) -> DataFrame | None:
        segs = self.meta["segments"]
        if not segs:
            return None
        return _union_all([self._read(f"{s}/{table}", TABLE_SCHEMAS[table]) for s in segs])

    def segment(self, name: str, table: str) -> DataFrame:
        """One segment's rows of a table, as they were written."""
        return self._read(f"{name}/{table}", TABLE_SCHEMAS[table])

    # ---- live views
    def tombstones(self) -> DataFrame | None:
        t = self.meta.get("tombstones")
        return self._read(t, TOMB_SCHEMA) if t else None

    def _live(self, df: DataFrame | None) -> DataFrame | None:
        tomb = self.tombstones()
        if df is None or tomb is None:
            return df
        return df.join(tomb.select("snippet_id"), "snippet_id", "left_anti")

    def snippets(self) -> DataFrame:
        df = self._live(self._union("snippets"))
        if df is None:
            return self.spark.createDataFrame([], SNIPPET)
        return df

    def nodes(self) -> DataFrame:
        return self._live(self._union("nodes"))

    def postings(self, live: bool = True) -> DataFrame:
        df = self._union("postings")
        return self._live(df) if live else df

    def terms(self) -> DataFrame:
        return self._read(self.meta["terms"], TERMS_SCHEMA)

    def stats(self) -> DataFrame:
        return self._read(self.meta["stats"], STATS_SCHEMA)

    def stats_row(self) -> tuple[int, int]:
        if "n_docs" in self.meta:  # recorded at commit time
            return int(self.meta["n_docs"]), int(self.meta["total_len"])
        r = self.stats().first()
        return (int(r["n_docs"]), int(r["total_len"])) if r else (0, 0)


def _union_all(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def _fresh(kind: str, version: int) -> str:
    """A folder name no other attempt can use: a crashed or concurrent writer leaves only
    unreferenced folders behind; the metadata write (overwrite disabled) decides who commits."""
    return f"{kind}-{version:06d}-{uuid.uuid4().hex[:8]}"


def stored_beside(idx: Index, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a folder of its own under the index's, and read back."""
    stage = idx._p(_fresh(f"{name}-stage", idx.version + 1))
    df.write.parquet(stage)
    return idx.spark.read.schema(df.schema).parquet(stage)


def _meta_dir(path: str) -> str:
    return f"{path.rstrip('/')}/_meta"


def create_index(spark: SparkSession, path: str, kind: str = "structural",
                 options: TokenizerOptions = DEFAULT_OPTIONS, term_buckets: int | None = None,
                 doc_buckets: int | None = None, tokenizer: tok.TokenizerSpec | None = None) -> Index:
    """SRC6: create an empty index; an existing one is an error.

    With ``tokenizer`` (UDF1) documents and queries are cut into terms by it; its name and version stay with the index.

    Bucket counts fix the hash layout of postings/terms (``term_buckets``) and of
    snippets/nodes (``doc_buckets``). ``None`` sizes them at the first build from Spark's size
    estimate of that input (``choose_buckets``); give them explicitly for an index that will grow
    far beyond its first batch (e.g. fed by a stream)."""
    if tokenizer is not None:
        kind = "tokens"
    if kind not in KINDS or (kind == "tokens") != (tokenizer is not None):
        raise ValueError(f"kind is structural or words, or a tokenizer is given; not {kind!r}")
    if store.exists(spark, _meta_dir(path)):
        raise RuntimeError(f"Index already exists at {path}")
    meta = {"version": 0, "kind": kind, "options": options_to_json(options), "python": python_tag(),
            "term_buckets": term_buckets, "doc_buckets": doc_buckets, "segments": [],
            "tombstones": None, "terms": None, "stats": None, "next_batch_seq": 0, "next_snippet_id": 0}
    if tokenizer is not None:
        meta["tokenizer"] = {"name": tokenizer.name, "version": tokenizer.version}
    store.mkdirs(spark, _meta_dir(path))
    idx = Index(spark, path, meta)
    _commit(idx, meta, new_segment=None, new_tombstones=None)
    return open_index(spark, path, tokenizer)


def open_index(spark: SparkSession, path: str, tokenizer: tok.TokenizerSpec | None = None) -> Index:
    """SRC6: open the latest version; a missing index is an error. A structural index built by
    another Python version is refused (term text depends on the grammar version). So is an index of another tokenizer or
    another version of it than ``tokenizer`` or, without one, the registered tokenizer of the index's name."""
    names = [n for n in store.list_names(spark, _meta_dir(path)) if n.endswith(".json")]
    if not names:
        raise RuntimeError(f"There is no index at {path}")
    meta = store.read_json(spark, f"{_meta_dir(path)}/{names[-1]}")
    if meta["kind"] == "structural" and meta["python"] != python_tag():
        raise RuntimeError(f"index built with Python {meta['python']}, this is {python_tag()}")
    if meta["kind"] == "tokens":
        built = meta["tokenizer"]
        tokenizer = tokenizer or tok.TOKENIZERS.get(built["name"])
        if tokenizer is None or (tokenizer.name, tokenizer.version) != (built["name"], built["version"]):
            known = "no tokenizer of that name" if tokenizer is None else f"{tokenizer.name} {tokenizer.version}"
            raise RuntimeError(f"index built with tokenizer {built['name']} {built['version']}, there is {known}")
    return Index(spark, path, meta, tokenizer if meta["kind"] == "tokens" else None)


def _commit(idx: Index, meta: dict, new_segment: str | None, new_tombstones: DataFrame | None) -> Index:
    """Publish a new metadata version with statistics maintained incrementally.

    df and (N, total length) of the new version = previous values + the new segment's
    contribution - the contribution of documents replaced now. Replaced documents' terms come from
    the ``nodes`` table (partitioned by document), so a commit costs O(vocabulary + change),
    never a scan of all postings.
    """
    spark = idx.spark
    prev = Index(spark, idx.path, dict(meta))
    v = meta["version"] + 1
    meta = dict(meta, version=v)
    n_docs, total_len = prev.stats_row() if meta.get("stats") else (0, 0)
    deltas = [prev.terms().select("term_hash", "df", "max_tf", "min_dl")] if meta.get("terms") else []
    if new_segment:
        seg_post = prev._read(f"{new_segment}/postings", INDEX_POSTING)
        deltas.append(term_stats(seg_post))
        r = prev._read(f"{new_segment}/snippets", TABLE_SCHEMAS["snippets"]).agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t"), F.max("snippet_id").alias("m")).first()
        n_docs, total_len = n_docs + int(r["n"]), total_len + int(r["t"])
        if r["m"] is not None:
            meta["next_snippet_id"] = max(meta.get("next_snippet_id", 0), int(r["m"]) + 1)
        meta["segments"] = list(meta["segments"]) + [new_segment]
    if new_tombstones is not None:
        fresh = new_tombstones.select("snippet_id").distinct()
        old_tomb = prev.tombstones()
        if old_tomb is not None:
            fresh = fresh.join(old_tomb.select("snippet_id"), "snippet_id", "left_anti")
        tname = _fresh("tomb", v)
        all_tomb = fresh if old_tomb is None else fresh.unionByName(old_tomb.select("snippet_id"))
        all_tomb.write.parquet(idx._p(tname))
        if prev.meta["segments"]:
            gone = prev.snippets().join(fresh, "snippet_id", "left_semi")
            r = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
            n_docs, total_len = n_docs - int(r["n"]), total_len - int(r["t"])
            if prev.kind == "structural":
                gone_terms = (prev.nodes().where(F.col("term_hash").isNotNull()).join(fresh, "snippet_id", "left_semi")
                              .select("snippet_id", "term_hash").distinct())
            else:
                gone_terms = prev.postings().join(fresh, "snippet_id", "left_semi").select("snippet_id", "term_hash")
            deltas.append(gone_terms.groupBy("term_hash").agg(
                (-F.count(F.lit(1))).cast("long").alias("df"), F.lit(None).cast("int").alias("max_tf"),
                F.lit(None).cast("int").alias("min_dl")))
        meta["tombstones"] = tname
    meta["n_docs"], meta["total_len"] = n_docs, total_len
    stats = spark.createDataFrame([(n_docs, total_len)], "n_docs long, total_len long")
    sname, tname_terms = _fresh("stats", v), _fresh("terms", v)
    stats.coalesce(1).write.parquet(idx._p(sname))
    meta["stats"] = sname
    if deltas:
        terms_df = (_union_all(deltas).groupBy("term_hash")
                    .agg(F.sum("df").cast("long").alias("df"), F.max("max_tf").alias("max_tf"),
                         F.min("min_dl").alias("min_dl"))
                    .where(F.col("df") > 0))
    else:
        terms_df = spark.createDataFrame([], TERM_STAT)
    terms_df = terms_df.withColumn("term_bucket", term_bucket(F.col("term_hash"), meta["term_buckets"]))
    (terms_df.repartitionByRange("term_bucket", "term_hash").sortWithinPartitions("term_hash")
     .write.options(**BLOOM).partitionBy("term_bucket").parquet(idx._p(tname_terms)))
    meta["terms"] = tname_terms
    store.write_text(spark, f"{_meta_dir(idx.path)}/v{v:06d}.json", json.dumps(meta), overwrite=False)
    idx.meta = meta
    return idx


# --------------------------------------------------------------------------- IDX1-IDX3

def build_postings(term_rows: DataFrame) -> DataFrame:
    """IDX1: (term_hash, snippet_id, tf, positions) from a term stream (snippet_id, pos, term_hash)."""
    return (term_rows.groupBy("term_hash", "snippet_id")
            .agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")))


def index_stats(snippets: DataFrame) -> DataFrame:
    """IDX2: N (zero-term documents included), total length and average length."""
    return snippets.agg(F.count(F.lit(1)).cast("long").alias("n_docs"),
                        F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_len"),
                        F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def term_stats(postings: DataFrame) -> DataFrame:
    """IDX3 plus the inputs of a per-term score upper bound: (term_hash, df, max_tf, min_dl)."""
    return postings.groupBy("term_hash").agg(F.count(F.lit(1)).cast("long").alias("df"),
                                             F.max("tf").cast("int").alias("max_tf"),
                                             F.min("dl").cast("int").alias("min_dl"))


def doc_freq(postings: DataFrame) -> DataFrame:
    """IDX3: document frequency per term (postings are distinct per (term, snippet))."""
    return postings.groupBy("term_hash").agg(F.count(F.lit(1)).cast("long").alias("df"))


# --------------------------------------------------------------------------- documents in

def _numbered(idx: Index, docs: DataFrame) -> DataFrame:
    """``docs`` with ``snippet_id``: the index's next numbers in the order of partitions and rows.

    The rows are written once, so every later pass sees the same numbers; only counts per partition are summed up (one
    row a partition). No text is hashed, compared or shuffled: rows that are equal, or differ in a null only, are documents of
    their own like any others.
    """
    spark = idx.spark
    stage = idx._p(_fresh("docs-stage", idx.version + 1))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    docs.withColumns({"_part": F.spark_partition_id(), "_row": row}).write.parquet(stage)
    docs = spark.read.parquet(stage)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = docs.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))
    first = idx.meta.get("next_snippet_id", 0)
    if first > (1 << 62):
        raise ValueError("ids given by the caller leave no room for further ones; give the ids of this batch too")
    numbered = docs.join(F.broadcast(starts), "_part").withColumn("snippet_id", F.col("_before") + F.col("_row") + F.lit(first).cast("long"))
    return numbered.drop("_part", "_row", "_before")


def _with_defaults(idx: Index, docs: DataFrame, batch_seq: int) -> DataFrame:
    cols = docs.columns
    if "batch_seq" not in cols:
        docs = docs.withColumn("batch_seq", F.lit(batch_seq).cast("long"))
    if "ord" not in cols:
        docs = docs.withColumn("ord", F.lit(0))
    if "snippet_id" not in cols:
        docs = _numbered(idx, docs.select("batch_seq", "ord", "title", "url", "content"))
    return docs.select(F.col("snippet_id").cast("long"), F.col("batch_seq").cast("long"),
                       F.col("ord").cast("int"), "title", "url", "content")


#: Nodes, terms (with repeats) and documents that a task sorts and writes; there are more tasks as they grow.
TASK_NODES, TASK_TERMS, TASK_DOCS = 4_000_000, 1_000_000, 250_000


def _write_tasks(spark: SparkSession, rows: int, per_task: int) -> int | None:
    """Tasks for ``rows``: as many as keep a task at ``per_task`` rows; of fewer rows, one a core. None where rows are very few:
    Spark's own settings do."""
    cores = spark.sparkContext.defaultParallelism
    return max(-(-rows // per_task), min(cores, -(-rows // (per_task // 16)))) if rows > per_task // 16 else None


def _write_segment(idx: Index, seg: str, snippets: DataFrame, node_rows: DataFrame | None,
                   postings: DataFrame, doc_tasks: int | None = None, posting_tasks: int | None = None) -> None:
    """``node_rows`` has a row per node, or per document with an array ``nodes``, which is sent whole and opened after that.
    Without a number of tasks Spark's own settings decide."""
    tb, dbk = idx.term_buckets, idx.doc_buckets
    by_doc = ([doc_tasks] if doc_tasks else []) + ["doc_bucket", "snippet_id"]
    by_term = ([posting_tasks] if posting_tasks else []) + ["term_bucket", "term_hash", "snippet_id"]
    # range partitioning on (bucket, id): tasks write contiguous id ranges, few files per bucket; the order starts with the
    # bucket, or the writer would sort once more
    (snippets.withColumn("doc_bucket", doc_bucket(F.col("snippet_id"), dbk))
     .repartitionByRange(*by_doc).sortWithinPartitions("doc_bucket", "snippet_id")
     .write.partitionBy("doc_bucket").parquet(idx._p(f"{seg}/snippets")))
    if node_rows is not None:
        dealt = node_rows.withColumn("doc_bucket", doc_bucket(F.col("snippet_id"), dbk)).repartitionByRange(*by_doc)
        if "nodes" in dealt.columns:
            dealt = dealt.select("snippet_id", "doc_bucket", F.inline("nodes"))
        (dealt.select(*[f.name for f in INDEX_NODE.fields], "doc_bucket").sortWithinPartitions("doc_bucket", "snippet_id", "pre")
         .write.partitionBy("doc_bucket").parquet(idx._p(f"{seg}/nodes")))
    # range partitioning on (bucket, term, snippet) splits a hot term over several tasks
    (postings.withColumn("term_bucket", term_bucket(F.col("term_hash"), tb))
     .repartitionByRange(*by_term)
     .sortWithinPartitions("term_bucket", "term_hash", "snippet_id")
     .write.options(**BLOOM).partitionBy("term_bucket").parquet(idx._p(f"{seg}/postings")))


BUCKET_BYTES = 128 << 20
#: A Bloom filter of terms per row group: a scan for few terms skips the groups that have none of them.
BLOOM = {"parquet.bloom.filter.enabled#term_hash": "true", "parquet.bloom.filter.expected.ndv#term_hash": "100000"}


def _pow2_at_least(x: float) -> int:
    n = 1
    while n < x:
        n <<= 1
    return n


def _size_estimate(df: DataFrame) -> int:
    """The optimizer's size estimate in bytes (no job); 0 when unknown."""
    try:
        est = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # no JVM view of the plan
        return 0
    return 0 if est >= (1 << 63) - 1 else est  # Long.MaxValue: no estimate (e.g. local Python data)


def choose_buckets(docs: DataFrame) -> tuple[int, int]:
    """(term_buckets, doc_buckets) for about ``BUCKET_BYTES`` per bucket of this input, from
    the optimizer's size estimate (no job is run)."""
    n = _pow2_at_least(_size_estimate(docs) / BUCKET_BYTES)
    return max(64, n), max(16, n)


DEDUPE_MIN_RATIO = 0.05  # estimated share of duplicate texts from which parsing distinct texts pays
DEDUPE_MIN_BYTES = 1 << 30  # below this input size the estimate itself is not worth a job


def _parse_once_per_text(docs: DataFrame, options: TokenizerOptions, dedupe: bool | None) -> DataFrame:
    """The parse pass over ``docs``, run once per distinct text when duplicates are common.

    Parsing costs far more CPU per byte than shuffling the same bytes, so with ``dedupe=None``
    one aggregate estimates the duplicate share (HyperLogLog on a content hash); from
    ``DEDUPE_MIN_RATIO`` on (inputs from ``DEDUPE_MIN_BYTES``), distinct texts are parsed and the results joined back on a 96-bit
    key (two hashes and the length). A text repeated millions of times (empty files) is a skewed
    join key that AQE's skew join splits.
    """
    key = [F.xxhash64("content").alias("_h1"), F.hash("content").alias("_h2"),
           F.coalesce(F.length("content"), F.lit(-1)).alias("_len")]
    if dedupe is None and _size_estimate(docs) >= DEDUPE_MIN_BYTES:  # small inputs parse fast anyway
        r = docs.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("content")).alias("d")).first()
        dedupe = r["n"] > 0 and 1 - r["d"] / r["n"] >= DEDUPE_MIN_RATIO
    if not dedupe:
        return tok.parse_code(docs, options=options, keep_nodes="index")
    keyed = docs.select("*", *key)
    texts = keyed.select("_h1", "_h2", "_len", "content").dropDuplicates(["_h1", "_h2", "_len"])
    parsed = tok.parse_code(texts, options=options, keep_nodes="index", id_col="_h1").drop("content")
    return keyed.join(parsed, ["_h1", "_h2", "_len"]).drop("_h1", "_h2", "_len")


def _build_segment(idx: Index, docs: DataFrame, seq: int, dedupe: bool | None = None) -> tuple[str, int, int]:
    """Tokenize ``docs`` and write them as a new segment; returns (segment, accepted, rejected)."""
    docs = _with_defaults(idx, docs, seq)
    if idx.meta.get("term_buckets") is None or idx.meta.get("doc_buckets") is None:
        tb, dbk = choose_buckets(docs)
        idx.meta = dict(idx.meta, term_buckets=idx.meta.get("term_buckets") or tb,
                        doc_buckets=idx.meta.get("doc_buckets") or dbk)
    seg = _fresh("seg", idx.version + 1)
    if idx.kind == "structural":
        # one Python pass feeds three outputs: its result is written once, and each output reads its own columns of it
        parsed = _parse_once_per_text(docs, idx.options, dedupe).drop("reason")
        parsed = stored_beside(idx, parsed.withColumn("content", F.when(F.col("valid"), F.col("content"))), "parsed")
        counts = parsed.agg(F.count_if("valid").alias("a"), F.count_if(~F.col("valid")).alias("r"),
                            F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        ok = parsed.where("valid")
        snippets = ok.select("snippet_id", "batch_seq", "ord", "title", "url", "content", "dl", "n_nodes")
        postings = ok.select("snippet_id", "batch_seq", "dl", F.inline("postings"))
        _write_segment(idx, seg, snippets, ok.select("snippet_id", "nodes"), postings,
                       _write_tasks(idx.spark, counts["n"], TASK_NODES), _write_tasks(idx.spark, counts["t"], TASK_TERMS))
        return seg, int(counts["a"]), int(counts["r"])
    if idx.kind == "tokens":
        return _build_tokens(idx, seg, docs)
    words = tok.spread(docs, "snippet_id").withColumn("words", tok.word_array(F.col("content")))
    words = words.withColumn("dl", F.size("words")).withColumn("n_nodes", F.lit(None).cast("int"))
    snippets = words.select("snippet_id", "batch_seq", "ord", "title", "url", "content", "dl", "n_nodes")
    # the map-side partial aggregate combines each document's words before the shuffle
    postings = (words.select("snippet_id", "batch_seq", "dl", F.posexplode("words").alias("pos", "term"))
                .groupBy("snippet_id", "batch_seq", "dl", F.xxhash64("term").alias("term_hash"))
                .agg(F.count(F.lit(1)).cast("int").alias("tf"),
                     F.sort_array(F.collect_list(F.col("pos").cast("int"))).alias("positions")))
    _write_segment(idx, seg, snippets, None, postings)
    accepted = idx._read(f"{seg}/snippets", TABLE_SCHEMAS["snippets"]).count()
    return seg, accepted, 0


def _build_tokens(idx: Index, seg: str, docs: DataFrame) -> tuple[str, int, int]:
    """A segment of the index's own tokenizer: postings first, then documents with the lengths read back from them.
    Texts without a term are documents of length 0, null texts are rejected."""
    if idx.tokenizer.postings is not None:
        return _build_combined(idx, seg, docs)
    per_doc = build_postings(tok.run_tokenizer(idx.tokenizer, docs))
    per_doc = per_doc.withColumn("dl", F.sum("tf").over(Window.partitionBy("snippet_id")).cast("int"))
    own = docs.select("snippet_id", "batch_seq")
    stage = idx._p(_fresh("postings-stage", idx.version + 1))
    per_doc.write.parquet(stage)  # read for the postings and for the lengths
    per_doc = idx.spark.read.parquet(stage)
    postings = per_doc.join(own, "snippet_id").select("snippet_id", "batch_seq", "dl", "term_hash", "tf", "positions")
    lengths = per_doc.groupBy("snippet_id").agg(F.max("dl").alias("dl"))
    kept = docs.where(F.col("content").isNotNull()).join(lengths, "snippet_id", "left")
    snippets = kept.withColumn("dl", F.coalesce("dl", F.lit(0))).withColumn("n_nodes", F.lit(None).cast("int"))
    _write_segment(idx, seg, snippets.select(*[f.name for f in SNIPPET.fields]), None, postings)
    accepted = idx._read(f"{seg}/snippets", TABLE_SCHEMAS["snippets"]).count()
    return seg, accepted, docs.where(F.col("content").isNull()).count()


def _build_combined(idx: Index, seg: str, docs: DataFrame) -> tuple[str, int, int]:
    """``_build_tokens`` where the tokenizer gives a text's terms in its row: that pass is written once and each output reads its own
    columns of it. A document without an id has no terms."""
    made = idx.tokenizer.postings(docs)
    own = F.col("snippet_id").isNotNull()
    made = made.withColumn("dl", F.when(own, F.col("n_terms")).otherwise(F.lit(0)).cast("int")).withColumn("postings", F.when(own, F.col("postings"))).drop("n_terms")
    made = stored_beside(idx, made, "tokens")
    ok = made.where(F.col("content").isNotNull())
    counts = made.agg(F.count("content").alias("a"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    snippets = ok.withColumn("n_nodes", F.lit(None).cast("int")).select(*[f.name for f in SNIPPET.fields])
    _write_segment(idx, seg, snippets, None, ok.select("snippet_id", "batch_seq", "dl", F.inline("postings")),
                   _write_tasks(idx.spark, counts["n"], TASK_DOCS), _write_tasks(idx.spark, counts["t"], TASK_TERMS))
    return seg, int(counts["a"]), int(counts["n"] - counts["a"])


def add_documents(idx: Index, docs: DataFrame, batch_seq: int | None = None,
                  dedupe: bool | None = None) -> tuple[int, int]:
    """IDX4 (bulk): invalid documents are not added; returns (accepted, rejected).

    ``docs`` has ``title, url, content`` and optionally ``snippet_id, batch_seq, ord``. Ids given by the caller must be
    new to the index; without them repeats, within a batch or between batches, are documents of their own.
    ``dedupe``: parse each distinct text once (None: decide from the estimated duplicate share).
    """
    seq = idx.meta.get("next_batch_seq", 0) if batch_seq is None else batch_seq
    seg, accepted, rejected = _build_segment(idx, docs, seq, dedupe)
    meta = dict(idx.meta, next_batch_seq=max(seq + 1, idx.meta.get("next_batch_seq", 0)))
    _commit(idx, meta, new_segment=seg, new_tombstones=None)
    return accepted, rejected


def explode_items(items: DataFrame, batch_seq: int = 0) -> DataFrame:
    """EXT12: one document per snippet of a section item; title and url repeated: (title, url, ord, content, batch_seq).
    ``ord`` is the snippet's position in its item. The index numbers the documents when it takes them."""
    return (items.select("title", "url", F.posexplode("code_snippets").alias("ord", "content"))
            .withColumn("batch_seq", F.lit(batch_seq).cast("long")))


def add_items(idx: Index, items: DataFrame) -> tuple[int, int]:
    """IDX5: every snippet of every item; invalid snippets skipped."""
    seq = idx.meta.get("next_batch_seq", 0)
    return add_documents(idx, explode_items(items, seq), batch_seq=seq)


def update_items(idx: Index, items: DataFrame) -> tuple[int, int]:
    """IDX6 (upsert): previously committed documents with a url of the batch are replaced by
    all snippets of the batch, in one commit. Invalid snippets are rejected and counted."""
    seq = idx.meta.get("next_batch_seq", 0)
    replaced = (idx.snippets().select("snippet_id", "url")
                .join(items.select("url").distinct(), "url", "left_semi").select("snippet_id"))
    stage = idx._p(_fresh("tomb-stage", idx.version + 1))
    replaced.write.parquet(stage)  # fixed before the new rows exist
    seg, accepted, rejected = _build_segment(idx, explode_items(items, seq), seq)
    meta = dict(idx.meta, next_batch_seq=seq + 1)
    _commit(idx, meta, new_segment=seg, new_tombstones=idx.spark.read.schema(TOMB_SCHEMA).parquet(stage))
    return accepted, rejected


def compact_index(idx: Index) -> Index:
    """Merge all segments into one, dropping replaced documents, and clear the tombstones.

    Same layout as a fresh build (range-partitioned, bucketed, sorted), one commit; statistics
    are copied since they already describe the live rows. Queries then scan one folder per
    table instead of one per micro-batch.
    """
    if len(idx.meta["segments"]) <= 1 and not idx.meta.get("tombstones"):
        return idx
    seg = _fresh("seg", idx.version + 1)
    cols = [f.name for f in SNIPPET.fields]
    node_rows = idx.nodes().select(*[f.name for f in INDEX_NODE.fields]) if idx.kind == "structural" else None
    postings = idx.postings(live=True).select("term_hash", "snippet_id", "batch_seq", "tf", "dl", "positions")
    _write_segment(idx, seg, idx.snippets().select(*cols), node_rows, postings)
    v = idx.version + 1
    meta = dict(idx.meta, version=v, segments=[seg], tombstones=None)
    store.write_text(idx.spark, f"{_meta_dir(idx.path)}/v{v:06d}.json", json.dumps(meta), overwrite=False)
    idx.meta = meta
    return idx


def replace_by_key(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """IDX6 relational core: rows of ``existing`` whose key occurs in the batch are replaced by
    all batch rows with that key (anti-join on the distinct batch keys + union)."""
    keep = existing.join(batch.select(key).distinct(), key, "left_anti").withColumn("is_new", F.lit(False))
    return keep.unionByName(batch.withColumn("is_new", F.lit(True)))


def df_quantiles(idx: Index) -> DataFrame:
    """Skew report: exact df percentiles (linear interpolation) and the largest df of the index."""
    t = idx.terms()
    return t.agg(F.count(F.lit(1)).cast("long").alias("n_terms"),
                 F.percentile("df", 0.5).alias("p50"), F.percentile("df", 0.9).alias("p90"),
                 F.percentile("df", 0.99).alias("p99"), F.max("df").alias("max_df"))


def index_len(idx: Index) -> int:
    """IDX7: live document count (replaced documents excluded)."""
    return idx.stats_row()[0]


def iter_documents(idx: Index, limit: int | None = None) -> DataFrame:
    """IDX8: all live documents in index order, optionally the first ``limit``."""
    df = idx.snippets().select("snippet_id", "batch_seq", "ord", "title", "url", "content")
    if limit is not None:
        return df.orderBy("batch_seq", "ord", "snippet_id").limit(limit)
    return df


def running_sum_before(df: DataFrame, order_cols, value_col: str, n_parts: int | None = None) -> DataFrame:
    """Exclusive running sum in a global order without one window partition holding every row.

    Rows are range-partitioned on the order, summed inside each range, the (n_parts) range totals
    are prefix-summed and their offsets (exactly n_parts rows: a proven bound) are broadcast back.
    The ranged rows are checkpointed so both uses read the same partitioning.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    n = n_parts or max(1, df.sparkSession.sparkContext.defaultParallelism)
    r = df.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id()).checkpoint()
    local = r.withColumn("_local", F.coalesce(F.sum(value_col).over(
        Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = r.groupBy("_pid").agg(F.sum(value_col).alias("_t"))
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_pid", "_off")
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(value_col + "_before", (F.col("_local") + F.col("_off")).cast("long"))
            .drop("_pid", "_local", "_off"))


def admit_within_budget(sizes: DataFrame, max_bytes: int, order_col: str = "seq",
                        size_col: str = "bytes", key_cols=("repo",)) -> DataFrame:
    """IDX9: admit entries in order while the bytes admitted *before* each one are <= max_bytes.

    ``sizes`` has one row per repository (per-file bytes are aggregated before); the running
    total is the distributed two-level prefix sum above.
    """
    ran = running_sum_before(sizes, [order_col, *key_cols], size_col)
    return ran.withColumnRenamed(size_col + "_before", "bytes_before").where(F.col("bytes_before") <= max_bytes)


def title_terms(snippets: DataFrame) -> DataFrame:
    """IDX10: title words, lower-cased, one-letter words and stop words removed."""
    words = F.regexp_extract_all(F.lower(F.col("title")), F.lit(r"\w+(\.?\w+)*"), 0)
    return (snippets.select("snippet_id", F.posexplode(words).alias("pos", "word"))
            .where((F.length("word") > 1) & ~F.col("word").isin(sorted(TITLE_STOP_WORDS))))
