"""Structural terms (TOK1-TOK11) and the pluggable tokenizer surface (UDF1).

One ``mapInArrow`` pass per text calls Python's own parser (``functions.pyast``); the pass keeps
row count and partitioning (no shuffle) and appends per-snippet columns plus two nested arrays:
``nodes`` (preorder node records) and ``postings`` (per-term frequency and positions, i.e. the
map-side combine of the term stream). Everything downstream is DataFrame code.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from typing import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_OPTIONS, TokenizerOptions
from ..functions import pyast
from ..functions.renewal import renewed
from ..schemas import NODE, PARSE_FIELDS
from ..session import ship_package

Tokenizer = Callable[[DataFrame], DataFrame]

NODE_KEEP = ("all", "index", "terms", "none")

_NODE_ARROW = pa.struct([
    ("pre", pa.int32()), ("size", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()),
    ("height", pa.int32()), ("node_type", pa.string()), ("lineno", pa.int32()),
    ("term_hash", pa.int64()), ("pos", pa.int32()), ("first_term_hash", pa.int64()),
    ("term", pa.string()), ("term_check", pa.int64()),
])
_INDEX_FIELDS = ("pre", "size", "lineno", "term_hash", "first_term_hash")
_INDEX_NODE_ARROW = pa.struct([f for f in _NODE_ARROW if f.name in _INDEX_FIELDS])
_TYPE_NODE_ARROW = pa.struct([_NODE_ARROW.field("node_type")])
_POSTING_ARROW = pa.struct([("term_hash", pa.int64()), ("tf", pa.int32()),
                            ("positions", pa.list_(pa.int32()))])


def _line_nodes(p: pyast.Parsed) -> list:
    """Nodes line matching (QRY7) needs: every node that can be matched (it has a first term),
    and every node whose line number is new below its nearest line-numbered ancestor. A node
    repeating that ancestor's line is dropped unless a line-less node that can be matched (e.g.
    ``comprehension``) lies between them, so every matched subtree keeps its exact line set."""
    ln, ft, par = p.lineno, p.first_term_hash, p.parent
    n = len(ln)
    carry_line = [None] * n  # line of the nearest node at or above with a line number
    carry_gap = [False] * n  # a matchable line-less node lies below that line-numbered node
    keep = []
    for i in range(n):
        q, line, own = par[i], ln[i], ft[i] is not None
        anc_line, gap = (carry_line[q], carry_gap[q]) if q >= 0 else (None, False)
        if line is not None:
            carry_line[i] = line
        else:
            carry_line[i], carry_gap[i] = anc_line, gap or own
        if own or (line is not None and (line != anc_line or gap)):
            keep.append(i)
    return keep


OUTPUT_SLICE_BYTES = 8 << 20  # source bytes per output batch: node arrays are several times larger


def _slices(texts: list, limit: int):
    """Row ranges of about ``limit`` text bytes (at least one row each)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _parse_batches(batches, text_col: str, opts: TokenizerOptions, keep: str, with_text: bool,
                   lstrip: bool, slice_bytes: int = OUTPUT_SLICE_BYTES, hashes: bool = True, types_only: bool = False):
    def run(whole):
        all_texts = whole.column(text_col).to_pylist()
        for lo, hi in _slices(all_texts, slice_bytes):
            yield _parse_slice(whole.slice(lo, hi - lo), all_texts[lo:hi], opts, keep, with_text, lstrip, hashes, types_only)

    yield from renewed(run, batches, lambda b: pc.sum(pc.binary_length(b.column(text_col))).as_py() or 0)


def _parse_slice(batch, texts: list, opts: TokenizerOptions, keep: str, with_text: bool, lstrip: bool,
                 hashes: bool = True, types_only: bool = False):
    valid, reason, n_nodes, dl = [], [], [], []
    node_arrow = _TYPE_NODE_ARROW if types_only else _INDEX_NODE_ARROW if keep == "index" else _NODE_ARROW
    cols = {f: [] for f in node_arrow.names}
    taken = [f for f in node_arrow.names if f not in ("pre", "term")]
    node_offsets = [0]
    p_hash, p_tf, p_pos, p_pos_offsets, post_offsets = [], [], [], [0], [0]
    lean = (keep == "index" or keep == "none" and hashes) and not with_text and pyast.has_index_records(opts)
    for text in texts:
        parsed = counted = records = None
        if text is None:
            valid.append(False), reason.append("null text"), n_nodes.append(None), dl.append(None)
        else:
            if lstrip:
                text = text.lstrip()
            try:
                if keep == "none" and not hashes:
                    counted = pyast.counts(text, opts)
                elif types_only:
                    counted = pyast.node_types(text, opts, terms_only=keep == "terms")
                elif lean:
                    records = pyast.index_records(text, opts, lines=keep == "index")
                else:
                    parsed = pyast.analyze(text, opts, with_text=with_text, hashes=hashes)
            except pyast.PARSE_ERRORS as e:  # one bad row must not fail the job
                valid.append(False)
                reason.append(f"{type(e).__name__}: {e}")
                n_nodes.append(None)
                dl.append(None)
        if counted is not None:
            valid.append(True), reason.append(None), n_nodes.append(counted[0]), dl.append(counted[1])
            if types_only:
                cols["node_type"].extend(counted[2])
        by_term: dict = {}
        if records is not None:
            valid.append(True), reason.append(None), n_nodes.append(records[0]), dl.append(records[1])
            for name, values in zip(_INDEX_FIELDS, records[2], strict=True):
                cols[name].extend(values)
            by_term = records[3]
        if parsed is not None:
            n = len(parsed)
            valid.append(True), reason.append(None), n_nodes.append(n), dl.append(parsed.n_terms)
            if keep == "all":
                idx = range(n)
            elif keep == "terms":
                idx = parsed.term_at
            elif keep == "index":
                idx = _line_nodes(parsed)
            else:
                idx = ()
            if idx:
                cols["pre"].extend(idx)
                for name in taken:
                    src = getattr(parsed, name)
                    cols[name].extend(src if keep == "all" else [src[i] for i in idx])
                if "term" in cols:
                    cols["term"].extend([parsed.term_text[i] for i in idx] if with_text else [None] * len(idx))
            if hashes:
                for k, i in enumerate(parsed.term_at):
                    by_term.setdefault(parsed.term_hash[i], []).append(k)
        for h, positions in by_term.items():
            p_hash.append(h)
            p_tf.append(len(positions))
            p_pos.extend(positions)
            p_pos_offsets.append(len(p_pos))
        node_offsets.append(len(cols["node_type" if types_only else "pre"]))
        post_offsets.append(len(p_hash))
    node_values = pa.StructArray.from_arrays(
        [pa.array(cols[f.name], type=f.type) for f in node_arrow], fields=list(node_arrow))
    positions = pa.ListArray.from_arrays(pa.array(p_pos_offsets, pa.int32()), pa.array(p_pos, pa.int32()))
    post_values = pa.StructArray.from_arrays(
        [pa.array(p_hash, pa.int64()), pa.array(p_tf, pa.int32()), positions],
        fields=list(_POSTING_ARROW))
    arrays = list(batch.columns) + [
        pa.array(valid, pa.bool_()), pa.array(reason, pa.string()), pa.array(n_nodes, pa.int32()),
        pa.array(dl, pa.int32()),
        pa.ListArray.from_arrays(pa.array(node_offsets, pa.int32()), node_values),
        pa.ListArray.from_arrays(pa.array(post_offsets, pa.int32()), post_values),
    ]
    names = list(batch.schema.names) + ["valid", "reason", "n_nodes", "dl", "nodes", "postings"]
    return pa.RecordBatch.from_arrays(arrays, names=names)


SPREAD_MAX_BYTES = 8 << 30
SPREAD_TASK_BYTES = 1 << 20  # of the estimate, which is near the compressed size: a task's share does not grow with the input


def spread(df: DataFrame, key: str | None = None, factor: int = 2) -> DataFrame:
    """Give a CPU-heavy Python pass at least ``factor`` tasks per core on a small input.

    A small input (one parquet row group, a short query list; at most ``SPREAD_MAX_BYTES`` by
    the optimizer's estimate) is hash-partitioned by ``key``, which stays deterministic when a
    task is retried. Large inputs keep their splits: they already have many, and moving them
    only for parallelism would cost a shuffle of the whole corpus. There are more tasks as the input
    grows, so what a task sorts or groups afterwards (a document's words, exploded) fits in memory.
    """
    if df.isStreaming:
        return df
    want = df.sparkSession.sparkContext.defaultParallelism * factor
    try:  # the plan's size estimate: no job is run (asking for the partitions would run the input's stages)
        est = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # no JVM view of the plan (e.g. a remote session): leave the plan alone
        return df
    known = est < (1 << 63) - 1  # Long.MaxValue means "no estimate" (e.g. local Python data)
    if known and est > SPREAD_MAX_BYTES:
        return df
    if known:
        want = max(want, -(-est // SPREAD_TASK_BYTES))
    return df.repartition(want, key) if key and key in df.columns else df.repartition(want)


def parse_code(df: DataFrame, text_col: str = "content", options: TokenizerOptions = DEFAULT_OPTIONS,
               keep_nodes: str = "all", with_text: bool = False, lstrip: bool = False,
               id_col: str | None = "snippet_id", hashes: bool = True, types_only: bool = False) -> DataFrame:
    """TOK1-TOK9, TOK11: parse every text once, keep all input columns, append
    ``valid, reason, n_nodes, dl, nodes, postings``.

    ``keep_nodes`` chooses the node records kept in ``nodes``: ``all``; ``index`` (the nodes line
    matching needs, see ``_line_nodes``); ``terms``; ``none``.
    ``lstrip`` strips leading whitespace first (query preparation, QRY1). ``hashes=False`` skips
    term hashing (status columns only: ``postings`` stays empty, hashes are null). ``types_only`` keeps of a node
    record its ``node_type`` and needs ``hashes=False``.
    """
    assert keep_nodes in NODE_KEEP
    assert not types_only or (not hashes and not with_text and keep_nodes in ("all", "terms")), "types of nodes go without hashes and texts"
    assert hashes or keep_nodes != "index", "index nodes need hashes"
    fields = list(PARSE_FIELDS)
    if keep_nodes == "index" or types_only:  # only what line matching (QRY7) reads, or the types
        node_t = T.StructType([f for f in NODE.fields if f.name in (("node_type",) if types_only else _INDEX_FIELDS)])
        fields = [T.StructField("nodes", T.ArrayType(node_t)) if f.name == "nodes" else f for f in fields]
    out_schema = T.StructType(list(df.schema.fields) + fields)
    fn = partial(_parse_batches, text_col=text_col, opts=options, keep=keep_nodes,
                 with_text=with_text, lstrip=lstrip, slice_bytes=OUTPUT_SLICE_BYTES, hashes=hashes, types_only=types_only)
    ship_package(df.sparkSession)
    return spread(df, id_col).mapInArrow(fn, out_schema)


def parse_status(parsed: DataFrame, id_col: str = "snippet_id") -> DataFrame:
    """TOK1/TOK2: (id, valid, reason, n_nodes)."""
    return parsed.select(id_col, "valid", "reason", "n_nodes")


def nodes(parsed: DataFrame, id_col: str = "snippet_id") -> DataFrame:
    """TOK3: one row per node (preorder ``pre``), from the nested array; no shuffle."""
    return parsed.select(id_col, F.inline("nodes"))


def height_filter(node_rows: DataFrame, min_depth: int = 4) -> DataFrame:
    """TOK4: subtrees having some node at relative depth >= min_depth."""
    return node_rows.where(F.col("height") >= min_depth)


def drop_roots(node_rows: DataFrame, names=("Module",)) -> DataFrame:
    """TOK5: drop subtrees whose root type is listed."""
    return node_rows.where(~F.col("node_type").isin(list(names)))


def height_by_self_join(node_rows: DataFrame, id_col: str = "snippet_id") -> DataFrame:
    """Independent TOK4 cross-check: height = max(depth of descendants) - own depth.

    An interval join on the equi key ``id_col``; only for audits on small inputs.
    """
    a, d = node_rows.alias("a"), node_rows.alias("d")
    return (a.join(d, (F.col(f"a.{id_col}") == F.col(f"d.{id_col}"))
                   & F.col("d.pre").between(F.col("a.pre"), F.col("a.pre") + F.col("a.size") - 1))
            .groupBy(F.col(f"a.{id_col}").alias(id_col), F.col("a.pre").alias("pre"))
            .agg((F.max("d.depth") - F.first("a.depth")).alias("height")))


def term_stream(parsed: DataFrame, id_col: str = "snippet_id", start_pos: int = 0) -> DataFrame:
    """TOK8: (id, pos, term_hash[, term]) for surviving subtrees in preorder; ``pos`` counts
    from ``start_pos``."""
    return (parsed.select(id_col, F.explode("nodes").alias("n"))
            .where(F.col("n.term_hash").isNotNull())
            .select(id_col, (F.col("n.pos") + start_pos).alias("pos"), F.col("n.term_hash").alias("term_hash"),
                    F.col("n.term").alias("term")))


def term_identity(df: DataFrame, options: TokenizerOptions = DEFAULT_OPTIONS, text_col: str = "content",
                  id_col: str = "snippet_id") -> DataFrame:
    """TOK11: every distinct term of ``df`` by its text, with the digest that stands for it: (term, term_hash, term_check, df,
    tf, hash_texts, digest_texts, digests). ``hash_texts`` and ``digest_texts`` count the texts that share the term's 64-bit
    hash and its 128-bit digest, ``digests`` the digests of the text; all three are 1 where identity holds.

    Terms are counted by (digest, SHA-256 of the text): texts are not grouping keys, and a frequent term is combined
    before it is sent.
    """
    p = parse_code(df.select(id_col, text_col), text_col=text_col, options=options, keep_nodes="terms",
                   with_text=True, id_col=id_col)
    rows = p.select(id_col, F.explode("nodes").alias("n")).select(
        id_col, "n.term_hash", "n.term_check", F.sha2("n.term", 256).alias("_sha"), F.col("n.term").alias("term"))
    own = ["term_hash", "term_check", "_sha"]
    per_doc = rows.groupBy(id_col, *own).agg(F.count(F.lit(1)).alias("tf"), F.max("term").alias("term"))
    terms = per_doc.groupBy(*own).agg(F.count(F.lit(1)).cast("long").alias("df"), F.sum("tf").cast("long").alias("tf"), F.max("term").alias("term"))
    # a clash is rare, so the counts are joined from groups that are nearly as many as terms
    by_hash = terms.groupBy("term_hash").agg(F.count_distinct("_sha").cast("int").alias("hash_texts"))
    by_digest = terms.groupBy("term_hash", "term_check").agg(F.count_distinct("_sha").cast("int").alias("digest_texts"))
    by_text = terms.groupBy("_sha").agg(F.count_distinct("term_hash", "term_check").cast("int").alias("digests"))
    out = terms.join(by_hash, "term_hash").join(by_digest, ["term_hash", "term_check"]).join(by_text, "_sha")
    return out.select("term", "term_hash", "term_check", "df", "tf", "hash_texts", "digest_texts", "digests")


def term_texts(df: DataFrame, options: TokenizerOptions = DEFAULT_OPTIONS, text_col: str = "content",
               id_col: str = "snippet_id") -> DataFrame:
    """Audit table (term_hash, term): the printed dump of every distinct term of ``df``."""
    p = parse_code(df.select(id_col, text_col), text_col=text_col, options=options, keep_nodes="terms",
                   with_text=True, id_col=id_col)
    return term_stream(p, id_col).select("term_hash", "term").dropDuplicates(["term_hash"])


def type_sequence(parsed: DataFrame, id_col: str = "snippet_id") -> DataFrame:
    """TOK10: space-joined node type names in preorder (needs ``keep_nodes='all'``)."""
    return parsed.select(id_col, F.array_join(F.transform("nodes", lambda n: n["node_type"]), " ")
                         .alias("type_sequence"))


# --------------------------------------------------------------------------- tokenizers (UDF1)

@dataclass(frozen=True)
class TokenizerSpec:
    """A tokenizer that an index can be built with: ``run`` takes DataFrame(snippet_id, content) to DataFrame(snippet_id,
    pos, term), with any number of rows per text, ``pos`` counting from 0. A ``term_hash`` column of its own, if there is
    one, stands for the term; else it is the hash of the term's text. Name and version are kept with the index.

    ``postings``, if there is one, gives the same terms combined per text: the rows it is given with ``n_terms`` and ``postings`` (an
    array of term_hash, tf, positions), so a build needs no shuffle to combine them."""

    name: str
    version: str
    run: Tokenizer
    postings: Tokenizer | None = None


TOKENIZERS: dict[str, TokenizerSpec] = {}


def register_tokenizer(spec: TokenizerSpec) -> TokenizerSpec:
    """Make ``spec`` known by name, so that an index built with it can be opened by path alone."""
    TOKENIZERS[spec.name] = spec
    return spec


def run_tokenizer(spec: TokenizerSpec, df: DataFrame) -> DataFrame:
    """(snippet_id, pos, term_hash) of DataFrame(snippet_id, content); null texts have no terms."""
    rows = spec.run(df.select("snippet_id", "content").where(F.col("content").isNotNull()))
    missing = {"snippet_id", "pos"} - set(rows.columns)
    if missing or not {"term", "term_hash"} & set(rows.columns):
        raise ValueError(f"tokenizer {spec.name} must give snippet_id, pos and term; it gives {rows.columns}")
    term_hash = F.col("term_hash").cast("long") if "term_hash" in rows.columns else F.xxhash64(F.col("term").cast("string"))
    return rows.select(F.col("snippet_id").cast("long"), F.col("pos").cast("int"), term_hash.alias("term_hash")).where(F.col("term_hash").isNotNull())


def structural_tokenizer(options: TokenizerOptions = DEFAULT_OPTIONS, with_text: bool = False) -> Tokenizer:
    """DataFrame(snippet_id, content) -> DataFrame(snippet_id, pos, term_hash, term); texts that do not parse have no terms."""
    def run(df: DataFrame) -> DataFrame:
        return term_stream(parse_code(df.select("snippet_id", "content"), options=options,
                                      keep_nodes="terms", with_text=with_text))
    return run


def structural_postings(options: TokenizerOptions = DEFAULT_OPTIONS) -> Tokenizer:
    """The terms of ``structural_tokenizer`` combined per text, as the parse pass gives them."""
    def run(df: DataFrame) -> DataFrame:
        parsed = parse_code(df, options=options, keep_nodes="none")
        return parsed.select(*df.columns, F.coalesce("dl", F.lit(0)).alias("n_terms"), "postings")
    return run


def word_array(text: Column, pattern: str = "[ \n]+") -> Column:
    """Whitespace words, empty pieces removed."""
    return F.filter(F.split(text, pattern), lambda w: w != "")


def word_tokenizer(pattern: str = "[ \n]+") -> Tokenizer:
    """DataFrame(snippet_id, content) -> DataFrame(snippet_id, pos, term_hash, term); JVM only."""
    def run(df: DataFrame) -> DataFrame:
        df = spread(df.select("snippet_id", "content"), "snippet_id")
        return (df.select("snippet_id", F.posexplode(word_array(F.col("content"), pattern)).alias("pos", "term"))
                .select("snippet_id", F.col("pos").cast("int").alias("pos"),
                        F.xxhash64("term").alias("term_hash"), "term"))
    return run


def gram_array(text: Column, n: int = 3) -> Column:
    """All runs of ``n`` characters of the lower-cased text in order; a shorter text has none."""
    low = F.lower(text)
    return F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))) \
        .otherwise(F.array().cast("array<string>"))


def gram_tokenizer(n: int = 3) -> Tokenizer:
    """DataFrame(snippet_id, content) -> DataFrame(snippet_id, pos, term): character n-grams; JVM only."""
    def run(df: DataFrame) -> DataFrame:
        df = spread(df.select("snippet_id", "content"), "snippet_id")
        return df.select("snippet_id", F.posexplode(gram_array(F.col("content"), n)).alias("pos", "term"))
    return run


#: Terms that keep variable, function, class and argument names; character 3-grams.
_WITH_NAMES = TokenizerOptions(drop_field_names=frozenset())
NAMES = register_tokenizer(TokenizerSpec("names", "1", structural_tokenizer(_WITH_NAMES), structural_postings(_WITH_NAMES)))
GRAMS = register_tokenizer(TokenizerSpec("grams3", "1", gram_tokenizer(3)))


def term_hash_of_text(term: Column) -> Column:
    """TOK11 for text terms: the same 64-bit hash as the pass's text path (xxh64, seed 42)."""
    return F.xxhash64(term)
