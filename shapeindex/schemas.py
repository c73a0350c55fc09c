"""Explicit schemas of every table the engine reads or writes."""
from pyspark.sql import types as T

NODE = T.StructType([
    T.StructField("pre", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("node_type", T.StringType()),
    T.StructField("lineno", T.IntegerType()),
    T.StructField("term_hash", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("first_term_hash", T.LongType()),
    T.StructField("term", T.StringType()),
    T.StructField("term_check", T.LongType()),  # with the hash, a term's 128-bit digest
])

POSTING = T.StructType([
    T.StructField("term_hash", T.LongType()),
    T.StructField("tf", T.IntegerType()),
    T.StructField("positions", T.ArrayType(T.IntegerType())),
])

# columns appended by the parse pass
PARSE_FIELDS = [
    T.StructField("valid", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("n_nodes", T.IntegerType()),
    T.StructField("dl", T.IntegerType()),
    T.StructField("nodes", T.ArrayType(NODE)),
    T.StructField("postings", T.ArrayType(POSTING)),
]

SECTION_ITEM = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("code_snippets", T.ArrayType(T.StringType())),
])

REPO = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("clone_url", T.StringType()),
    T.StructField("html_url", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("stars", T.LongType()),
    T.StructField("size_kb", T.LongType()),
    T.StructField("head", T.StringType()),
])

SNIPPET = T.StructType([
    T.StructField("snippet_id", T.LongType()),
    T.StructField("batch_seq", T.LongType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("dl", T.IntegerType()),
    T.StructField("n_nodes", T.IntegerType()),
])

INDEX_NODE = T.StructType([
    T.StructField("snippet_id", T.LongType()),
    T.StructField("pre", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("lineno", T.IntegerType()),
    T.StructField("term_hash", T.LongType()),
    T.StructField("first_term_hash", T.LongType()),
])

INDEX_POSTING = T.StructType([
    T.StructField("term_hash", T.LongType()),
    T.StructField("snippet_id", T.LongType()),
    T.StructField("batch_seq", T.LongType()),
    T.StructField("tf", T.IntegerType()),
    T.StructField("dl", T.IntegerType()),
    T.StructField("positions", T.ArrayType(T.IntegerType())),
    T.StructField("term_bucket", T.IntegerType()),
])

TERM_STAT = T.StructType([
    T.StructField("term_hash", T.LongType()),
    T.StructField("df", T.LongType()),
    T.StructField("max_tf", T.IntegerType()),  # upper-bound inputs for exact top-k pruning;
    T.StructField("min_dl", T.IntegerType()),  # kept as bounds (not tightened) after deletes
])

QUERY = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("code", T.StringType()),
])
