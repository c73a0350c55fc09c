"""Operator 3, benchmark decontamination by winnowing. DataFrame and SQL functions only.

A window of an item is ``span`` consecutive words (an item of fewer words is one window). Every window of ``t`` words
has ``t - k + 1`` hashes of k words; the smallest of them is kept as its fingerprint, on both sides. Equal windows keep
equal fingerprints, so joining the fingerprints of documents and items misses no shared window. Around each hit the
document's windows that hold it are compared with the items' windows as texts; the covered words are then merged.

Windows of items shorter than ``span`` have their own ``t`` (their number of words), so each such length is a family of
fingerprints of its own; there are at most ``span`` families.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

SPAN = 13
SHARE = 20  # contaminated: at least one word in SHARE is hit
#: Fingerprints of the benchmark are broadcast up to this many rows (16 bytes each), else both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Keys of contaminated rows (about 60 bytes each) are broadcast up to this many.
BROADCAST_KEYS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: FIXED: what separates words (ASCII other than digits and lower-case letters).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _pairs_sql(array: str, step: int, made: str) -> str:
    """SQL for ``made`` of (a, b) = each element of ``array`` and the one ``step`` further on."""
    return f"zip_with(slice({array}, 1, size({array}) - {step}), slice({array}, {step + 1}, size({array}) - {step}), (a, b) -> {made})"


def _sliding_sql(array: str, width: int, made: str) -> tuple[list[str], str]:
    """SQL steps for ``made`` over each ``width`` consecutive elements, by doubling: let-bindings of x1, x2, ... and the last."""
    steps, now, size = [], array, 1
    while size < width:
        step = min(size, width - size)
        steps.append(_pairs_sql(now, step, made))
        now, size = f"{array}{len(steps)}", size + step
    return steps, now


def kept_hashes(n_words: str, hashes: str, t: int) -> tuple[str, int]:
    """SQL for the kept fingerprints of an array of word hashes: array of (position from 0, hash), and k.

    A hash of k words is hashed from those of its halves (they may overlap). It keeps its upper 48 bits, with the position's
    lower 16 bits below: the smallest value of a window then tells its position, and the same minimum in neighbouring
    windows is kept once.
    """
    k = (t + 1) // 2
    grams, g = _sliding_sql("h", k, "xxhash64(a, b)")
    place = f"transform({g}, (x, i) -> (x & -65536L) | (i & 65535L))"
    mins, m = _sliding_sql("m", t - k + 1, "least(a, b)")
    pick = f"""filter(transform({m}, (x, j) -> struct(cast(j + pmod((x & 65535L) - j, 65536L) as int) as pos, shiftright(x, 16) as h, j = 0 or x != {m}[j - 1] as fresh)), s -> s.fresh)"""
    # nested let-bindings: each array is computed once, as the single element of an array that is transformed
    sql = pick
    for n in range(len(mins), 0, -1):
        sql = f"transform(array({mins[n - 1]}), m{n} -> {sql})[0]"
    sql = f"transform(array({place}), m -> {sql})[0]"
    for n in range(len(grams), 0, -1):
        sql = f"transform(array({grams[n - 1]}), h{n} -> {sql})[0]"
    return f"if({n_words} < {t}, cast(array() as array<struct<pos:int,h:bigint,fresh:boolean>>), transform(array({hashes}), h -> {sql})[0])", k


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(t, win, item_id as text): the distinct windows of every item. Items without words have none; rows with a null id
    are one item."""
    d = items.select(F.col(item_id).cast("string").alias("_item"), words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    d = d.withColumn("_t", F.least(F.size("_w"), F.lit(span)))
    wins = F.expr("transform(sequence(0, size(_w) - _t), s -> array_join(slice(_w, s + 1, _t), ' '))")
    return d.select("_item", "_t", F.explode(F.array_distinct(wins)).alias("_win")).distinct()


def hits(docs: DataFrame, key: list[str], windows: DataFrame, text: str = "text", span: int = SPAN,
         broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document (``key``) with a hit: ``n_hit`` words inside occurrences of windows, the sorted ``items``, and
    ``n_items``, which counts the item of null id as well.

    Only fingerprints travel at first, (key, position, hash). Documents that keep one of the items' are then read once
    more, and around each of its positions the windows that hold it are compared as texts.
    """
    spark = docs.sparkSession
    sizes = sorted(r["_t"] for r in windows.groupBy("_t").count().collect())  # at most ``span`` of them
    d = docs.select(*key, words(F.col(text)).alias("_w")).withColumn("_n", F.size("_w"))
    hashed = F.expr("transform(_w, x -> xxhash64(x))")
    met = None
    for t in sizes:
        # fingerprints of the items: the same function on each window's words
        b = windows.where(F.col("_t") == t).select("_win").distinct().withColumn("_w", F.split("_win", " ")).withColumn("_n", F.lit(t)).withColumn("_h", hashed)
        sql, _ = kept_hashes("_n", "_h", t)
        b = stored(spark, b.select(F.explode(F.expr(sql)).alias("f")).select(F.col("f.h").alias("_f")).distinct(), f"fingerprints-{t}")
        small = b.count() <= broadcast_rows
        f = d.withColumn("_h", hashed).select(*key, F.explode(F.expr(sql)).alias("f")).select(*key, F.col("f.pos").alias("_pos"), F.col("f.h").alias("_f"))
        f = f.join(F.broadcast(b) if small else b, "_f", "left_semi").select(*key, F.lit(t).alias("_t"), "_pos")
        met = f if met is None else met.unionByName(f)
    if met is None:
        return docs.select(*key).limit(0).withColumns({"n_hit": F.lit(0).cast("long"), "items": F.lit(None).cast("array<string>"), "n_items": F.lit(0).cast("long")})
    # equal rows of the table are one document here
    met = stored(spark, met.distinct().groupBy(*key).agg(F.collect_list(F.struct("_t", "_pos")).alias("_at")), "fingerprint-hits")
    few = met.count() <= BROADCAST_KEYS
    near = d.join(F.broadcast(met.select(*key)) if few else met.select(*key), key, "left_semi").dropDuplicates(key).join(met, key)
    near = near.select(*key, "_w", "_n", F.explode("_at").alias("a")).select(*key, "_w", "_n", "a._t", "a._pos").where("_n >= _t")
    k = F.expr("cast(_t - (_t + 1) div 2 as int)")  # a window that holds the fingerprint starts so many words before it, at most
    near = near.withColumns({"_from": F.greatest(F.col("_pos") - k, F.lit(0)), "_to": F.least(F.col("_pos"), F.col("_n") - F.col("_t"))}).where("_from <= _to")
    cut = F.expr("explode(transform(sequence(_from, _to), s -> struct(s as s, array_join(slice(_w, s + 1, _t), ' ') as win)))")
    near = near.select(*key, "_t", cut.alias("x")).select(*key, "_t", F.col("x.s").alias("_s"), F.col("x.win").alias("_win")).distinct()
    wins = windows.select("_t", "_win", "_item")
    wins = F.broadcast(wins) if wins.count() <= broadcast_rows // 4 else wins
    found = near.join(wins, ["_t", "_win"]).select(*key, "_s", "_t", "_item")
    # spans per document: sorted by start, the longest first; each adds what lies beyond the end of those before
    spans = found.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("_s", "_t"))).alias("_spans"), F.sort_array(F.collect_set("_item")).alias("items"),
                                    F.max(F.col("_item").isNull().cast("long")).alias("_null"))
    merged = """aggregate(_spans, struct(cast(0 as bigint) as n, 0 as e), (a, x) -> struct(a.n + greatest(0, x._s + x._t - greatest(a.e, x._s)) as n, greatest(a.e, x._s + x._t) as e)).n"""
    return spans.select(*key, F.expr(merged).alias("n_hit"), "items", (F.size("items") + F.col("_null")).alias("n_items"))


def row_key(doc_id: str, text: str) -> Column:
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its contaminated rows (see :func:`contamination`)."""
    keyed = docs.select(doc_id, text).withColumn("_row", row_key(doc_id, text))
    bad = stored(docs.sparkSession, contamination(keyed, items, doc_id, text).where("contaminated").select("_row").distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    return docs.withColumn("_row", row_key(doc_id, text)).join(bad, "_row", "left_anti").select(*docs.columns)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, share: int = SHARE) -> DataFrame:
    """Per row of ``docs``: all its columns but the text, n_words, n_hit, n_items, items_sha256 (of the sorted item ids,
    comma-joined; of nothing without items) and contaminated. Items of a null id hit like others and are one item, whose
    id adds nothing to the joined ids.

    Null texts have no words. Rows are told apart by id and MD5 of the text, so null and repeated ids are allowed and
    repeated rows get equal results. Empty tables give an empty result or no hits. Columns of ``docs`` that clash with
    the result's names are dropped.
    """
    made = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated", text.lower()}
    keep = [c for c in docs.columns if c.lower() not in made]
    d = docs.withColumn("_key", row_key(doc_id, text))
    windows = stored(docs.sparkSession, benchmark_windows(items, span=span), "windows")
    h = hits(d, ["_key"], windows, text, span)
    counts = d.select("_key", *keep, F.size(words(F.col(text))).cast("long").alias("n_words"))
    out = counts.join(h, "_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = out.select(*keep, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("_i"), "items")
    none = F.col("items").isNull()
    return out.select(
        *keep, "n_words", "n_hit", F.when(none, 0).otherwise(F.col("_i")).cast("long").alias("n_items"),
        F.sha2(F.when(none, F.lit("")).otherwise(F.array_join("items", ",")).cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every whole document against every benchmark item."""
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP3_SQL = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x != '') w, row_number() over () r
  from documents
), i as (
  select item_id::varchar item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x != '') w
  from benchmark
), iw as (
  select distinct item_id, least(len(w), 13) t, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda p: array_to_string(w[p:p + least(len(w), 13) - 1], ' '))) win
  from i where len(w) > 0
), dw as (
  select r, t, unnest(range(1, len(w) - t + 2)) p, unnest(list_transform(range(1, len(w) - t + 2), lambda p: array_to_string(w[p:p + t - 1], ' '))) win
  from d, (select distinct t from iw) where len(w) >= t
), h as (
  select r, t, p, item_id from dw join iw using (t, win)
), words as (
  select r, count(distinct q) n_hit from (select r, unnest(range(p, p + t)) q from (select distinct r, t, p from h)) group by r
), items as (
  select r, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct r, item_id from h) group by r
)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join words using (r) left join items using (r)
"""
