"""HTML extraction (EXT1-EXT13): pages -> toc links, crawl frontier, section items, documents.

One ``mapInArrow`` pass per page parses the markup (``functions.htmltree``) and appends two
nested arrays, ``links`` and ``items``; snippet validity (EXT9) is checked in the same pass so
items never need regrouping. The rest is DataFrame code.
"""
from __future__ import annotations

import ast
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LIBRARY_RULES, SHELL_PROMPTS, HtmlRules
from ..functions import htmltree
from ..session import scratch_path, ship_package

_LINK = pa.struct([("ord", pa.int32()), ("href", pa.string()), ("link", pa.string())])
_ITEM = pa.struct([("ord", pa.int32()), ("title", pa.string()), ("url", pa.string()),
                   ("snippets_raw", pa.list_(pa.string())), ("code_snippets", pa.list_(pa.string())),
                   ("skipped", pa.int32())])
LINK_T = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("href", T.StringType()),
                       T.StructField("link", T.StringType())])
ITEM_T = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("title", T.StringType()),
                       T.StructField("url", T.StringType()),
                       T.StructField("snippets_raw", T.ArrayType(T.StringType())),
                       T.StructField("code_snippets", T.ArrayType(T.StringType())),
                       T.StructField("skipped", T.IntegerType())])


def is_valid_snippet(code) -> bool:
    """EXT9: a string that parses and has more than one syntax node."""
    if not isinstance(code, str):
        return False
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
        return False
    walker = ast.walk(tree)
    next(walker)
    return next(walker, None) is not None


def _pages_batches(batches, url_col: str, html_col: str, rules: HtmlRules, validate: bool):
    for batch in batches:
        urls = batch.column(url_col).to_pylist()
        htmls = batch.column(html_col).to_pylist()
        links, items = [], []
        for url, html in zip(urls, htmls):
            root = htmltree.parse_html(html)
            hrefs = htmltree.toc_links(root, rules)
            links.append([{"ord": i, "href": h, "link": htmltree.resolve(url or "", h) if h else url}
                          for i, h in enumerate(hrefs)])
            row = []
            for i, (title, iurl, raw) in enumerate(htmltree.section_items(root, url or "", rules)):
                ok = [s for s in raw if is_valid_snippet(s)] if validate else list(raw)
                row.append({"ord": i, "title": title, "url": iurl, "snippets_raw": raw, "code_snippets": ok,
                            "skipped": len(raw) - len(ok)})
            items.append(row)
        arrays = list(batch.columns) + [pa.array(links, pa.list_(_LINK)), pa.array(items, pa.list_(_ITEM))]
        yield pa.RecordBatch.from_arrays(arrays, names=list(batch.schema.names) + ["links", "items"])


def parse_pages(pages: DataFrame, rules: HtmlRules = LIBRARY_RULES, url_col: str = "url", html_col: str = "html",
                validate: bool = True) -> DataFrame:
    """One pass per page: input columns + ``links`` and ``items`` arrays."""
    schema = T.StructType(list(pages.schema.fields) + [T.StructField("links", T.ArrayType(LINK_T)),
                                                       T.StructField("items", T.ArrayType(ITEM_T))])
    from .terms import spread
    ship_package(pages.sparkSession)
    return spread(pages, url_col).mapInArrow(partial(_pages_batches, url_col=url_col, html_col=html_col, rules=rules,
                                    validate=validate), schema)


def toc_links(pages: DataFrame, rules: HtmlRules = LIBRARY_RULES, key_cols=("url",)) -> DataFrame:
    """EXT1 + EXT2: (keys, ord, href, link) with the link resolved against the page url."""
    p = parse_pages(pages.select(*dict.fromkeys([*key_cols, "url", "html"])), rules, validate=False)
    return p.select(*key_cols, F.inline("links"))


def extract_sections(pages: DataFrame, rules: HtmlRules = LIBRARY_RULES, key_cols=("url",),
                     validate: bool = True) -> DataFrame:
    """EXT4-EXT9: one row per section/definition item with code:
    (keys, ord, title, url, snippets_raw, code_snippets, skipped)."""
    p = parse_pages(pages.select(*dict.fromkeys([*key_cols, "url", "html"])), rules, validate=validate)
    page_keys = [F.col(c).alias("page_" + c) if c == "url" else F.col(c) for c in key_cols]
    return p.select(*page_keys, F.inline("items"))


# --------------------------------------------------------------------------- column operators

def _remove_dot_segments(path: Column) -> Column:
    """RFC 3986 dot-segment removal for a path starting with ``/``: one pass over its segments with an array as stack.
    A last segment that is a dot segment leaves a closing slash."""
    segments = F.slice(F.split(path, "/", -1), 2, F.greatest(F.size(F.split(path, "/", -1)) - 1, F.lit(0)))

    def step(kept: Column, s: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(s == "..", up).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    closing = F.when(F.element_at(F.split(path, "/", -1), -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(closing, "/"))


def resolve_url(base: Column, href: Column) -> Column:
    """EXT2 as a column expression: absolute, ``//host``, ``/path``, ``?query``, ``#frag``,
    relative and missing hrefs, with dot segments removed (as ``urljoin`` does)."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    no_frag = F.regexp_replace(base, "#.*$", "")
    no_query = F.regexp_replace(no_frag, r"\?.*$", "")
    base_path = F.regexp_extract(no_query, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    directory = F.regexp_replace(F.when(base_path == "", F.lit("/")).otherwise(base_path), "[^/]*$", "")

    def with_path(rel: Column) -> Column:  # rel: path[?query][#fragment]
        path = F.regexp_extract(rel, r"^([^?#]*)", 1)
        rest = F.regexp_extract(rel, r"^[^?#]*(.*)$", 1)
        return F.concat(origin, _remove_dot_segments(path), rest)

    return (F.when(href.isNull() | (href == ""), base)
            .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("/"), with_path(href))
            .when(href.startswith("#"), F.concat(no_frag, href))
            .when(href.startswith("?"), F.concat(no_query, href))
            .otherwise(with_path(F.concat(directory, href))))


# FIXED values: the HTML character references undone by the JVM-only link extraction
SIMPLE_ENTITIES = (("&quot", '"'), ("&lt", "<"), ("&gt", ">"), ("&amp", "&"))


def unescape_simple(c: Column) -> Column:
    """Undo the common character references, with or without the closing semicolon (the
    legacy HTML5 rule a parser applies), ``&#39;`` too; ``&amp`` last so nothing is undone twice."""
    c = F.replace(c, F.lit("&#39;"), F.lit("'"))
    for ent, ch in SIMPLE_ENTITIES:
        c = F.replace(F.replace(c, F.lit(ent + ";"), F.lit(ch)), F.lit(ent), F.lit(ch))
    return c


def toc_links_regex(pages: DataFrame, container: str = "nav", key_cols=("url",)) -> DataFrame:
    """EXT1 + EXT2 without Python, for simple markup: hrefs of ``<a href="...">`` inside the
    first ``<container>`` element, unescaped and resolved with ``resolve_url``:
    (keys, ord, href, link). Pages needing a real parser use ``toc_links``."""
    block = F.regexp_extract("html", f"(?s)<{container}>(.*?)</{container}>", 1)
    hrefs = F.regexp_extract_all(block, F.lit('<a href="([^"]*)"'), 1)
    out = pages.select(*dict.fromkeys([*key_cols, "url"]), F.posexplode(hrefs).alias("ord", "href"))
    href = unescape_simple(F.col("href"))
    return out.select(*key_cols, F.col("ord").cast("int").alias("ord"), href.alias("href"),
                      resolve_url(F.col("url"), href).alias("link"))


def snippet_text_from_pieces(pieces: Column, prompts=SHELL_PROMPTS) -> Column:
    """EXT8 on an array of text pieces: drop whole pieces starting with a prompt, join with ''."""
    pattern = "^(" + "|".join(p.replace(".", r"\.") for p in prompts) + ")"
    return F.array_join(F.filter(pieces, lambda p: ~p.rlike(pattern)), "")


def drop_empty_items(items: DataFrame) -> DataFrame:
    """EXT10: items without snippets are dropped (before EXT11)."""
    return items.where(F.size("code_snippets") > 0)


def dedup_by_url(items: DataFrame, order_cols, url_col: str = "url") -> DataFrame:
    """EXT11: first item per exact url wins, in the given order."""
    w = Window.partitionBy(url_col).orderBy(*order_cols)
    return items.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedup_first_wins(df: DataFrame, key_cols, order_cols) -> DataFrame:
    """EXT11 generalised to any key columns."""
    w = Window.partitionBy(*key_cols).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def files_to_documents(files: DataFrame, repos: DataFrame) -> DataFrame:
    """EXT13: title ``"{repo} {basename}"``, url ``"{html_url}/blob/{head}/{relpath}"``.

    Inner join on the repository name: files without a repository and repositories without
    files drop out. The repository list is joined by AQE's runtime size check (broadcast when
    small), never by an unconditional hint.
    """
    r = repos.select(F.col("name").alias("repo"), "html_url", "head")
    return (files.join(r, "repo")
            .select("repo", "relpath",
                    F.concat_ws(" ", "repo", F.regexp_extract("relpath", r"([^/]*)$", 1)).alias("title"),
                    F.concat_ws("/", "html_url", F.lit("blob"), "head", "relpath").alias("url"),
                    "content"))


# --------------------------------------------------------------------------- EXT3

def crawl_edges(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """EXT3 frontier over an edge table (src, dst): (url, depth) with each url once at its smallest depth.

    A loop of joins; a level's new urls are written once to the shared folder, and no level before is written or computed
    again, so the lineage stays one level long and a lost executor recomputes one level. A level's urls are made distinct after the
    join, so ``edges`` are never shuffled for that.
    """
    spark = edges.sparkSession
    root = scratch_path(spark, "crawl")
    e = edges.select("src", "dst")
    seeds.select(F.col("url").cast("string")).distinct().write.parquet(f"{root}/depth=0")
    level = 0
    while max_depth is None or level < max_depth:
        seen = spark.read.schema("url string, depth int").parquet(root)
        frontier = seen.where(F.col("depth") == level).select("url")
        nxt = (frontier.join(e, frontier["url"] == e["src"]).select(F.col("dst").alias("url")).distinct()
               .join(seen.select("url"), "url", "left_anti"))
        nxt.write.parquet(f"{root}/depth={level + 1}")
        if spark.read.schema("url string").parquet(f"{root}/depth={level + 1}").isEmpty():
            break
        level += 1
    return spark.read.schema("url string, depth int").parquet(root)


def crawl(pages: DataFrame, seeds: DataFrame, rules: HtmlRules = LIBRARY_RULES,
          max_depth: int | None = None) -> DataFrame:
    """EXT3 over a page table: (url, depth, is_leaf). ``library``: any depth, a page with toc
    links is only expanded, one without is parsed. ``tutorial``: the seed is expanded, each
    linked page is parsed."""
    links = toc_links(pages, rules).select(F.col("url").alias("src"), F.col("link").alias("dst"))
    links = links.join(pages.select(F.col("url").alias("dst")), "dst", "left_semi")  # only known pages
    path = scratch_path(pages.sparkSession, "links")
    links.write.parquet(path)  # the pages are parsed once
    links = pages.sparkSession.read.parquet(path)
    depth = max_depth if rules.recursive_toc else 1
    visited = crawl_edges(links, seeds, depth)
    if rules.recursive_toc:
        has_links = links.select(F.col("src").alias("url")).distinct().withColumn("has_links", F.lit(True))
        return (visited.join(has_links, "url", "left")
                .select("url", "depth", F.col("has_links").isNull().alias("is_leaf")))
    return visited.select("url", "depth", (F.col("depth") == 1).alias("is_leaf"))


def crawl_items(pages: DataFrame, seeds: DataFrame, rules: HtmlRules = LIBRARY_RULES) -> DataFrame:
    """EXT3 -> EXT4-EXT11: the items of every leaf page reached from the seeds, cleaned and
    de-duplicated (first wins in (page, ord) order)."""
    leaves = crawl(pages, seeds, rules).where("is_leaf").select("url")
    items = extract_sections(pages.join(leaves, "url", "left_semi"), rules)
    return dedup_by_url(drop_empty_items(items), [F.col("page_url"), F.col("ord")])
