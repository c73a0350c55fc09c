"""The DOM as a relation, and section extraction (EXT4-EXT9) as joins over it.

One pass per page turns markup into rows, one per element and text node, numbered in preorder: a subtree is an interval
``[pre, pre + size - 1]``. Selectors are joins: a child has ``parent = pre``, a descendant lies in the interval, the first match is the
one with the smallest ``pre``. Which sections and definitions belong to the document is a count of chain members among a
node's ancestors (all nodes on the way down must be members), so nesting of any depth takes one join and no recursion.

All joins are on the page first, so they are made where a page's rows are: a task holds the rows of about ``PAGE_BYTES`` of markup as
sorted columns (a page's numbers follow those of the page before it) and joins them by binary search. No node row is sent or written.
"""
from __future__ import annotations

from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LIBRARY_RULES, HtmlRules
from ..functions import htmltree
from ..functions.renewal import renewed
from ..session import ship_package
from .html import dedup_by_url, drop_empty_items, is_valid_snippet, resolve_url
from .terms import SPREAD_TASK_BYTES, spread

_INTS, _TEXTS = ("pre", "size", "parent", "depth"), ("tag", "parent_tag", "cls", "id", "href", "text")
NODE = T.StructType([*[T.StructField(c, T.IntegerType()) for c in _INTS], *[T.StructField(c, T.StringType()) for c in _TEXTS]])
_NODE_ARROW = pa.struct([*[(c, pa.int32()) for c in _INTS], *[(c, pa.string()) for c in _TEXTS]])
PAGE = "page"
PAGE_BYTES = 1 << 20  # markup turned into rows at once


def _dom_batches(batches):
    for batch in batches:
        keys, htmls = batch.column(0), batch.column(1).to_pylist()
        start, size = 0, 0
        for k, html in enumerate(htmls):
            size += len(html or "")
            if size >= PAGE_BYTES or k == len(htmls) - 1:
                cols, cuts = {f.name: [] for f in _NODE_ARROW}, [0]
                for h in htmls[start : k + 1]:
                    r = htmltree.markup_rows(h)
                    for c, values in r.items():
                        cols[c] += values
                    cuts.append(len(cols["pre"]))
                nodes = pa.StructArray.from_arrays([pa.array(cols[f.name], type=f.type) for f in _NODE_ARROW], fields=list(_NODE_ARROW))
                yield pa.RecordBatch.from_arrays([keys.slice(start, k + 1 - start), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), nodes)], names=[PAGE, "nodes"])
                start, size = k + 1, 0


def dom(pages: DataFrame, page: Column, html_col: str = "html") -> DataFrame:
    """(page, pre, size, parent, depth, tag, parent_tag, cls, id, href, text): one row per node of every page. ``page`` is a unique
    key of type long. Null markup is a page with its root only."""
    ship_package(pages.sparkSession)
    rows = pages.select(page.cast("long").alias(PAGE), F.col(html_col).alias("html"))
    schema = T.StructType([T.StructField(PAGE, T.LongType()), T.StructField("nodes", T.ArrayType(NODE))])
    return spread(rows, PAGE).mapInArrow(partial(_dom_batches), schema).select(PAGE, F.inline("nodes"))


# --------------------------------------------------------------------------- rows in a task

class Rows:
    """Columns of equal length (``at``: by name). Tags and classes are numbers of their ``words``."""

    def __init__(self, at: dict, words: dict | None = None) -> None:
        self.at, self.words = at, words or {}

    def __getitem__(self, column: str) -> np.ndarray:
        return self.at[column]

    def __len__(self) -> int:
        return len(next(iter(self.at.values())))

    def take(self, rows) -> "Rows":
        return Rows({c: v[rows] for c, v in self.at.items()}, self.words)

    def named(self, **columns: str) -> "Rows":
        """The columns given, as new name = column."""
        return Rows({new: self.at[c] for new, c in columns.items()}, self.words)


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def page_nodes(keys: list, htmls: list) -> tuple[Rows, np.ndarray]:
    """The node rows of some pages, and the first number of each. ``pre`` and ``parent`` go on from page to page; rows of one key, which
    follow one another, are one page."""
    cols: dict[str, list] = {c: [] for c in ("size", "depth", *_TEXTS)}
    pre, parent, page, first = [], [], [], []
    after, last = 0, object()
    for key, html in zip(keys, htmls, strict=True):
        r = htmltree.markup_rows(html)
        n = len(r["pre"])
        if key != last:
            first.append(after)
            last = key
        base = first[-1]
        pre.append(np.arange(base, base + n))
        up = np.array(r["parent"], dtype=np.int64)
        parent.append(np.where(up < 0, -1, up + base))
        page.append(np.full(n, len(first) - 1))
        after = max(after, base + n)
        for c in cols:
            cols[c] += r[c]
    at = {"pre": np.concatenate(pre), "parent": np.concatenate(parent), "page": np.concatenate(page)}
    words = {}
    for c in ("size", "depth"):
        at[c] = np.array(cols[c], dtype=np.int64)
    for c in ("tag", "parent_tag", "cls"):
        coded = pa.array(cols[c], pa.string()).dictionary_encode(null_encoding="encode")
        at[c], words[c] = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    for c in ("id", "href", "text"):
        at[c] = _objects(cols[c])
    return Rows(at, words), np.array(first)


def _met(low: np.ndarray, high: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with ``low[i] <= keys[j] < high[i]``; ``keys`` is in order."""
    a = np.searchsorted(keys, low)
    n = np.maximum(np.searchsorted(keys, high) - a, 0)
    i = np.repeat(np.arange(len(low)), n)
    return i, np.arange(len(i)) + np.repeat(a - (np.cumsum(n) - n), n)


def _times(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How often each wanted value is among ``keys``."""
    keys = np.sort(keys)
    return np.searchsorted(keys, wanted, "right") - np.searchsorted(keys, wanted)


def _around(of: Rows, pre: np.ndarray) -> np.ndarray:
    """How many intervals of ``of`` hold each of the numbers."""
    return np.searchsorted(np.sort(of["pre"]), pre, "right") - np.searchsorted(np.sort(of["pre"] + of["size"]), pre, "right")


def _innermost(of: Rows, pre: np.ndarray) -> dict[int, int]:
    """For each of the numbers the last interval of ``of`` that begins before it and holds it."""
    out, open_ = {}, []
    spans = sorted(zip(of["pre"].tolist(), (of["pre"] + of["size"]).tolist(), strict=True), reverse=True)
    for p in np.unique(pre).tolist():
        while spans and spans[-1][0] < p:
            open_.append(spans.pop())
        while open_ and open_[-1][1] <= p:
            open_.pop()
        if open_:
            out[p] = open_[-1][0]
    return out


def _equal(left: Rows, right: Rows, on: str, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``left`` and ``right`` with ``on = key``."""
    order = np.argsort(right[key], kind="stable")
    i, j = _met(left[on], left[on] + 1, right[key][order])
    return i, order[j]


def _both(a: Rows, b: Rows) -> Rows:
    return Rows({c: np.concatenate([a[c], b[c]]) for c in a.at if c in b.at})


# --------------------------------------------------------------------------- selectors

def having(nodes: Rows, tags, cls: str | None = None, under=None) -> Rows:
    """Nodes of one of the tags whose class attribute contains ``cls``; ``under``: the parent's tags."""
    def one_of(column, wanted):
        wanted = {wanted} if isinstance(wanted, str) else set(wanted)
        return np.array([w in wanted for w in nodes.words[column]], dtype=bool)[nodes[column]]

    if not len(nodes):
        return nodes
    hit = one_of("tag", tags)
    if cls is not None:
        hit &= np.array([cls in (w or "") for w in nodes.words["cls"]], dtype=bool)[nodes["cls"]]
    return nodes.take(np.flatnonzero(hit if under is None else hit & one_of("parent_tag", under)))


def with_href(nodes: Rows) -> Rows:
    return nodes.take(np.array([h is not None for h in nodes["href"]], dtype=bool))


def child(of: Rows, nodes: Rows, *columns: str) -> Rows:
    """(of_pre, columns) of the nodes that are direct children of ``of``."""
    i, j = _equal(of, nodes, "pre", "parent")
    return Rows({"of_pre": of["pre"][i], **{c: nodes[c][j] for c in columns}}, nodes.words)


def descendant(of: Rows, nodes: Rows, *columns: str, or_self: bool = False) -> Rows:
    """(of_pre, columns) of the nodes inside the intervals of ``of``."""
    order = np.argsort(nodes["pre"], kind="stable")
    i, j = _met(of["pre"] + (not or_self), of["pre"] + of["size"], nodes["pre"][order])
    return Rows({"of_pre": of["pre"][i], **{c: nodes[c][order[j]] for c in columns}}, nodes.words)


def first_match(of_pre: np.ndarray, order: list, values: np.ndarray) -> dict:
    """Per context the value of the first match, in the order of the columns ``order``."""
    out: dict = {}
    rows = np.lexsort((*reversed(order), of_pre))
    for k, v in zip(of_pre[rows].tolist(), values[rows], strict=True):
        out.setdefault(k, v)
    return out


def joined_texts(of_pre: np.ndarray, pre: np.ndarray, text: np.ndarray) -> dict[int, list]:
    """Per context its texts in document order."""
    out: dict[int, list] = defaultdict(list)
    for k, _, t in sorted(zip(of_pre.tolist(), pre.tolist(), text, strict=True)):
        out[k].append(t)
    return out


# --------------------------------------------------------------------------- EXT4-EXT7

def document_sections(nodes: Rows, rules: HtmlRules) -> Rows:
    """The first section of a page and the sections below it whose way down leads through sections only: (page, pre, size,
    depth, top), with the depth of the first as ``top``."""
    s = having(nodes, rules.section_tag, rules.section_class)
    s = s.take(np.lexsort((s["depth"], s["size"], s["pre"])))
    root = s.take(np.unique(s["page"], return_index=True)[1])
    inside = descendant(root, s, "page", "pre", "size", "depth", or_self=True)
    inside.at["top"] = root["depth"][np.searchsorted(root["page"], inside["page"])]
    chain = _around(inside, inside["pre"]) * _times(inside["pre"], inside["pre"])
    return inside.take(chain == inside["depth"] - inside["top"] + 1)


def section_titles(nodes: Rows, sections: Rows, rules: HtmlRules) -> dict[int, str]:
    """EXT5: per section the direct texts of its headers and all texts under ``code`` in them."""
    headers = child(sections, having(nodes, rules.header_tags), "pre", "size")
    texts = having(nodes, "#text")
    inner = descendant(headers, texts, "pre", "parent", "text")
    coded = descendant(headers, having(nodes, "code"), "pre", "size")
    under = descendant(coded, texts, "pre")
    parts = inner.take((inner["parent"] == inner["of_pre"]) | np.isin(inner["pre"], under["pre"]))
    i, j = _equal(parts, headers, "of_pre", "pre")
    return {k: "".join(t) for k, t in joined_texts(headers["of_pre"][j], parts["pre"][i], parts["text"][i]).items()}


def section_links(nodes: Rows, sections: Rows, rules: HtmlRules) -> dict[int, str]:
    """EXT6: per section the href of the first headerlink under any header below it."""
    anchors = with_href(having(nodes, "a", rules.headerlink_class, under=rules.header_tags))
    # headers come in document order, and so do the links of one header
    found = descendant(sections, anchors, "pre", "parent", "href")
    return first_match(found["of_pre"], [found["parent"], found["pre"]], found["href"])


def document_definitions(nodes: Rows, sections: Rows) -> Rows:
    """EXT7: (pre, size, s_pre) of the ``dl`` that are children of a section or, through ``dd``, of another such ``dl``."""
    dl = having(nodes, "dl")
    owners = _times(sections["pre"], dl["parent"])
    known = np.isin(dl["pre"], having(nodes, "dl", under="dd")["pre"])
    dl = dl.take(np.repeat(np.arange(len(dl)), np.where(owners > 0, owners, known)))
    chain = _both(dl, having(nodes, "dd", under="dl"))
    owner = _innermost(sections, dl["pre"])
    dl = dl.take(np.array([p in owner for p in dl["pre"].tolist()], dtype=bool))
    placed = Rows({"pre": dl["pre"], "size": dl["size"], "depth": dl["depth"], "s_pre": np.array([owner[p] for p in dl["pre"].tolist()], dtype=np.int64)})
    i, j = _equal(placed, sections, "s_pre", "pre")
    placed = placed.take(i)
    # members around a definition that are not around its section
    above = (_around(chain, placed["pre"]) - _around(chain, placed["s_pre"])) * _times(placed["pre"], placed["pre"])
    return placed.take(above == placed["depth"] - sections["depth"][j])


def block_texts(nodes: Rows, blocks: Rows, rules: HtmlRules) -> list[str]:
    """EXT8: per code block its texts joined, whole texts that begin with a prompt left out."""
    texts = having(nodes, "#text")
    prompts = tuple(rules.shell_prompts)
    texts = texts.take(np.array([not t.startswith(prompts) for t in texts["text"]], dtype=bool))
    found = descendant(blocks, texts, "pre", "text")
    code = {k: "".join(t) for k, t in joined_texts(found["of_pre"], found["pre"], found["text"]).items()}
    return [code.get(k, "") for k in blocks["pre"].tolist()]


def _crawl_order(members: Rows, kinds: np.ndarray) -> dict[int, int]:
    """The place of every section and definition: what lies below one comes before it, sections before definitions, each in document
    order."""
    kind = dict(zip(members["pre"].tolist(), kinds.tolist(), strict=True))
    above = _innermost(members, members["pre"])
    below: dict = defaultdict(list)
    for p in sorted(kind, key=lambda p: (kind[p], p)):
        below[above.get(p)].append(p)
    place: dict[int, int] = {}
    stack = [(p, False) for p in sorted(below[None], reverse=True)]
    while stack:
        p, done = stack.pop()
        if done:
            place[p] = len(place)
        else:
            stack.append((p, True))
            stack += [(x, False) for x in reversed(below.get(p, ()))]
    return place


def items(nodes: Rows, page_urls: list[list[str]], rules: HtmlRules = LIBRARY_RULES) -> list[tuple]:
    """EXT4-EXT8: (page, ord, title, page url, section's href, own href, snippets_raw) of every section and definition with code;
    ``page_urls`` has the urls of each page. Order: subsections, then definitions (inner ones first), then the section's own code."""
    s = document_sections(nodes, rules)
    titles, links = section_titles(nodes, s, rules), section_links(nodes, s, rules)
    code = having(nodes, rules.code_tag, rules.code_class)
    blocks = child(s, code, "pre", "size")
    one: dict[int, list] = defaultdict(list)  # by item: title, page url, section's href, own href
    for pre, page in zip(s["pre"].tolist(), s["page"].tolist(), strict=True):
        one[pre] += [(titles.get(pre, ""), url, links.get(pre), None) for url in page_urls[page]]
    members, kinds = s, np.zeros(len(s), dtype=np.int64)
    if rules.definitions:
        d = document_definitions(nodes, s)
        terms = child(d, having(nodes, ["dt", "dd"]), "pre", "id", "tag")
        dt, dd = having(terms, "dt"), having(terms, "dd")
        known = dt.take(np.array([x is not None for x in dt["id"]], dtype=bool))
        names = first_match(known["of_pre"], [known["pre"]], known["id"])
        anchors = with_href(having(nodes, "a", rules.headerlink_class, under="dt"))
        at = child(dt, anchors, "pre", "href")
        i, j = _equal(at, dt, "of_pre", "pre")
        hrefs = first_match(dt["of_pre"][j], [at["of_pre"][i], at["pre"][i]], at["href"][i])
        named = d.take(np.array([bool(names.get(p)) for p in d["pre"].tolist()], dtype=bool))
        outer = _innermost(named, d["pre"])
        again = dict(zip(named["pre"].tolist(), _times(named["pre"], named["pre"]).tolist(), strict=True))
        for pre, s_pre in zip(d["pre"].tolist(), d["s_pre"].tolist(), strict=True):
            o = outer.get(pre)
            name = names.get(pre)
            one[pre] += [(f"{title if o is None else names[o]}: {'None' if name is None else name}", url, link, hrefs.get(pre))
                         for title, url, link, _ in one[s_pre]] * again.get(o, 1)
        members, kinds = _both(s, d), np.concatenate([kinds, np.ones(len(d), dtype=np.int64)])
        inner = child(dd, code, "pre", "size")
        i, j = _equal(inner, dd, "of_pre", "pre")
        blocks = _both(blocks, Rows({"of_pre": dd["of_pre"][j], "pre": inner["pre"][i], "size": inner["size"][i]}))
    texts = joined_texts(blocks["of_pre"], blocks["pre"], _objects(block_texts(nodes, blocks, rules)))
    place = _crawl_order(members, kinds)
    page_of = dict(zip(nodes["pre"].tolist(), nodes["page"].tolist(), strict=True))
    out, n = [], defaultdict(int)
    for pre in sorted(texts, key=place.__getitem__):
        page = page_of[pre]
        for entry in one[pre]:
            out.append((page, n[page], *entry, texts[pre]))
            n[page] += 1
    return out


_FOUND = pa.schema([(PAGE, pa.int64()), ("page_url", pa.string()), ("ord", pa.int32()), ("title", pa.string()), ("at_url", pa.string()), ("section_href", pa.string()),
                    ("href", pa.string()), ("snippets_raw", pa.list_(pa.string())), ("code_snippets", pa.list_(pa.string()))])
_FOUND_DDL = ("page long, page_url string, ord int, title string, at_url string, section_href string, href string, snippets_raw array<string>, "
              "code_snippets array<string>")


def _whole_pages(batches):
    """Batches of about ``PAGE_BYTES`` of markup; rows of a key, which follow one another, stay together."""
    def merged(parts):
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    held, size, last = [], 0, None
    for batch in batches:
        keys, start = batch.column(0).to_pylist(), 0
        bytes_ = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
        for k, key in enumerate(keys):
            if size >= PAGE_BYTES and key != last:
                held += [batch.slice(start, k - start)] if k > start else []
                yield merged(held)
                held, size, start = [], 0, k
            size += bytes_[k]
            last = key
        held += [batch.slice(start)] if start < len(keys) else []
    if held:
        yield merged(held)


def _items_of(batch, rules: HtmlRules, validate: bool):
    keys, urls, htmls = (c.to_pylist() for c in batch.columns)
    nodes, first = page_nodes(keys, htmls)
    own: list = []  # key and urls of each page
    for key, url in zip(keys, urls, strict=True):
        if not own or own[-1][0] != key:
            own.append((key, []))
        own[-1][1].append(url)
    rows = []
    for page, ord_, title, at_url, section_href, href, raw in items(nodes, [u for _, u in own], rules):
        key, all_urls = own[page]
        # a page row that repeats repeats its snippets, too
        ok = [x for x in raw if is_valid_snippet(x) for _ in all_urls] if validate else raw
        rows += [(key, url, ord_, title, at_url, section_href, href, raw, ok) for url in all_urls]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def _item_batches(batches, rules: HtmlRules, validate: bool):
    yield from renewed(partial(_items_of, rules=rules, validate=validate), _whole_pages(batches), lambda b: pc.sum(pc.binary_length(b.column(2))).as_py() or 0)


def _page_tasks(pages: DataFrame) -> int:
    """Tasks for a pass over pages: two a core, and more as the tables they are made from grow. (The estimate of a join is a product,
    so the tables are asked.)"""
    least = 2 * pages.sparkSession.sparkContext.defaultParallelism
    try:
        leaves = pages._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    except Exception:  # no JVM view of the plan
        return least
    return max(least, -(-sum(n for n in sizes if n < (1 << 63) - 1) // SPREAD_TASK_BYTES))


def extract_items(pages: DataFrame, page: Column, rules: HtmlRules = LIBRARY_RULES, url_col: str = "url", html_col: str = "html",
                  validate: bool = True) -> DataFrame:
    """EXT4-EXT9 from a page table: (page, page_url, ord, title, url, snippets_raw, code_snippets, skipped).

    With ``validate`` (EXT9) ``code_snippets`` keeps the snippets that parse and have more than one syntax node; the others are
    counted. Pages of one key are an error of the caller; a page without a key or a section gives no row.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(page.cast("long").alias(PAGE), F.coalesce(F.col(url_col), F.lit("")).alias("page_url"), F.col(html_col).alias("html")).where(F.col(PAGE).isNotNull())
    dealt = rows.repartition(_page_tasks(rows), PAGE).sortWithinPartitions(PAGE)
    found = dealt.mapInArrow(partial(_item_batches, rules=rules, validate=validate), _FOUND_DDL)
    found = found.withColumn("_section", resolve_url(F.col("at_url"), F.col("section_href")))
    skipped = (F.size("snippets_raw") - F.size("code_snippets")) if validate else F.lit(0)
    return found.select(PAGE, "page_url", "ord", "title", resolve_url(F.col("_section"), F.col("href")).alias("url"), "snippets_raw", "code_snippets", skipped.alias("skipped"))


def clean_items(found: DataFrame) -> DataFrame:
    """EXT10, EXT11: items with code, the first of every url in the order of pages and items."""
    return dedup_by_url(drop_empty_items(found), [F.col(PAGE), F.col("ord")])
