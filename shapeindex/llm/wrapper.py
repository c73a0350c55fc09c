"""Operator 7, main text by wrapper induction.

Every page becomes a DOM tree. Pages of a host that nest their structural elements alike are a layout; those whose layout no
other page has are one group together. One page of each (the smallest by a hash of its id, empty ones aside) is the reference;
each page of the group is aligned with it by simple tree matching: the largest order-preserving matching of equal tags, level by
level. Aligned text nodes are then counted over all pages of the group (a Spark aggregation by group, reference node and
text): a node whose text is the same on most pages, and on two at least, is template, a varying one is a slot, hence content. Nodes
without a partner in the reference vary by definition. What a page marks as article or main part is template only where eight pages
or more tell so.

What a page itself marks as not content (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments of
readers: by tag, role, class or id) is no slot. In a page with an article (or else a main part) that holds the larger part of
the other text the slots are those in it.
"""
from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, table

CONSTANT_SHARE = 0.6  # of a layout's pages with different content
CONSTANT_PAGES = 2  # one page tells no template
MARKED_PAGES = 8  # against the page's own mark of an article or a main part fewer tell nothing: two versions of an article share paragraphs
LAYOUT_DEPTH = 3  # levels of structural elements that tell a layout
BROADCAST_GROUPS = 100_000  # layouts of hosts (about 60 bytes each) are broadcast up to this many
BROADCAST_BYTES = 8 << 20  # references, and templates, are broadcast up to this size, else joined by host

#: FIXED values: elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe select button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption dd dt td th tr tbody thead tfoot li legend summary figcaption".split())
#: An element that is open ends when one of these begins inside the same list or table.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
        "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tr td th", "table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: FIXED values: what marks an element as not content.
OUT_TAGS = frozenset("nav footer aside form menu dialog head datalist fieldset search".split()) | RAW
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer masthead cookie cookies "
    "consent gdpr notice alert popup modal overlay newsletter subscribe signup share sharing social comment comments reply replies respond disqus related "
    "recommended breadcrumb breadcrumbs widget login search pagination pager skip toolbar topbar".split())
#: FIXED values: what such a name may be joined with in one class or id ("site-footer", "ad-box-2").
NAME_ADDS = frozenset("site page main global primary secondary top bottom left right inner outer box bar block area list item wrapper container section".split())
READERS = frozenset("comment comments reply replies respond disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
RAW_ENDS = {name: re.compile(f"</{name}[^>]*>", re.I) for name in RAW}
STRUCTURE = re.compile(r"<(/?)(div|section|article|main|nav|header|footer|aside|form|body)\b", re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PARTS = re.compile(r"[^a-z0-9]+")


def _names(value: str) -> set[str]:
    """Names of OUT_NAMES in a class or id: of its words those that consist of such names, NAME_ADDS and numbers only."""
    out = set()
    for word in value.split():
        parts = {x for x in NAME_PARTS.split(word) if x and not x.isdigit()}
        if parts <= OUT_NAMES | NAME_ADDS:
            out |= parts & OUT_NAMES
    return out


@lru_cache(1 << 14)
def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is marked as not content, as a main part, and whether its class or id alone marks it so that it
    counts only beside other text."""
    if tag in OUT_TAGS:
        return True, False, False
    a = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    role = a.get("role", "")
    names = _names(f"{a.get('class', '')} {a.get('id', '')}")
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
    out = hidden or bool(set(role.split()) & OUT_ROLES)
    if tag == "article":
        named = bool(names & {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "related"})
    else:
        named = tag not in ("body", "html", "main") and tag not in HEADINGS and bool(names)
    return out or named, tag == "main" or role == "main", named and not out and not names & READERS


class Tokens:
    """(start, text or match of a tag) in order, comments and declarations left out; ``at`` may be moved on in between. In time linear
    in the page: when a quote in a tag does not close, quotes mean nothing from there on."""

    def __init__(self, html: str) -> None:
        self.html, self.at = html, 0

    def __iter__(self):
        html, size, last, tag = self.html, len(self.html), self.html.rfind(">"), TAG
        while self.at < size:
            at = self.at
            lt = html.find("<", at)
            if lt != at:
                self.at = size if lt < 0 else lt
                yield at, html[at : self.at]
                continue
            after = html[at + 1 : at + 3]
            if after[:1] in ("!", "?"):
                mark = "-->" if html.startswith("<!--", at) else ">"
                end = html.find(mark, at + (4 if mark == "-->" else 2))
                self.at = size if end < 0 else end + len(mark)
                continue
            m = None
            if at < last and after.lstrip("/")[:1].isalpha():
                m = tag.match(html, at)
                if m is None and tag is TAG:
                    tag = PLAIN
                    m = tag.match(html, at)
            self.at = at + 1 if m is None else m.end()
            yield at, "<" if m is None else m


class Page:
    """DOM in arrays: per node its tag (text blocks: "#"), parent, and for text blocks the text."""

    def __init__(self, html: str) -> None:
        if around := self._build(html, frozenset()):
            self._build(html, around)
        self.children: list[list[int]] = [[] for _ in self.tag]
        for i, p in enumerate(self.parent):
            if p >= 0:
                self.children[p].append(i)
        self.shape: list = [None] * len(self.tag)
        self.height = [0] * len(self.tag)
        for i in range(len(self.tag) - 1, -1, -1):
            key = (self.tag[i], tuple(self.shape[c] for c in self.children[i]))
            self.shape[i] = hash(key)
            self.height[i] = 1 + max((self.height[c] for c in self.children[i]), default=0)

    def _node(self, tag: str, parent: int, text: str = "", state: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.text.append(text)
        self.state.append(state)
        return len(self.tag) - 1

    def _build(self, html: str, around: frozenset) -> frozenset:
        """state bits: 1 not content, 2 inside a main part, 4 inside an article. The names of the elements that begin at
        ``around`` mark nothing. Gives those whose names should not: they hold nine tenths of the text that is not marked
        otherwise."""
        self.tag, self.parent, self.text, self.state = ["html"], [-1], [""], [0]
        stack, words, pos = [0], [], 0
        blocks, opened = [0], Counter()  # nearest block element of each entry of the stack; open elements by name
        named: dict[int, list[int]] = {}  # by node: where it begins, letters in it before those of named elements inside, the one around it
        inside, other = {0: 0}, {0: False}  # by node on the stack: the named element it is in; whether other marks hold
        free = 0

        def flush():
            if words:
                text = " ".join("".join(words).split())
                words.clear()
                if text:
                    self._node("#", blocks[-1], text, self.state[stack[-1]])

        def pop_to(k: int):
            if any(self.tag[n] in BLOCK for n in stack[k:]):
                flush()
            opened.subtract(self.tag[n] for n in stack[k:])
            del stack[k:], blocks[k:]

        source = Tokens(html)
        for start, m in source:
            if isinstance(m, str):
                if not self.state[stack[-1]] & 1:
                    words.append(unescape(m) if "&" in m else m)
                if not other[stack[-1]]:
                    letters = sum(map(len, m.split()))
                    if k := inside[stack[-1]]:
                        named[k][1] += letters
                    else:
                        free += letters
                continue
            name = m[2]
            name = name.lower()
            if m[1]:  # end tag
                if opened[name] > 0:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == name:
                            pop_to(k)
                            break
                continue
            if name in RAW:
                end = RAW_ENDS[name].search(html, source.at)
                source.at = end.end() if end else len(html)
                words.append(" ")
                continue
            if name == "br":
                words.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name == "body" or name == "html":  # the root stands for both
                continue
            if name in CLOSES_P and opened["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[k]]
                    if t == "p":
                        pop_to(k)
                        break
                    if t in BLOCK:
                        break
            if name in ENDS:
                ends, bounds = ENDS[name]
                found = 0
                for k in range(len(stack) - 1, 0, -1) if any(opened[t] > 0 for t in ends) else ():
                    t = self.tag[stack[k]]
                    if t in bounds:
                        break
                    if t in ends:
                        found = k
                if found:
                    pop_to(found)
            if name in BLOCK:
                flush()
            up, above = self.state[stack[-1]], stack[-1]
            out, main, by_name = _marks(name, m[3].strip())
            if by_name and start in around:
                out = by_name = False
            if name == "header":
                out = out or not up & 6
            state = up | (1 if out else 0) | (2 if main else 0) | (4 if name == "article" and not out else 0)
            stack.append(self._node(name, stack[-1], "", state))
            blocks.append(stack[-1] if name in BLOCK else blocks[-1])
            opened[name] += 1
            inside[stack[-1]], other[stack[-1]] = inside[above], other[above] or (out and not by_name)
            if by_name and not other[above]:
                named[stack[-1]] = [start, 0, inside[above]]
                inside[stack[-1]] = stack[-1]
        flush()
        for k in sorted(named, reverse=True):  # those inside come after those around them
            if named[k][2]:
                named[named[k][2]][1] += named[k][1]
        total = free + sum(n for _, n, k in named.values() if not k)
        return frozenset(start for start, n, _ in named.values() if n and n >= 0.9 * total)

    def blocks(self) -> list[int]:
        """Text blocks that may be content: in articles, or else in main parts, if they hold the larger part of the text
        outside marked elements; or else all of that."""
        free = [i for i, t in enumerate(self.tag) if t == "#" and not self.state[i] & 1]
        total = sum(len(self.text[i]) for i in free)
        for bit in (4, 2):
            inside = [i for i in free if self.state[i] & bit]
            if 2 * sum(len(self.text[i]) for i in inside) > total:
                return inside
        return free


CELLS = 1 << 22  # of the table of a matching; longer child lists are halved (Hirschberg), with the same weight


def align(page: Page, ref: Page) -> dict[int, int]:
    """Partner in ``ref`` of each node of ``page`` that simple tree matching pairs up. Iterative, so depth is no limit. What two
    subtrees give depends on their shapes alone and is computed once for each two shapes; child lists are trimmed of equal ends
    before the quadratic step."""
    top = (page.shape[0], ref.shape[0])
    pairs, nodes = [top], {top: (0, 0)}  # two shapes, and a node of each
    middles: dict[tuple, tuple[int, int, int]] = {}
    k = 0
    while k < len(pairs):
        a, b = nodes[pairs[k]]
        x, y = [page.shape[c] for c in page.children[a]], [ref.shape[d] for d in ref.children[b]]
        lo, hx, hy = 0, len(x), len(y)
        while lo < hx and lo < hy and x[lo] == y[lo]:
            lo += 1
        while hx > lo and hy > lo and x[hx - 1] == y[hy - 1]:
            hx, hy = hx - 1, hy - 1
        middles[pairs[k]] = (lo, hx, hy)
        k += 1
        some_x, some_y = dict(zip(x[lo:hx], page.children[a][lo:hx])), dict(zip(y[lo:hy], ref.children[b][lo:hy]))
        found = [(c, d) for c in some_x.values() for d in some_y.values() if page.tag[c] == ref.tag[d]]
        for c, d in [*zip(page.children[a][:lo], ref.children[b][:lo]), *zip(page.children[a][hx:], ref.children[b][hy:]), *found]:
            pair = (page.shape[c], ref.shape[d])
            if pair not in nodes:
                nodes[pair] = (c, d)
                pairs.append(pair)
    weight: dict[tuple, int] = {}
    plan: dict[tuple, list[tuple[int, int]]] = {}  # indices of children
    # a pair's children are of less height, but may have been found before it
    for pair in sorted(pairs, key=lambda p: page.height[nodes[p][0]]):
        a, b = nodes[pair]
        lo, hx, hy = middles[pair]
        x, y = page.children[a], ref.children[b]
        chosen = [(i, i) for i in range(lo)] + [(hx + i, hy + i) for i in range(len(x) - hx)]
        if hx > lo and hy > lo:
            sx, sy = [page.shape[c] for c in x[lo:hx]], [ref.shape[d] for d in y[lo:hy]]
            chosen += [(lo + i, lo + j) for i, j in _match(sx, sy, weight)]
        plan[pair] = chosen
        weight[pair] = 1 + sum(weight[page.shape[x[i]], ref.shape[y[j]]] for i, j in chosen)
    out, todo = {}, [(0, 0)]
    while todo:
        a, b = todo.pop()
        out[a] = b
        todo += [(page.children[a][i], ref.children[b][j]) for i, j in plan[page.shape[a], ref.shape[b]]]
    return out


def _match(xs: list, ys: list, weight: dict) -> list[tuple[int, int]]:
    """Indices of the heaviest order-preserving matching of two lists; elements without a weight together can't be paired."""
    kinds: dict = {}
    column = np.array([kinds.setdefault(s, len(kinds)) for s in ys])
    gains = {s: np.array([weight.get((s, t), 0) for t in kinds], dtype=np.int64) for s in set(xs)}

    def rows(i0: int, i1: int, columns: np.ndarray, step: int = 1):
        """Row by row, the best weight with each number of columns, and whether rows before it give the same."""
        best = np.zeros(len(columns) + 1, dtype=np.int64)
        for i in range(i0, i1)[::step]:
            gain = gains[xs[i]][columns]
            row = np.zeros_like(best)
            np.maximum.accumulate(np.maximum(best[1:], np.where(gain > 0, best[:-1] + gain, 0)), out=row[1:])
            yield best, row
            best = row

    out, todo = [], [(0, len(xs), 0, len(ys))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        n, m = i1 - i0, j1 - j0
        if not n or not m:
            continue
        if n > 1 and n * m > CELLS:
            mid = (i0 + i1) // 2
            for _, ahead in rows(i0, mid, column[j0:j1]):
                pass
            for _, behind in rows(mid, i1, column[j0:j1][::-1], -1):
                pass
            cut = j0 + int(np.argmax(ahead + behind[::-1]))
            todo += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
            continue
        move = np.zeros((n, m), dtype=np.int8)  # 0: the row is not paired, 1: the column is not, 2: both are, together
        for i, (best, row) in enumerate(rows(i0, i1, column[j0:j1])):
            move[i] = np.where(row[1:] == best[1:], 0, np.where(row[1:] == row[:-1], 1, 2))
        i, j = n, m
        while i and j:
            step = move[i - 1, j - 1]
            if step == 2:
                out.append((i0 + i - 1, j0 + j - 1))
            i, j = i - (step != 1), j - (step != 0)
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def layout(html: str) -> int:
    """Hash of the ways that structural elements nest, down to LAYOUT_DEPTH levels; how many there are does not count."""
    import xxhash

    ways, path = set(), []
    for m in STRUCTURE.finditer(html):
        name = m[2].lower()
        if name == "body":
            continue
        if not m[1]:
            path.append(name)
            if len(path) <= LAYOUT_DEPTH:
                ways.add("/".join(path))
        elif path and path[-1] == name:
            path.pop()
    return xxhash.xxh64_intdigest("\n".join(sorted(ways))) >> 1


def groups(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """``pages`` with ``_host``: the host and, where it is that of two pages or more, the layout; ``_h``: a hash of id and url."""
    from pyspark.sql.types import LongType, StructField, StructType

    d = pages.withColumns({"_name": host_of(F.col(url)), "_h": F.xxhash64(F.col(page_id), F.col(url))})
    at = d.columns.index(html)
    schema = StructType([*d.schema.fields, StructField("_layout", LongType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([layout(x) if x else None for x in b.column(at).to_pylist()], pa.int64())], names=[*b.schema.names, "_layout"])

    d = d.mapInArrow(run, schema)
    shared = d.where(F.col("_layout").isNotNull()).groupBy("_name", "_layout").agg(F.count("*").alias("_n")).where("_n > 1").select("_name", "_layout", F.lit(True).alias("_own"))
    shared = stored(pages.sparkSession, shared, "layouts")
    d = d.join(F.broadcast(shared) if shared.count() <= BROADCAST_GROUPS else shared, ["_name", "_layout"], "left")
    key = F.concat_ws("#", F.when(F.col("_own"), F.col("_layout").cast("string")).otherwise(""), "_name")
    return d.withColumn("_host", key).drop("_name", "_layout", "_own")


def page_blocks(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without the html, with _host (of pages of one layout), _digest (of the page's blocks) and _blocks: (node of the
    group's reference or -1, hash of the text, whether in a marked article or main part, text) of each block that may be content."""
    spark = prepare(pages)
    keep = [c for c in pages.columns if c != html]
    d = groups(pages, page_id, url, html)
    order = F.struct(F.col("_h").alias("h"), F.col(page_id).cast("string").alias("i"), F.col(url).alias("u"))
    first = d.where(F.length(html) > 0).groupBy("_host").agg(F.min(order).alias("_o")).select("_host", F.col("_o.h").alias("_h"))
    first = stored(spark, first, "references")
    refs = d.where(F.length(html) > 0).join(F.broadcast(first) if first.count() <= BROADCAST_GROUPS else first, ["_host", "_h"])
    refs = stored(spark, refs.groupBy("_host").agg(F.max(html).alias("_ref")), "reference-pages")
    small = (refs.agg(F.sum(F.octet_length("_ref") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    joined = d.join(F.broadcast(refs) if small else refs, "_host", "left")
    k = len(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*keep).schema.fields)
    block_type = pa.list_(pa.struct([("node", pa.int32()), ("h", pa.int64()), ("marked", pa.bool_()), ("text", pa.string())]))

    def run(batches):
        import xxhash

        known: dict[str, Page] = {}
        for b in batches:
            out, digests = [], []
            for html_, host, ref in zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist(), b.column(k + 2).to_pylist(), strict=True):
                if host not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[host] = Page(ref or "")
                page = Page(html_ or "")
                partner = align(page, known[host])
                rows = [{"node": partner.get(i, -1), "h": xxhash.xxh64_intdigest(page.text[i]) - (1 << 63), "marked": bool(page.state[i] & 6), "text": page.text[i]} for i in page.blocks()]
                out.append(rows)
                digests.append(xxhash.xxh64_intdigest("\n".join(r["text"] for r in rows)) - (1 << 63))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], b.column(k + 1), pa.array(digests, pa.int64()), pa.array(out, block_type)], names=[*keep, "_host", "_digest", "_blocks"])

    return joined.select(*keep, F.col(html), "_host", "_ref").mapInArrow(run, f"{fields}, _host string, _digest long, _blocks array<struct<node:int,h:bigint,marked:boolean,text:string>>")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` but the html, with ``text`` (blocks in page order, joined by a line feed) and
    ``n_chars``.

    A null or empty html, and a page without content, give the empty text. Rows without a host (null or odd urls) form one
    host. Repeated pages get equal results; they count once as evidence. Columns named text or n_chars are replaced.
    """
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    d = stored(spark, page_blocks(pages.select(*keep), page_id, url, html), "page-blocks")
    counted = d.select("_host", "_digest", F.explode("_blocks").alias("b")).where("b.node >= 0").select("_host", "_digest", "b.node", "b.h", "b.marked").distinct()
    counted = counted.groupBy("_host", "node", "h", "marked").agg(F.count("*").alias("n")).where(F.col("n") >= CONSTANT_PAGES * CONSTANT_SHARE)
    hosts = d.groupBy("_host", "_digest").count().groupBy("_host").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= CONSTANT_PAGES)
    enough = F.col("n") >= CONSTANT_SHARE * F.col("_pages")
    constant = counted.join(hosts, "_host").where(enough & (~F.col("marked") | (F.col("_pages") >= MARKED_PAGES)))
    # at most one text per node can be constant, so this is no longer than the group's reference page
    constant = stored(spark, constant.select("_host", "node", "h", "marked"), "template")
    template = constant.groupBy("_host").agg(F.collect_list(F.struct("node", "h", "marked")).alias("_template"))
    small = (constant.agg(F.sum(F.octet_length("_host") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    d = d.join(F.broadcast(template) if small else template, "_host", "left")
    slots = F.when(F.col("_template").isNull(), F.col("_blocks")).otherwise(
        F.filter("_blocks", lambda b: ~F.array_contains("_template", F.struct(b["node"].alias("node"), b["h"].alias("h"), b["marked"].alias("marked")))))
    text = F.array_join(F.transform(slots, lambda b: b["text"]), "\n")
    out = d.select(*[c for c in keep if c != html], text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op7_wrapper_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
