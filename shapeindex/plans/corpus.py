"""Inputs derived in Spark from the driver's tables.

The given tables hold no Python code, so the structural operators run on a code corpus made
from ``lineitem`` rows: every row becomes one snippet of template ``(l_orderkey + l_linenumber) % 8``
(FIXTURES §2), named after its keys. Names never reach a term, so each template's node and term
counts are known constants and DuckDB can check results in closed form. Queries come from
``supplier`` rows the same way.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import QUERIES, TEMPLATES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _by_template(t: Column, texts: dict, k: Column) -> Column:
    out = None
    for key, text in texts.items():
        v = F.replace(F.lit(text), F.lit("{k}"), k)
        out = F.when(t == key, v) if out is None else out.when(t == key, v)
    return out


def snippet_key(orderkey: Column, linenumber: Column, extendedprice: Column) -> Column:
    """Ordered id of a lineitem row: (order, line number, price in cents), unique in the given
    tables and inside 63 bits up to scale factor 100."""
    cents = F.round(extendedprice * 100).cast("long")
    return ((orderkey * 8 + linenumber) * F.lit(10 ** 8) + cents).cast("long")


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snippet_id, template, repo, title, url, content) per lineitem row."""
    return code_corpus_from(table(spark, sf_dir, "lineitem"))


def code_corpus_from(lineitem: DataFrame) -> DataFrame:
    """The code corpus of any lineitem DataFrame (batch or stream).

    Rows with return flag ``R`` play documentation snippets (docs url, title used as filename),
    the others repository files (``"{repo} {file}"`` titles, blob urls).
    """
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    sid = snippet_key(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice"))
    t = ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).cast("int")
    repo = F.concat(F.lit("r"), F.col("l_suppkey").cast("string"))
    file = F.concat(F.lit("f"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(".py"))
    docs = F.col("l_returnflag") == "R"
    title = F.when(docs, F.concat(F.lit("T: m"), F.col("l_partkey").cast("string"), F.lit(".f"), sid.cast("string"))) \
        .otherwise(F.concat_ws(" ", repo, file))
    url = F.when(docs, F.concat(F.lit("https://docs.python.org/3/library/m"), F.col("l_partkey").cast("string"),
                                F.lit(".html#f"), sid.cast("string"))) \
        .otherwise(F.concat(F.lit("https://github.com/x/"), repo, F.lit("/blob/h"), F.col("l_suppkey").cast("string"),
                            F.lit("/src/"), file))
    return li.select(sid.alias("snippet_id"), t.alias("template"), repo.alias("repo"), title.alias("title"),
                     url.alias("url"), _by_template(t, TEMPLATES, F.col("l_orderkey").cast("string")).alias("content"))


def line_statement(line: Column) -> Column:
    """One statement whose attributes and literals come from a line of text: its length, and the head of its MD5."""
    n = F.length(line)
    return F.concat(F.lit("v = doc.m"), (n % 40).cast("string"), F.lit("('"), F.substring(F.md5(line), 1, 8), F.lit("', "),
                    n.cast("string"), F.lit(").k"), (n % 3).cast("string"))


def text_statements(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line_statement)


def document_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snippet_id, title, url, content) per row of ``documents``: code with one statement per line of the text, so which
    terms there are, where and how often, depends on the data."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    doc = F.col("doc_id").cast("string")
    return d.select(F.col("doc_id").alias("snippet_id"), F.concat_ws(" ", "source", F.concat(F.lit("d"), doc, F.lit(".py"))).alias("title"),
                    F.concat(F.lit("https://h/d"), doc).alias("url"), F.array_join(text_statements(F.col("text")), "\n").alias("content"))


def document_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, code): the first three statements of every document whose id is divisible by 20."""
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % 20 == 0)
    return d.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(text_statements(F.col("text")), 1, 3), "\n").alias("code"))


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snippet_id, title, url, content) per part: name, brand and type as one text."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("snippet_id"), F.lit("").alias("title"), F.col("p_brand").alias("url"),
                    F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("content"))


def code_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, qtemplate, code) per supplier row, query template ``s_suppkey % 7``."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    qt = (F.col("s_suppkey") % 7).cast("int")
    texts = {k: v[0] for k, v in QUERIES.items()}
    return s.select(F.col("s_suppkey").cast("long").alias("query_id"), qt.alias("qtemplate"),
                    _by_template(qt, texts, F.col("s_suppkey").cast("string")).alias("code"))


# --------------------------------------------------------------------------- manual pages

def _block(code: Column) -> Column:
    return F.concat(F.lit('<div class="highlight-python3"><pre>'), code, F.lit("</pre></div>"))


def _header(tag: str, text: Column, link: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), text, F.lit('<a class="headerlink" href="#'), link, F.lit(f'">¶</a></{tag}>'))


def manual_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(custkey, url, html): one page of documentation markup per customer. Its section holds one section per order, an order's
    section a definition per line, every other definition one more inside. Some snippets do not parse, some texts are shell prompts."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    part = F.col("l_partkey").cast("string")
    code = F.when(F.col("l_partkey") % 10 == 0, F.lit("def (:")).otherwise(F.concat(F.lit("x = a.m"), F.col("l_suppkey").cast("string"), F.lit("()")))
    inner = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('<dl><dt>q</dt><dd><div class="highlight-python3"><pre>&gt;&gt;&gt; shell</pre><pre>y = '),
                                                             F.col("l_linenumber").cast("string"), F.lit("</pre></div></dd></dl>"))).otherwise("")
    dl = F.concat(F.lit('<dl><dt id="p'), part, F.lit('">p<a class="headerlink" href="#p'), part, F.lit('">¶</a></dt><dd>'), _block(code), inner, F.lit("</dd></dl>"))
    lines = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", dl.alias("dl")))), lambda x: x["dl"]), "").alias("defs"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey").cast("string")
    own = F.when(F.col("o_orderstatus") == "F", _block(F.concat(F.lit("z = o.n"), key, F.lit("()")))).otherwise("")
    section = F.concat(F.lit('<div class="section" id="o'), key, F.lit('">'), _header("h2", F.concat(F.lit("Order <code>"), key, F.lit("</code>")), F.concat(F.lit("o"), key)),
                       own, F.coalesce("defs", F.lit("")), F.lit("</div>"))
    orders = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", section.alias("s")))), lambda x: x["s"]), "").alias("orders"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    cust = F.col("c_custkey").cast("string")
    html = F.concat(F.lit('<html><body><p>intro</p><div class="section"><h1>Customer <em>no</em>'), F.col("c_name"), F.lit("</h1>"),
                    _block(F.concat(F.lit("w = c.m"), cust, F.lit("()"))), F.coalesce("orders", F.lit("")), F.lit("</div></body></html>"))
    return c.select(F.col("c_custkey").alias("custkey"), F.concat(F.lit("https://h/c"), cust, F.lit(".html")).alias("url"), html.alias("html"))


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html): one page per customer with links to the customers of twice its number and one more, and, of every tenth,
    back to a tenth of its number and to itself: a tree with cycles. Links to pages that do not exist lead nowhere."""
    k = F.col("c_custkey")

    def link(n: Column) -> Column:
        return F.concat(F.lit('<ul><li class="toctree-l1"><a class="reference" href="c'), n.cast("string"), F.lit('.html">x</a></li></ul>'))

    back = F.when(k % 10 == 0, F.concat(link(F.floor(k / 10)), link(k))).otherwise("")
    html = F.concat(F.lit("<html><body>"), link(k * 2), link(k * 2 + 1), back, F.lit("</body></html>"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("https://h/c"), k.cast("string"), F.lit(".html")).alias("url"), html.alias("html"))
