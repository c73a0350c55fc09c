"""HTML extraction: FIXTURES §5 golden, toc links, url resolution, crawl, dedup, drop-empty."""
from urllib.parse import urljoin

from pyspark.sql import functions as F

from shapeindex.config import LIBRARY_RULES, TUTORIAL_RULES
from shapeindex.operators import html as H

DEMO = """<div class="section" id="demo">
<h1>15.1. <code><span class="pre">demo</span></code> - Demo<a class="headerlink" href="#module-demo">P</a></h1>
<div class="highlight-python3"><div class="highlight"><pre><span class="gp">&gt;&gt;&gt; </span><span class="n">v</span> = cfg.load()
</pre></div></div>
<div class="section" id="sub"><h2>15.1.1. Sub<a class="headerlink" href="#sub">P</a></h2>
<div class="highlight-python3"><pre>def broken(:</pre></div></div>
<dl class="function"><dt id="demo.run">demo.run()<a class="headerlink" href="#demo.run">P</a></dt>
<dd><p>Text</p><div class="highlight-python3"><pre>print(demo.run())
</pre></div></dd></dl>
</div>"""
BASE = "http://localhost:8000/library/"
TOC = '<ul><li class="toctree-l1"><a href="demo.html">Demo</a></li></ul>'


def _pages(spark):
    return spark.createDataFrame([(BASE + "index.html", TOC), (BASE + "demo.html", DEMO)], "url string, html string")


def test_sections_golden(spark):
    rows = H.extract_sections(_pages(spark).where(F.col("url").endswith("demo.html")), LIBRARY_RULES).orderBy("ord").collect()
    assert [(r.ord, r.title, r.url.rsplit("/", 1)[1], r.code_snippets) for r in rows] == [
        (0, "15.1.1. Sub", "demo.html#sub", []),
        (1, "15.1. demo - Demo: demo.run", "demo.html#demo.run", ["print(demo.run())\n"]),
        (2, "15.1. demo - Demo", "demo.html#module-demo", ["v = cfg.load()\n"]),
    ]
    assert rows[0].skipped == 1
    tut = H.extract_sections(_pages(spark).where(F.col("url").endswith("demo.html")), TUTORIAL_RULES).collect()
    assert [r.title for r in tut] == ["15.1.1. Sub", "15.1. demo - Demo"]


def test_toc_links(spark):
    links = H.toc_links(_pages(spark), LIBRARY_RULES).collect()
    assert [(r.url, r.link) for r in links] == [(BASE + "index.html", BASE + "demo.html")]


def test_crawl_and_items(spark):
    seeds = spark.createDataFrame([(BASE + "index.html",)], "url string")
    c = {r.url: (r.depth, r.is_leaf) for r in H.crawl(_pages(spark), seeds, LIBRARY_RULES).collect()}
    assert c == {BASE + "index.html": (0, False), BASE + "demo.html": (1, True)}
    items = H.crawl_items(_pages(spark), seeds, LIBRARY_RULES).orderBy("ord").collect()
    assert [r.title for r in items] == ["15.1. demo - Demo: demo.run", "15.1. demo - Demo"]  # empty Sub dropped


def test_dedup_first_wins_after_drop_empty(spark):
    items = spark.createDataFrame([(0, "u1", []), (1, "u1", ["a"]), (2, "u1", ["b"]), (3, "u2", ["c"])],
                                  "seq int, url string, code_snippets array<string>")
    out = H.dedup_by_url(H.drop_empty_items(items), [F.col("seq")]).orderBy("seq").collect()
    assert [(r.url, r.code_snippets) for r in out] == [("u1", ["a"]), ("u2", ["c"])]


def test_resolve_url_matches_urljoin(spark):
    cases = [("http://h.org/a/b.html?x=1#f", h) for h in
             ["/p", "#frag", "c.html", "?q=2", "//other.net/x", "https://z.com/y", None, "",
              "../c.html", "./c.html", "../../../x", "d/../e", "d/./e/", ".", "..", "/a/b/../c?q#f",
              "../d/../e/./f#g", "x/y/z/../../w"]]
    cases += [("http://h.org", "x.html"), ("http://h.org/dir/", "../up.html"), ("https://h.org/a/b/c/d.html", "../../e")]
    df = spark.createDataFrame(cases, "base string, href string")
    got = [r.u for r in df.select(H.resolve_url(F.col("base"), F.col("href")).alias("u")).collect()]
    assert got == [urljoin(b, h) if h else b for b, h in cases]


def test_snippet_text_pieces(spark):
    df = spark.createDataFrame([(["x = 1\n", ">>> y", "... z", "w\n"],)], "p array<string>")
    assert df.select(H.snippet_text_from_pieces(F.col("p")).alias("t")).first().t == "x = 1\nw\n"


def test_files_to_documents(spark):
    files = spark.createDataFrame([("flask", "src/app.py", "x = 1"), ("nope", "a.py", "")], "repo string, relpath string, content string")
    repos = spark.createDataFrame([("flask", "https://github.com/x/flask", "abc")], "name string, html_url string, head string")
    r = H.files_to_documents(files, repos).collect()
    assert [(x.title, x.url) for x in r] == [("flask app.py", "https://github.com/x/flask/blob/abc/src/app.py")]


def test_tutorial_crawl_is_one_level(spark):
    toc2 = '<ul><li class="toctree-l1"><a href="other.html">O</a></li></ul>'
    pages = spark.createDataFrame([(BASE + "index.html", TOC), (BASE + "demo.html", toc2 + DEMO),
                                   (BASE + "other.html", DEMO)], "url string, html string")
    seeds = spark.createDataFrame([(BASE + "index.html",)], "url string")
    tut = {r.url: (r.depth, r.is_leaf) for r in H.crawl(pages, seeds, TUTORIAL_RULES).collect()}
    assert tut == {BASE + "index.html": (0, False), BASE + "demo.html": (1, True)}
    lib = {r.url: (r.depth, r.is_leaf) for r in H.crawl(pages, seeds, LIBRARY_RULES).collect()}
    assert lib == {BASE + "index.html": (0, False), BASE + "demo.html": (1, False), BASE + "other.html": (2, True)}


def test_regex_links_equal_parser_links(spark):
    from shapeindex.config import ARTICLE_RULES
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    a = sorted(tuple(r) for r in H.toc_links(pages, ARTICLE_RULES, key_cols=("page_id",)).select("page_id", "ord", "link").collect())
    b = sorted(tuple(r) for r in H.toc_links_regex(pages, "nav", key_cols=("page_id",)).select("page_id", "ord", "link").collect())
    assert a == b and len(a) > 0


def test_unescape_simple_matches_python(spark):
    import html as pyhtml
    samples = ["a&amp;b", "a&ampb", "x&lt;y&gt;z", "x&lty", "&quot;q&quot", "it&#39;s", "&amp;lt;", "plain"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r.u for r in df.select(H.unescape_simple(F.col("s")).alias("u")).collect()]
    assert got == [pyhtml.unescape(s) for s in samples]


def test_bad_pages_do_not_fail_a_job(spark):
    """An href that can't be resolved stays as written; depth is no limit."""
    from shapeindex.config import LIBRARY_RULES, HtmlRules
    import dataclasses

    deep = "<div class='section'><h1>t</h1>" * 1500 + "<div class='highlight'><pre>x = a.f()</pre></div>" + "</div>" * 1500
    rules = dataclasses.replace(LIBRARY_RULES, toc_container="nav", section_tag="div", section_class="section", code_tag="div", code_class="highlight")
    assert isinstance(rules, HtmlRules)
    pages = spark.createDataFrame(
        [("http://h/a", "<nav><a href='http://[bad/'>x</a><a href='b'>y</a></nav>"), ("http://h/deep", deep), (None, None)], "url string, html string")
    from shapeindex.operators import html as H

    assert sorted((r.href, r.link) for r in H.toc_links(pages, rules).collect()) == [("b", "http://h/b"), ("http://[bad/", "http://[bad/")]
    assert [(r.title, r.code_snippets) for r in H.extract_sections(pages, rules).collect()] == [("t", ["x = a.f()"])]


def test_dot_segments_have_no_limit(spark):
    from urllib.parse import urljoin

    from shapeindex.operators.html import resolve_url

    base = "http://h/d/a.html"
    hrefs = ["x/" * 20 + "../" * 20 + "x.html", "../" * 30 + "y", "./././z", "a/..", "a/.", "..", ".", "a/b/../../c/./d/../e?q#f", "/a/../b"]
    df = spark.createDataFrame([(h,) for h in hrefs], "h string")
    got = {r.h: r.u for r in df.select("h", resolve_url(F.lit(base), F.col("h")).alias("u")).collect()}
    assert got == {h: urljoin(base, h) for h in hrefs}
