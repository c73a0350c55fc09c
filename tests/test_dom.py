"""Section extraction as joins over DOM rows equals the walk of the tree, on nested, broken and empty pages."""
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shapeindex.config import ARTICLE_RULES, LIBRARY_RULES, TUTORIAL_RULES
from shapeindex.functions import htmltree
from shapeindex.operators import dom as D
from shapeindex.operators import html as H
from shapeindex.session import ensure_checkpoint_dir


def random_page(rng, deep=4):
    def code():
        text = rng.choice(["x = a.b()", "def (:", "", "# only", ">>> y", "1 < 2"])
        return f'<div class="highlight-python3 notranslate"><pre>{text}<span>{rng.choice(["", "z = 1", "... w"])}</span></pre></div>'

    def header(k):
        link = rng.choice(["", f'<a class="headerlink" href="#h{k}">¶</a>', '<a class="headerlink">¶</a>', '<a class="headerlink" href="">¶</a>'])
        return f'<h{rng.randint(1, 4)}>T{k} <code>c<em>{k}</em></code> <b>bold <code>in</code></b>{link}</h2>'

    def dl(d):
        out = "<dl>"
        for _ in range(rng.randint(1, 2)):
            ident = rng.choice([f' id="d{rng.randint(0, 99)}"', "", ' id=""'])
            out += f'<dt{ident}>n{rng.choice(["", "<a class=headerlink href=#q%d>p</a>" % rng.randint(0, 9)])}</dt>'
            inner = code() if rng.random() < 0.7 else ""
            if d > 0 and rng.random() < 0.5:
                inner += dl(d - 1)
            if rng.random() < 0.2:
                inner += f"<div>{dl(0)}{code()}</div>"
            out += f"<dd>{inner}</dd>"
        return out + "</dl>"

    def section(d):
        k = rng.randint(0, 999)
        parts = [header(k)] * rng.randint(0, 2) + [code()] * rng.randint(0, 1)
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice([code, lambda: dl(2), lambda: section(d - 1) if d else "", lambda: f"<div>{section(d - 1) if d else ''}{code()}</div>",
                                     lambda: "<p>text", lambda: "<script>x <code>y</code></script>", lambda: f"<h1><style>s</style>{header(k)}</h1>"])())
        return f'<div class="a section {k}" id="s{k}">{"".join(parts)}</div>' + rng.choice(["", "</div>", "</p>"])

    return f"<html><body>{code()}<ul><li class='toctree-l1'><a href='x'>x</a></li></ul>{''.join(section(deep) for _ in range(rng.randint(0, 3)))}"


@pytest.mark.parametrize("rules", [LIBRARY_RULES, TUTORIAL_RULES, ARTICLE_RULES], ids=lambda r: r.name)
def test_joins_equal_the_walk(spark, rules):
    rng = random.Random(7)
    pages = [(i, f"https://h/{i}/p.html", random_page(rng)) for i in range(60)] 
    pages += [(60, "https://h/a", None), (61, None, pages[3][2]), (62, "https://h/b", ""), (63, "https://h/c", "<div class=section>" * 40 + "<div class=highlight-python3>x = 1</div>"),
              (64, "https://h/d", "<article><h1>A</h1><p>x = 1<p>y = 2</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r.page, r.ord): (r.title, r.url, r.snippets_raw, r.code_snippets, r.skipped) for r in D.extract_items(df, F.col("page_id"), rules).collect()}
    want = {}
    for i, url, html in pages:
        for k, (title, u, raw) in enumerate(htmltree.section_items(htmltree.parse_html(html), url or "", rules)):
            ok = [s for s in raw if H.is_valid_snippet(s)]
            want[i, k] = (title, u, raw, ok, len(raw) - len(ok))
    assert got == want and len(want) > (20 if rules.section_tag == "div" and rules.definitions else 0)
    plain = H.extract_sections(df, rules, key_cols=("page_id",)).select("page_id", "ord", "title", "url", "snippets_raw", "code_snippets", "skipped")
    assert {(r[0], r[1]): tuple(r)[2:] for r in plain.collect()} == got


def test_rows_are_intervals(spark):
    page = spark.createDataFrame([(1, "<div class='a b'><p id=x>one<p>two<script>h</script></div>tail")], "k long, html string")
    rows = {r.pre: r for r in D.dom(page, F.col("k")).collect()}
    assert [rows[k].tag for k in sorted(rows)] == ["#root", "div", "p", "#text", "p", "#text", "script", "#hidden", "#text"]
    assert (rows[0].size, rows[1].size, rows[2].size) == (9, 7, 2) and rows[2].id == "x" and rows[1].cls == "a b"
    for r in rows.values():
        if r.parent >= 0:
            p = rows[r.parent]
            assert p.pre < r.pre < p.pre + p.size and r.depth == p.depth + 1 and r.parent_tag == p.tag


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert D.extract_items(df, F.col("page_id")).count() == 0


def test_empty_items_do_not_win(spark):
    df = spark.createDataFrame([(1, 0, "u", []), (1, 1, "u", ["a"]), (2, 0, "u", ["b"])], "page long, ord int, url string, code_snippets array<string>")
    assert [(r.page, r.ord) for r in D.clean_items(df).collect()] == [(1, 1)]


def test_pages_of_one_file_are_parsed_by_many_tasks(spark):
    pages = spark.createDataFrame([(i, "<div class=section></div>") for i in range(50)], "k long, html string").coalesce(1)
    tasks = D.dom(pages, F.col("k")).select("page", F.spark_partition_id().alias("t")).distinct().collect()
    assert len({r.page for r in tasks}) == 50 and len({r.t for r in tasks}) > 1


def test_plain_markup_gives_the_tree_of_the_parser():
    pieces = ['<div class="a b">', "</div>", "<p>", "<dl>", '<dt id="x" id="y">', "<dd>", "</dl>", "text", "a &lt; b", "&amp", "<br>", '<a href="u?x=1">', "</a>", "\n", "é ¶",
              "<br/>", "<script>", "</script>", "<!-- c -->", "<DIV>", "< ", "<p id=k>", '<p id="a&amp;b">', '<p id="a>b">', "&"]
    rng, plain = random.Random(5), 0
    for k in range(4000):
        html = "".join(rng.choice(pieces[: 15 if k % 2 else None]) for _ in range(rng.randint(0, 9)))
        b = htmltree._Builder()
        b.feed(html)
        b.close()
        assert htmltree.rows(htmltree.parse_html(html)) == htmltree.rows(b.root), html
        plain += htmltree._plain_tokens(html) is not None
    assert 1000 < plain < 4000


def test_snippets_are_checked_in_their_row(spark):
    page = (1, "u", '<div class="section"><h1>a</h1><div class="highlight-python3">x = 1</div><div class="highlight-python3">def (:</div></div>')
    df = spark.createDataFrame([page], "page_id long, url string, html string")
    once = D.extract_items(df, F.col("page_id")).collect()
    assert [(r.snippets_raw, r.code_snippets, r.skipped) for r in once] == [(["x = 1", "def (:"], ["x = 1"], 1)]


def test_node_rows_are_not_written(spark):
    """Items are joined where a page's rows are: nothing is left in the shared folder, and pages are sent once, by their key."""
    root = ensure_checkpoint_dir(spark).removeprefix("file://")
    page = (1, "u", '<div class="section"><h1>a</h1><div class="highlight-python3">x = 1</div></div>')
    df = spark.createDataFrame([page], "page_id long, url string, html string")
    before = set(os.listdir(root))
    found = D.extract_items(df, F.col("page_id"))
    assert found.count() == 1 and not {n for n in set(os.listdir(root)) - before if n.startswith("dom")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1 and plan.count("Repartition") == 1


def test_first_items_take_one_pass_over_pages(spark):
    page = '<div class="section"><h1>a<a class="headerlink" href="#%s">x</a></h1><div class="highlight-python3">x = %d</div></div>'
    df = spark.createDataFrame([(1, "u", page % ("b", 1)), (2, "u", page % ("b", 2)), (3, "u", page % ("c", 3))], "page_id long, url string, html string")
    kept = D.clean_items(D.extract_items(df, F.col("page_id")))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1 and "Relation" not in plan
    assert sorted((r.page, r.url, r.code_snippets) for r in kept.collect()) == [(1, "u#b", ["x = 1"]), (3, "u#c", ["x = 3"])]


def test_more_tables_behind_pages_make_more_tasks(spark, tmp_path):
    """The estimate of a join of small tables is their product; tasks follow the tables."""
    spark.range(1000).selectExpr("id", "concat('<p>', id, '</p>') as html", "'u' as url").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    least = 2 * spark.sparkContext.defaultParallelism
    joined = t.join(t.select("id", F.lit(1).alias("a")), "id", "left").join(t.select("id", F.col("html").alias("b")), "id", "left")
    assert D._page_tasks(joined) == least
    monkey, D.SPREAD_TASK_BYTES = D.SPREAD_TASK_BYTES, 100
    try:
        assert D._page_tasks(joined) > least
    finally:
        D.SPREAD_TASK_BYTES = monkey


def test_rows_of_markup_without_a_tree():
    rng = random.Random(11)
    pieces = ['<div class="a b">', "</div>", "<p>", "</p>", "<dl>", '<dt id="x" id="y">', "<dd>", "</dl>", "text", "a &lt; b", "<br>", '<a href="u?x=1">', "</a>", "<table>", "</table>", "<li>",
              "<ul>", "</ul>", "<button>", "</html>", "<html>", "&amp", "<script>", "</script>", "< ", "<!-- c -->"]
    for k in range(4000):
        html = "".join(rng.choice(pieces[: 21 if k % 2 else None]) for _ in range(rng.randint(0, 14)))
        assert htmltree.markup_rows(html) == htmltree.rows(htmltree.parse_html(html)), html
    assert htmltree.markup_rows(None) == htmltree.rows(htmltree.parse_html(None))


def test_pages_of_a_key_stay_together(monkeypatch):
    monkeypatch.setattr(D, "PAGE_BYTES", 10)
    rows = [(k // 3, "u", "x" * 4) for k in range(20)]
    batches = [pa.RecordBatch.from_pydict({"page": [r[0] for r in rows[a:b]], "url": [r[1] for r in rows[a:b]], "html": [r[2] for r in rows[a:b]]}) for a, b in ((0, 4), (4, 5), (5, 16), (16, 20))]
    out = [b.column(0).to_pylist() for b in D._whole_pages(batches)]
    assert [k for b in out for k in b] == [r[0] for r in rows] and len(out) > 3
    assert all(a[-1] < b[0] for a, b in zip(out, out[1:]))


def test_deeply_nested_definitions(spark):
    code = '<div class="highlight-python3">x = 1</div>'
    page = '<div class="section"><h1>a</h1>' + "".join(f'<dl><dt id="d{k}">n</dt><dd>{code}' for k in range(400)) + "</dd></dl>" * 400 + "</div>"
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    got = [(r.title, r.url, r.snippets_raw) for r in sorted(D.extract_items(df, F.col("page_id")).collect(), key=lambda r: r.ord)]
    assert got == htmltree.section_items(htmltree.parse_html(page), "u", LIBRARY_RULES) and len(got) == 400
