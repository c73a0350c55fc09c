"""The README flow end to end: repositories and documentation pages into one index, then search."""
import os
import shutil
import tempfile

from pyspark.sql import functions as F

from shapeindex.config import LIBRARY_RULES, SearchOptions
from shapeindex.operators import html as H
from shapeindex.operators import index as I
from shapeindex.operators import search as S
from shapeindex.session import scratch_path
from shapeindex.sources.files import scan_sources

from test_html import BASE, DEMO, TOC


def test_readme_flow(spark):
    clones = tempfile.mkdtemp()
    os.makedirs(os.path.join(clones, "heapq", "lib"))
    shutil.copy(os.path.join(os.path.dirname(os.__file__), "heapq.py"), os.path.join(clones, "heapq", "lib", "heapq.py"))
    with open(os.path.join(clones, "heapq", "lib", "broken.py"), "w") as f:
        f.write("def (:\n")
    repos = spark.createDataFrame([("heapq", "https://github.com/x/heapq", "abc")], "name string, html_url string, head string")
    idx = I.create_index(spark, scratch_path(spark, "readme"))
    files, undecodable = scan_sources(spark, clones)
    assert undecodable.count() == 0
    accepted, rejected = I.add_documents(idx, H.files_to_documents(files, repos))
    assert (accepted, rejected) == (1, 1)

    pages = spark.createDataFrame([(BASE + "index.html", TOC), (BASE + "demo.html", DEMO)], "url string, html string")
    seeds = spark.createDataFrame([(BASE + "index.html",)], "url string")
    items = H.crawl_items(pages, seeds, LIBRARY_RULES)
    assert I.update_items(idx, items.select("title", "url", "code_snippets", F.col("ord").cast("long").alias("item_ord"))) == (2, 0)

    qs = spark.createDataFrame([(1, "while pos > startpos:\n    parentpos = (pos - 1) >> 1\n    parent = heap[parentpos]"),
                                (2, "q = k.load()")], "query_id long, code string")
    hits, results = S.search(idx, qs, SearchOptions(k=10))
    got = {r.query_id: r for r in hits.where("rank = 1").collect()}
    assert got[1].title.repo == "heapq" and got[1].title.filename == "heapq.py"
    assert "/blob/abc/lib/heapq.py#L" in got[1].url
    # not a docs.python.org url: the title splits at its first space and a line anchor is added
    assert got[2].url == BASE + "demo.html#module-demo#L1" and got[2].title.repo == "15.1."
    js = [r.json for r in S.results_json(results).collect()]
    assert all('"has_results":true' in j for j in js)
