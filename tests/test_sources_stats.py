"""Sources (repository list, file scan, item feeds, metadata) and corpus statistics."""
import json
import os
import tempfile

from shapeindex.operators import stats as ST
from shapeindex.sources import files, items, repos


def test_read_and_select_repos(spark):
    d = tempfile.mkdtemp()
    data = [{"name": f"r{i}", "clone_url": "c", "html_url": f"https://github.com/x/r{i}", "language": "Python",
             "stars": i, "size_kb": 20000 if i % 2 else 5000} for i in range(15)]
    with open(os.path.join(d, "repos.json"), "w") as f:
        json.dump(data, f)
    r = repos.read_repos(spark, os.path.join(d, "repos.json"))
    assert r.count() == 15
    sel = [x.name for x in repos.select_repos(r).collect()]
    assert sel == [f"r{i}" for i in (13, 11, 9, 7, 5, 3)]


def test_scan_sources(spark):
    root = tempfile.mkdtemp()
    os.makedirs(os.path.join(root, "flask", "src"))
    os.makedirs(os.path.join(root, "flask", ".git"))
    with open(os.path.join(root, "flask", "src", "app.py"), "wb") as f:
        f.write(b"x = 1\r\ny = 2\r\n")
    with open(os.path.join(root, "flask", ".git", "hook.py"), "wb") as f:
        f.write(b"z = 3\n")
    with open(os.path.join(root, "flask", "bad.py"), "wb") as f:
        f.write(b"\xff\xfe\x00bad")
    with open(os.path.join(root, "flask", "notes.txt"), "wb") as f:
        f.write(b"text")
    ok, skipped = files.scan_sources(spark, root)
    rows = ok.collect()
    assert [(r.repo, r.relpath, r.filename, r.content) for r in rows] == [("flask", "src/app.py", "app.py", "x = 1\ny = 2\n")]
    assert [r.relpath for r in skipped.collect()] == ["bad.py"]


def test_items_feeds_and_meta(spark):
    d = tempfile.mkdtemp()
    a = spark.createDataFrame([("t1", "u1", ["x = a.b()"])], "title string, url string, code_snippets array<string>")
    b = spark.createDataFrame([("t2", "u2", ["y = c.d()"])], "title string, url string, code_snippets array<string>")
    items.write_items(a, os.path.join(d, "tutorial"))
    items.write_items(b, os.path.join(d, "library"))
    u = items.read_items(spark, os.path.join(d, "tutorial"), os.path.join(d, "library"))
    assert sorted((r.feed, r.url) for r in u.collect()) == [(0, "u1"), (1, "u2")]
    f = spark.createDataFrame([("r1", "x = 1\n\n# c\ny = 2\n"), ("r2", "  # only\n")], "repo string, content string")
    meta = ST.corpus_meta(f)
    assert tuple(meta.first()) == (2, 2)
    items.write_meta(meta, os.path.join(d, "meta"))
    assert tuple(items.read_meta(spark, os.path.join(d, "meta")).first()) == (2, 2)


def test_stats(spark):
    f = spark.createDataFrame([("r1", True, "a\n"), ("r1", False, ""), ("r2", True, "b\nc\n")],
                              "repo string, valid boolean, content string")
    rep = {r.repo: (r.accepted, r.skipped) for r in ST.ingest_report(f, with_total=True).collect()}
    assert rep == {"r1": (1, 1), "r2": (1, 0), None: (2, 1)}
    assert ST.repo_count(f).first().repo_count == 2
    assert ST.code_line_count(f).first().python_line_count == 3


def test_scan_sources_root_name_repeated(spark):
    root = os.path.join(tempfile.mkdtemp(), "repos")
    os.makedirs(os.path.join(root, "alpha", "repos"))
    with open(os.path.join(root, "alpha", "repos", "m.py"), "w") as f:
        f.write("x = 1\n")
    ok, _ = files.scan_sources(spark, root)
    assert [(r.repo, r.relpath) for r in ok.collect()] == [("alpha", "repos/m.py")]
