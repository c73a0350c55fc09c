"""Repository lists of the published form, and their ingestion under a budget."""
import json
import os
import tempfile

from shapeindex.operators import index as I
from shapeindex.operators.ingest import ingest_repositories
from shapeindex.session import scratch_path
from shapeindex.sources import repos
from shapeindex.sources.files import scan_sources


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return path


def test_published_list(spark):
    d = tempfile.mkdtemp()
    records = [{"id": 1, "name": "flask", "clone_url": "c", "html_url": "https://github.com/p/flask", "language": "Python", "stargazers_count": 30000, "size": 20001,
                "owner": {"login": "p"}, "topics": ["web"]},
               {"name": "old", "html_url": "h", "language": "Python", "stars": 5, "size_kb": 30000, "head": "abc"},
               {"name": "bad", "stargazers_count": "many", "size": 99999}, 5, None, {"language": "Python", "stargazers_count": 9}, "text"]
    path = write(d, "repo_data.json", json.dumps(records))
    got = {r.name: r for r in repos.read_repos(spark, path).collect()}
    assert set(got) == {"flask", "old"} and (got["flask"].stars, got["flask"].size_kb, got["flask"].seq) == (30000, 20001, 0)
    assert (got["old"].stars, got["old"].size_kb, got["old"].head) == (5, 30000, "abc")
    assert [r.name for r in repos.select_repos(repos.read_repos(spark, path)).collect()] == ["flask", "old"]
    left = {r.seq: r.record for r in repos.rejected_repos(spark, path).collect()}
    assert set(left) == {2, 3, 4, 5, 6} and json.loads(left[2])["stargazers_count"] == "many" and left[3] == "5"


def test_list_that_is_no_array(spark):
    path = write(tempfile.mkdtemp(), "repos.json", "{broken")
    assert repos.read_repos(spark, path).count() == 0
    assert [r.record for r in repos.rejected_repos(spark, path).collect()] == ["{broken"]
    empty = write(tempfile.mkdtemp(), "repos.json", "[]")
    assert repos.read_repos(spark, empty).count() == 0 and repos.rejected_repos(spark, empty).count() == 0


def test_ingestion_under_a_budget(spark):
    root = tempfile.mkdtemp()
    good = "v = cfg.load()\n"
    write(root, "a/one.py", good)
    write(root, "a/sub/two.py", "def (:\n")
    write(root, "a/sub/three.py", b"\xff\xfe\x00")
    write(root, "a/.git/hook.py", good)
    write(root, "b/x.py", good * 10)
    write(root, "c/y.py", good)
    write(root, "unlisted/z.py", good)
    names = ["a", "missing", "b", "a", "c"]
    listed = spark.createDataFrame([(i, n, f"https://h/{n}", "abc") for i, n in enumerate(names)], "seq long, name string, html_url string, head string")
    files, undecodable = scan_sources(spark, root)
    idx = I.create_index(spark, scratch_path(spark, "ingest"))
    report = {r.repo: (r.seq, r.n_files, r.admitted, r.accepted, r.skipped) for r in ingest_repositories(idx, listed, files, undecodable, max_bytes=60, already=0).collect()}
    assert report == {"a": (0, 3, True, 1, 2), "b": (2, 1, True, 1, 0), "c": (4, 1, False, 0, 0)}
    docs = sorted((r.title, r.url) for r in I.iter_documents(idx).collect())
    assert docs == [("a one.py", "https://h/a/blob/abc/one.py"), ("b x.py", "https://h/b/blob/abc/x.py")]
    # the folder of the index counts as bytes before the first repository
    report = ingest_repositories(idx, listed, files, max_bytes=10).collect()
    assert not any(r.admitted for r in report) and I.index_len(idx) == 2
