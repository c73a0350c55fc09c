"""The whole pipeline on small tables: the rows that each stage leaves, against brute force on the rows of the one before."""
from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from shapeindex.llm import tokenizer, toxicity
from shapeindex.session import scratch_path

from test_llm import brute_classes, contaminated, corpus, ordered, removed

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def tables(seed):
    rng = random.Random(seed)
    rows = [r[:5] for r in corpus(seed, 80)]
    insults = ["vexworm", "gruntslag", "mirefang"]
    words = ["".join(rng.choice("klmnopqr") for _ in range(rng.randint(3, 7))) for _ in range(200)]
    labels = []
    for k in range(160):
        w = [rng.choice(words) for _ in range(30)]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(30)] = rng.choice(insults)
        rows.append((500 + k, " ".join(w), "en", "s9", 1))
        labels.append((500 + k, 1, int(toxic)))
    items = [(1, " ".join(rows[20][1].split()[:14] or ["x"])), (2, " ".join(rows[130][1].split()[2:17])), (None, " ".join(rows[131][1].split()[2:17])), (3, None)]
    return rows, labels, items


@pytest.fixture(scope="module")
def folder(spark):
    rows, labels, items = tables(11)
    path = scratch_path(spark, "small-tables")
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else "") if not isinstance(x, list) else (False, x) for x in r))


def test_stages_and_run(spark, folder):
    import corpus_pipeline

    path, rows, items = folder
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")

    # toxicity: the learned model applied text by text
    model = toxicity.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet"))
    scorer, w = toxicity.Scorer(model["terms"]), model["weights"]
    clean = [r for r in rows if sum(a * b for a, b in zip(scorer.features(r[1] or ""), w, strict=False)) + w[-1] < 0]
    got = stages["toxicity"](spark, docs, path)
    assert key(map(tuple, got.collect())) == key(clean) and 20 < len(rows) - len(clean) < 60
    assert {r[0] for r in rows if r not in clean} <= set(range(500, 660))

    # near duplicates: of each class the row of the smallest id
    classes = brute_classes([(r[0], r[1]) for r in clean])
    kept = key({r for r, (i, c) in zip(clean, classes, strict=True) if ordered(i) == c})
    got = stages["minhash_near_dedup"](spark, spark.createDataFrame(clean, DOC), path)
    assert key(map(tuple, got.collect())) == kept and len(kept) < len(clean)

    # repeats: words of windows that an earlier document has
    words = [[x for x in re.split(r"[\x20\x09-\x0d]+", r[1] or "") if x] for r in kept]
    gone = removed(words, [r[0] for r in kept], 13)
    cut = []
    for r, ws, g in zip(kept, words, gone, strict=True):
        text = " ".join(x for x, d in zip(ws, g, strict=True) if not d)
        cut.append((r[0], text, r[2], r[3], len(text)) if any(g) else r)
    got = stages["substring_dedup"](spark, spark.createDataFrame(kept, DOC), path)
    assert key(map(tuple, got.collect())) == key(cut) and any(map(any, gone))

    # contamination
    left = [r for r, c in zip(cut, contaminated([(r[0], r[1]) for r in cut], items), strict=True) if not c[-1]]
    got = stages["benchmark_decontamination"](spark, spark.createDataFrame(cut, DOC), path)
    assert key(map(tuple, got.collect())) == key(left) and len(left) < len(cut)

    # tokens, and all of it by run()
    bpe = tokenizer.WordBpe(tokenizer.load_spec(tokenizer.vocabulary_path()))
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer.vocabulary_path())
    ids = [library.encode(r[1] or "", add_special_tokens=False).ids for r in left]
    want = key((r[0], r[2], r[3], len(i), i, library.decode(i, skip_special_tokens=False)) for r, i in zip(left, ids, strict=True))
    out = corpus_pipeline.run(spark, path).select("doc_id", "lang", "source", "n_tokens", "ids", "decoded").collect()
    assert key(tuple(r) for r in out) == want and bpe is not None


def test_empty_tables(spark, folder):
    import corpus_pipeline

    path = scratch_path(spark, "no-rows")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    nothing = docs.where("doc_id = 500").select("doc_id", F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert [r.text for r in stage(spark, nothing, folder[0]).collect()] == [None], name
