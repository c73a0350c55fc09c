"""Packing along the Hilbert curve: every id once, gapless sequences, ids of the library, neighbours near."""
from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from shapeindex.llm import curve_packing, tokenizer

DOC = "doc_id long, text string, start long, bucket string"


@pytest.mark.parametrize("d,bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_steps_of_one(d, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
    place = curve_packing.hilbert(grid, bits)
    order = np.argsort(place)
    assert place[order].tolist() == list(range(len(grid)))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def texts(seed):
    rng = random.Random(seed)
    topics = [["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(40)] for _ in range(4)]
    rows = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(rng.choice([1, 5, 60, 300]))), 1, "x") for i in range(120)]
    return rows + [(200, None, 1, "x"), (201, "", 1, "x"), (202, " \n", 1, "x"), (None, "no id", 1, "x"), (None, "no id either", 1, "x"), (7, "same id", 1, "x"), rows[3], rows[3],
                   (203, "long " * 9000, 1, "x")] + [(300 + i, rows[2][1], 1, "x") for i in range(60)]


def check(rows, pieces, sequence):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(((-1 if i is None else i), tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, *_ in rows)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == sequence or at & (at - 1) == 0 and at < sequence
    left = defaultdict(list)
    for i, ids in want:
        left[i].append(ids)
    for i, ps in by_doc.items():  # pieces of documents of one id: each position of each length as often as there are such documents
        docs = left[-1 if i is None else i]
        for n in {p.doc_tokens for p in ps}:
            same = [d for d in docs if len(d) == n]
            assert sum(p.length for p in ps if p.doc_tokens == n) == n * len(same)
            crcs = {zlib.crc32(np.array(d[p.start : p.start + p.length], dtype="<u4").tobytes()) for p in ps if p.doc_tokens == n for d in same}
            assert all(p.ids_crc32 in crcs for p in ps if p.doc_tokens == n)
            if len(same) == 1:
                assert sorted((p.start, p.start + p.length) for p in ps if p.doc_tokens == n)[0][0] == 0
                for p in ps:
                    if p.doc_tokens == n:
                        assert p.ids_crc32 == zlib.crc32(np.array(same[0][p.start : p.start + p.length], dtype="<u4").tobytes())
        assert {p.doc_tokens for p in ps} == {len(d) for d in docs}
    assert set(by_doc) == {i for i, *_ in rows}


@pytest.mark.parametrize("sequence,bucket_bytes", [(2048, 8 << 20), (64, 9_000), (2048, 20_000)])
def test_packing(spark, sequence, bucket_bytes):
    rows = texts(sequence)
    pieces = curve_packing.pack(spark.createDataFrame(rows, DOC).repartition(4), tokenizer.vocabulary_path(), sequence, bucket_bytes).collect()
    check(rows, pieces, sequence)
    if bucket_bytes < 1 << 20:  # many buckets, each with a whole number of sequences
        assert len({p.sequence_id >> 40 for p in pieces}) > 3


def test_no_documents(spark):
    assert curve_packing.pack(spark.createDataFrame([], DOC), tokenizer.vocabulary_path()).count() == 0


def test_neighbours_share_topics(spark):
    """Documents beside one another in a sequence are of one topic more often than in the table's order."""
    rng = random.Random(1)
    topics = [["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(40)] for _ in range(4)]
    rows = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(80)), 1, "x") for i in range(200)]
    pieces = curve_packing.pack(spark.createDataFrame(rows, DOC), tokenizer.vocabulary_path()).collect()
    order = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    near = [a % 4 == b % 4 for a, b in zip(order, order[1:], strict=False) if a != b]
    assert sum(near) / len(near) > 0.6


def test_limits_cut_tokens_evenly():
    assert curve_packing.bucket_limits([], 4) == []
    assert curve_packing.bucket_limits([(k, 1) for k in range(100)], 4) == [24, 49, 74]
    assert curve_packing.bucket_limits([(5, 10)] * 20, 4) == [5]
