import bisect
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from plantflow.llm import packing
from plantflow.llm.packing import deal, opened, pack, pack_documents, token_pieces, tokenizer_path


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


@pytest.mark.parametrize("kind", ["mixed", "tiny", "large", "equal", "one"])
def test_fit(spark, kind):
    rng = random.Random(kind)
    draw = {"mixed": lambda: min(1000, int(rng.lognormvariate(4, 1.5)) + 1), "tiny": lambda: rng.randint(1, 5), "large": lambda: rng.randint(400, 1000), "equal": lambda: 334, "one": lambda: 1000}[kind]
    lengths = [draw() for _ in range(600 if kind != "one" else 1)]
    rows = pack(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long"), capacity=1000).collect()
    assert sorted((r.id, r.length) for r in rows) == list(enumerate(lengths))
    used, bound = check(rows, 1000), -(-sum(lengths) // 1000)
    assert used <= {"mixed": 1.03, "tiny": 1.05, "large": 2.0, "equal": 1.51, "one": 1.0}[kind] * bound


def test_documents(spark):
    own = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", "Hello world's 12 cats!", "ab " * 7000, "word " * 4095, "word " * 4096, "Hello"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(6, "Hello", 2), (None, "x", 3)], "doc_id long, text string, offset int")
    rows = pack_documents(docs).collect()
    check(rows, 4096)
    for i, t in enumerate(texts[:-1]):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert mine == [(k, s, min(4096, ids.size - s), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, ids.size, 4096))]
    assert sum(r.doc_id == 6 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert token_pieces(docs.limit(0)).count() == 0 and pack_documents(docs.limit(0)).count() == 0


def test_the_given_documents_go_through_sweeps(spark, monkeypatch):
    """At the scale of the correctness run: many sweeps over many partitions place every piece."""
    partitions, own = [], packing._sweep
    monkeypatch.setattr(packing, "_sweep", lambda dealt, plan, *rest: partitions.append(plan.partitions) or own(dealt, plan, *rest))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack_documents(docs).collect()
    assert len(partitions) >= 3 and min(partitions) >= 2
    assert len(rows) == token_pieces(docs).count()
    assert sum(r.length for r in rows) / 4096 / check(rows, 4096) > 0.98


def one_by_one(lengths, capacity, gaps=()):
    """Sequences that best fit opens, placing the largest document first, one at a time."""
    gaps, fresh = sorted(gaps), 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        fresh += at == len(gaps)
        if rest := (gaps.pop(at) if at < len(gaps) else capacity) - length:
            bisect.insort(gaps, rest)
    return fresh


def test_opened_is_best_fit_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(300):
        documents, gaps = (rng.integers(0, 9, 61) * (rng.random(61) < share) for share in (0.5, rng.choice([0, 0.3])))
        documents[0] = gaps[0] = 0
        assert opened(documents, gaps) == one_by_one(np.repeat(np.arange(61), documents), 60, np.repeat(np.arange(61), gaps))


@pytest.mark.parametrize("few", [1, 40])
def test_as_full_as_best_fit_one_by_one(spark, few):
    """The documents once, and 40 times over."""
    pieces = token_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).selectExpr("length", f"explode(sequence(1, {few})) AS copy")
    rows = pack(pieces).collect()
    best = one_by_one([r.length for r in rows], 4096)
    assert best <= check(rows, 4096) <= 1.006 * best + 1


def test_deal_gives_every_row_a_partition():
    rng = np.random.default_rng(2)
    for _ in range(200):
        documents, gaps = (rng.integers(0, 6, 41) * (rng.random(41) < share) for share in (0.5, rng.choice([0, 0.3])))
        documents[0] = gaps[0] = 0
        documents[rng.integers(1, 41)] += 1
        plan = deal(documents, gaps, 5)
        size = np.repeat(np.arange(41), documents)
        part = plan.documents(size, rng.random(size.size))
        assert part.min() >= 0 and part.max() < plan.partitions
        assert all(part[size == a].max() <= part[size == b].min() for a, b in [(40, s) for s in range(40) if documents[40] and documents[s]])
        size = np.repeat(np.arange(41), gaps)
        part = plan.gaps(size, rng.random(size.size))
        assert ((part >= 0) == (size >= np.flatnonzero(documents)[0])).all() and part.max(initial=0) < plan.partitions
        assert plan.fresh.sum() * 40 >= (documents * np.arange(41)).sum() - (gaps * np.arange(41)).sum() or not plan.fresh.sum()


def test_null_and_repeated_rows(spark):
    rows = [(None, None)] * 30 + [(1, "same text")] * 300 + [(2, "")] * 5
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=64).collect()
    assert len(got) == len(rows) and check(got, 64) <= 20
