import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plantflow.llm.components import components
from plantflow.llm.minhash import drop_near_duplicates, fast_sketch, near_duplicates, seeded, shingle_sets

SCHEMA = "doc_id long, text string, kept string"


def shingles(text):
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= 85 * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  b"), (1005, "b a"), (1006, "x" * 5000)]
    for base in range(6):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([8, 40, 120, 300]))]
        for copy in range(rng.choice([1, 5, 60])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(["edit", f"w{rng.randint(0, 9999)}"])
            docs.append((base * 100 + copy, " ".join(own)))
    rng.shuffle(docs)
    got = near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA), small=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_defined_cases(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(5, text, "a"), (5, text, "a"), (None, text, "b"), (9, text.upper(), "c"), (3, None, "d")], SCHEMA)
    assert sorted(((r.doc_id, r.kept) for r in drop_near_duplicates(docs).collect()), key=str) == sorted([(5, "a"), (5, "a"), (None, "b"), (3, "d")], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_large_buckets_are_split(spark, monkeypatch):
    from plantflow.llm import minhash

    monkeypatch.setattr(minhash, "SPLIT", 7)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for k in range(150):
        own = list(base)
        own[rng.randrange(120)] = f"edit{k}"
        docs.append((k, " ".join(own)))
    docs += [(1000 + k, " ".join([*base[:60], *(f"own{k}x{i}" for i in range(60))])) for k in range(80)]
    got = near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA), small=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)


def test_long_and_repeated_texts(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(400_000))
    docs = spark.createDataFrame([(1, long, ""), (2, long + " more", ""), (3, "same words " * 100_000, ""), (4, "same words " * 90_000, ""), (4, "same words " * 90_000, "")], SCHEMA)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()} == {1: (70_000, 1), 2: (70_001, 1), 3: (2, 3), 4: (2, 3)}


def test_every_bin_fills_and_agreement_is_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 500):
        assert (fast_sketch(seeded(n, 1), np.zeros(n, np.int64), 1, 64) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    agree = []
    for _ in range(40):
        common, a, b = rng.integers(0, 2**63, 200, np.uint64), rng.integers(0, 2**63, 50, np.uint64), rng.integers(0, 2**63, 50, np.uint64)
        x, y = (fast_sketch(np.concatenate([common, own]), np.zeros(250, np.int64), 1, 64)[0] for own in (a, b))
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - 200 / 300) < 0.03
    values, row = shingle_sets(pa.array(["a b c d e f", None, "a"]))
    assert row.tolist() == [0, 0, 2]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 200), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 300: 200}
