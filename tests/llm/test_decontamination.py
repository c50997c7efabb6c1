import random
import re

import pytest

from plantflow.llm import decontamination
from plantflow.llm.decontamination import contamination_report, decontaminate, find_matches

DOCS = "doc_id long, text string, n_words string, lang string"
ITEMS = "item_id long, text string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = {}
    for doc_id, text in docs:
        words = split(text)
        hit, ids = set(), set()
        for item_id, item in items:
            w = split(item)
            n = min(len(w), window)
            for g in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else ():
                for i in range(len(words) - n + 1):
                    if tuple(words[i : i + n]) == g:
                        hit |= set(range(i, i + n))
                        ids.add(str(item_id))
        out[doc_id] = (len(words), len(hit), len(ids))
    return out


@pytest.mark.parametrize(("seed", "window"), [(1, 10), (2, 3), (3, 1), (4, 5)])
def test_brute_force(spark, seed, window):
    rng = random.Random(seed)
    text = lambda n, k: "".join(rng.choice(["A", "b", "c", "É"][:k]) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60), 3)) for i in range(40)] + [(100, None), (101, ""), (102, " .,! "), (103, text(3000, 2))]
    items = [(i, text(rng.randint(0, 25), 3)) for i in range(12)] + [(50, None), (51, "a"), (52, "a B"), (53, "zzz yyy"), (54, "b c a")]
    got = contamination_report(spark.createDataFrame([(i, t, "x", None) for i, t in docs], DOCS), spark.createDataFrame(items, ITEMS), window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got} == brute(docs, items, window)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_blocks_agree(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine ten eleven {i} words", "", "") for i in range(20)], DOCS)
    items = spark.createDataFrame([(k, f"three four five six seven eight nine ten eleven {k}") for k in range(20)], ITEMS)
    one, many = (contamination_report(docs, items, block_bytes=b).drop("matches").orderBy("doc_id").collect() for b in (1 << 20, 300))
    assert one == many and sum(r.n_items for r in one) == 20


def test_equal_items_are_one(spark):
    """Any number of equal benchmark rows fits one block."""
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", "", "")], DOCS)
    items = spark.range(5000).selectExpr("7L AS item_id", "'two three four five six seven eight nine ten eleven' AS text")
    parts = list(decontamination._blocks(items, "item_id", "text", 300))
    assert [len(p[0]) for p in parts] == [1]
    row = contamination_report(docs, items, block_bytes=300).first()
    assert (row.n_hit, row.n_items) == (10, 1) and len(row.matches) == 1


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(30)) + " y", "", "")], DOCS)
    items = spark.createDataFrame([(7, "a b " + " ".join(f"w{i}" for i in range(5, 25)) + " c")], ITEMS)
    found, name = find_matches(docs, items)
    assert [tuple(m) for m in found.select(f"{name}.matches").first()[0]] == [("7", 2, 6, 20)]


def test_removal_keeps_columns(spark):
    long = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, long, "x", "en"), (2, "clean text", "y", None), (3, None, "z", "en"), (2, "clean text", "y", None)], DOCS)
    kept = decontaminate(docs, spark.createDataFrame([(1, long)], ITEMS))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 3]
    assert decontaminate(docs, spark.createDataFrame([], ITEMS)).count() == 4
    assert decontaminate(docs.limit(0), spark.createDataFrame([(1, long)], ITEMS)).count() == 0


def test_one_word_over_and_over(spark):
    """A long text of one word against an item of it: the work follows the matches, not windows times places."""
    docs = spark.createDataFrame([(1, "a " * 200_000, "", ""), (2, "b " + "a " * 9 + "c", "", ""), (3, "c " + "a " * 12, "", "")], DOCS)
    items = spark.createDataFrame([(7, "a " * 400), (8, "x y " * 10)], ITEMS)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in contamination_report(docs, items).collect()}
    assert got == {1: (200_000, 200_000, 1), 2: (11, 0, 0), 3: (13, 12, 1)}


def test_matches_of_repetitive_texts():
    import numpy as np
    import pyarrow as pa

    from plantflow.llm.decontamination import Items, _matches

    rng = np.random.default_rng(5)
    for _ in range(60):
        docs, items = ([" ".join(rng.choice(["a", "b"], rng.integers(0, 25), p=[0.8, 0.2])) for _ in range(4)] for _ in range(2))
        window = int(rng.integers(1, 6))
        found = _matches(Items([0, 1, 2, 3], items, window), pa.array(docs))[1].to_pylist()
        for doc, matches in zip(docs, found, strict=True):
            w, expected = doc.split(), set()
            for k, item in enumerate(items):
                v = item.split()
                least = min(window, len(v))
                for i in range(len(v)):
                    for j in range(len(w)):
                        if i and j and v[i - 1] == w[j - 1]:
                            continue
                        n = 0
                        while i + n < len(v) and j + n < len(w) and v[i + n] == w[j + n]:
                            n += 1
                        if n >= least:
                            expected.add((str(k), i, j, n))
            assert sorted((m["item"], m["item_start"], m["start"], m["length"]) for m in matches) == sorted(expected)
