import re
import zlib
from collections import Counter

import pytest
from plantflow.llm import spelling
from plantflow.llm.spelling import near_words, spelling_variants

DATA = "/root/testdata/sf0.001"
FOLD = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(rows, per=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % per == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def is_near(u, v):
    u, v = sorted((u, v), key=len)
    if u == v or len(v) - len(u) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(u, v, strict=False)) if x != y), len(u))
    return u[k + 1 :] == v[k + 1 :] if len(u) == len(v) else u[k:] == v[k + 1 :]


def plain(words, ratio=10):
    """Near words of seven letters and more share their first or their last three."""
    ends = {}
    for w in words:
        ends.setdefault((0, w[:3]), []).append(w)
        ends.setdefault((1, w[-3:]), []).append(w)
    near = {w: sorted({v for v in ends[0, w[:3]] + ends[1, w[-3:]] if is_near(w, v)}, key=lambda v: (-words[v], v)) for w in words}
    form = {w: v[0] if v and words[v[0]] >= ratio * words[w] else None for w, v in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    words = plain_words(docs.collect())
    got = {tuple(r) for r in spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert len(words) > 500 and got == plain(words)


@pytest.mark.parametrize("bucket", [512, 3])
def test_near_words_of_a_dense_set(spark, monkeypatch, bucket):
    """All edits of a few words, with gaps halved down to two code points."""
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    base = ["abcdefghijkl", "aaaaaaaaaaa", "éabcdefghijklmnopqrstuvwxyz"]
    words = {w: 100 for w in base}
    for w in base:
        for k in range(len(w)):
            words |= {w[:k] + w[k + 1 :]: 7, w[:k] + "ÿ" + w[k:]: 7, w[:k] + "zz"[:1] + w[k + 1 :]: 9, w[:k] + "é" + w[k + 1 :]: 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in near_words(df).collect()}
    want = {w: [v for v in words if is_near(w, v)] for w in words}
    want = {w: (len(v), min(v, key=lambda x: (-words[x], x)), max(words[x] for x in v)) for w, v in want.items() if v}
    assert got == want


def test_chains_odd_rows_and_ties(spark):
    long = "q" * 200_000 + "r"
    texts = [(1, " ".join(["abcdefgh"] * 1000 + ["abcdefg"] * 30 + ["abcdefx"] * 2 + ["Àbcdefg"] * 2)), (None, "zzzzzzzz zzzzzzzz"), (2, None), (3, ""), (4, f"{long} {long} {long[1:]} {long[1:]}"), (5, "ABCDEFGH short"), (5, "ABCDEFGH short")]
    docs = spark.createDataFrame([(i, t, "w") for i, t in texts], "doc_id long, text string, word string")
    got = {tuple(r) for r in spelling_variants(docs, per=1 << 40).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain(plain_words(texts, 1 << 40))
    assert got == want
    assert {(w, f, r) for w, f, r, *_ in got} >= {("abcdefx", "abcdefg", "abcdefgh"), ("Àbcdefg", "abcdefg", "abcdefgh")}
    assert any(w == long and k == 1 for w, _, _, _, k, _ in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(docs).collect() == []
