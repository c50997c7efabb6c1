import random

from corpus_pipeline import near_dedup
from plantflow.llm.minhash import bins_for


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_the_stage_links_from_80_per_cent(spark):
    rng = random.Random(4)
    docs = []
    for base in range(60):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        own = list(words)
        for k in range(rng.choice([3, 4, 5])):  # 0.88, 0.82 and 0.77
            own[20 + 30 * k] = f"edit{base}x{k}"
        docs += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(own))]
    linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    expected = {i for i, t in docs if i % 2 == 0 or not linked(shingles(t), shingles(docs[i - 1][1]))}
    between = {i for i, t in docs if i % 2 and 80 <= 100 * len(shingles(t) & shingles(docs[i - 1][1])) / len(shingles(t) | shingles(docs[i - 1][1])) < 85}
    assert len(between) > 5 and len(expected) > 65
    got = near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == expected


def test_bands_miss_as_little_at_80_as_at_85():
    miss = lambda s, bins: (1 - s**4) ** (bins // 4)
    assert max(miss(0.80, bins_for(80)), miss(0.85, bins_for(85))) <= 1e-9
    assert bins_for(100) == 4
