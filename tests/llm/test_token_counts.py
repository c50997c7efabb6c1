"""Counts equal greedy longest-match segmentation by brute force."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plantflow.llm.token_counts import LongestMatch, _counted, read_vocabulary, token_counts, vocabulary_path


def greedy(word: bytes, vocabulary: set[bytes], longest: int) -> int:
    at = n = 0
    while at < len(word):
        size = next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
        at, n = at + size, n + 1
    return n


def test_real_vocabulary():
    pieces = set(read_vocabulary(vocabulary_path()))
    longest = max(map(len, pieces))
    texts = ["The quick brown fox's 12345 jumps!!", None, "", " \t\n", "Ünïcödé straße 漢字 " + "ab" * 300, "a", "THE the The", "x\x00y"]
    words, tokens = _counted(pa.array(texts), vocabulary_path())
    expected = [sum(greedy(b" " + w.encode(), pieces, longest) for w in _split(t or "")) for t in texts]
    assert tokens.to_pylist() == expected
    assert words.to_pylist() == [len(_split(t or "")) for t in texts]


def _split(text: str) -> list[str]:
    for blank in "\t\n\x0b\x0c\r":
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def test_very_long_words():
    pieces = set(read_vocabulary(vocabulary_path()))
    longest = max(map(len, pieces))
    texts = ["internationalization" * 90 + "x", "0" * 700 + "abc", "ünï" * 400, "a" * 511, "a" * 512, "a" * 513]
    _, tokens = _counted(pa.array(texts), vocabulary_path())
    assert tokens.to_pylist() == [greedy(b" " + t.encode(), pieces, longest) for t in texts]
    _, tokens = _counted(pa.array(["ab" * 2_500_000]), vocabulary_path())
    assert tokens[0].as_py() > 1_000_000


def test_repeated_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, "a b", 6), (2, None, 7)], "doc_id long, text string, n_tokens int")
    rows = [tuple(r) for r in token_counts(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, 2, rows[0][2]), (1, 2, rows[0][2]), (None, 2, rows[0][2]), (2, 0, 0)], key=str)
    assert token_counts(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.sets(st.binary(min_size=2, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12), st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=8))
def test_small_vocabularies(pieces, words):
    vocabulary = pieces | {b" ", b"a", b"b", b"c", b" a"}
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = LongestMatch(sorted(vocabulary)).counts(data, ends - [len(w) for w in words], ends)
    assert got.tolist() == [greedy(b" " + w.encode(), vocabulary, 6) for w in words]
