import numpy as np
import pyarrow as pa
import pytest

from plantflow.llm.language_model import SAFE, Vocabulary, WindowNet
from plantflow.llm.textarrays import ALNUM_SPLIT, words

TEXTS = pa.array(["a b c d e f a b", None, "", "b c x y a a a"])


@pytest.mark.parametrize("scale", [0.1, 200.0])
def test_rows_are_shifted_only_where_exp_could_overflow(scale):
    """The same probabilities as by shifting every row, for small parameters (not shifted) and for large ones."""
    net = WindowNet(Vocabulary(words(pa.array(["a b c d e f"]), ALNUM_SPLIT)[0], shared=10, class_size=4))
    rng = np.random.default_rng(1)
    net.params = {k: rng.normal(0, scale, v.shape).astype(np.float32) for k, v in net.params.items()}
    classes, of_words = net._bounds()
    assert (max(classes, *of_words) < SAFE) == (scale < 1)
    line, place, _ = net.padded(TEXTS)
    p, h, c = {k: v.astype(float) for k, v in net.params.items()}, net.hidden(line, place).astype(float), net.vocabulary.class_size
    group, word = line[place] // c, line[place] % c
    log_softmax = lambda z: z - z.max(axis=1, keepdims=True) - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True))
    n = np.arange(place.size)
    expected = log_softmax(h @ p["class"] + p["class_bias"])[n, group] + log_softmax(np.einsum("nd,ndw->nw", h, p["word"][group]) + p["word_bias"][group])[n, word]
    assert np.allclose(net.log_probabilities(line, place), expected, rtol=1e-4, atol=1e-3)
    net.train(line, place, 0.1)
    assert all(np.isfinite(v).all() for v in net.params.values())


def test_a_texts_words_are_found_once():
    net = WindowNet(Vocabulary(words(pa.array(["a b c"]), ALNUM_SPLIT)[0]))
    for one, other in zip(net.padded(TEXTS), net.padded_words(*words(TEXTS, ALNUM_SPLIT), len(TEXTS)), strict=True):
        assert (one == other).all()
