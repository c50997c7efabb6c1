import numpy as np
import pyarrow as pa

from plantflow.llm.language_model import Vocabulary, WindowNet, fit_language_model, masked_places, score_documents
from plantflow.llm.textarrays import ALNUM_SPLIT, words


def test_probabilities_sum_to_one():
    net = WindowNet(Vocabulary(words(pa.array(["a b c"]), ALNUM_SPLIT)[0], shared=61, class_size=8))
    rng = np.random.default_rng(1)
    for v in net.params.values():
        v += rng.normal(0, 0.3, v.shape).astype(np.float32)
    line = np.full(7, net.vocabulary.n)
    line[2:5] = [0, 1, 2]
    total = 0.0
    for word in range(net.vocabulary.n):
        own = line.copy()
        own[3] = word
        total += np.exp(net.log_probabilities(own, np.array([3]))[0])
    assert abs(total - 1) < 1e-4


def test_gradients():
    """A step of training moves every parameter by the numeric gradient of the log-probabilities."""
    net = WindowNet(Vocabulary(words(pa.array(["a b c d e f"]), ALNUM_SPLIT)[0], shared=10, class_size=4), size=5)
    rng = np.random.default_rng(4)
    for v in net.params.values():
        v += rng.normal(0, 0.2, v.shape).astype(np.float32)
    line, place, _ = net.padded(pa.array(["a b c d e f a c e b q r"]))
    before = {k: v.copy() for k, v in net.params.items()}
    rate = 1e-3
    net.train(line, place, rate)
    after, net.params = net.params, {k: v.astype(np.float64) for k, v in before.items()}
    group = line[place] // net.vocabulary.class_size
    for name, at in [("class", (1, 2)), ("class_bias", (1,)), ("word", (int(group[0]), 2, 1)), ("word_bias", (int(group[0]), 1)), ("left", (int(line[place[3]]), 2)), ("right", (int(line[place[3]]), 1))]:
        keep, step, value = net.params[name][at], 1e-5, []
        for sign in (1, -1):
            net.params[name][at] = keep + sign * step
            value.append(net.log_probabilities(line, place).sum())
        net.params[name][at] = keep
        slope = (value[0] - value[1]) / (2 * step)
        many = {"class": place.size, "class_bias": place.size, "word": (group == group[0]).sum(), "word_bias": (group == group[0]).sum()}.get(name, 1)
        assert abs((after[name][at] - before[name][at]) * np.sqrt(many) / rate - slope) < 2e-2 * max(1, abs(slope))


def test_training_helps_on_texts_held_out(spark):
    rng = np.random.default_rng(7)
    pairs = [(f"first{k}", f"second{k}") for k in range(30)]
    text = lambda n: " ".join(" ".join(pairs[k]) for k in rng.integers(0, 30, n))
    df = spark.createDataFrame([(i, text(200)) for i in range(600)], "doc_id long, text string")
    net = fit_language_model(df, own=60, rounds=2, rate=0.5)
    held = pa.array([text(60) for _ in range(20)])
    line, place, _ = net.padded(held)
    # a word of a pair is certain, one of the unigrams has a chance of 1 in 60
    assert net.log_probabilities(line, place).mean() > -np.log(60) + 0.5


def test_what_is_masked_does_not_depend_on_the_slice():
    net = WindowNet(Vocabulary(words(pa.array(["a b c"]), ALNUM_SPLIT)[0]))
    texts = ["a b c a b", "c", "", "b c a"]
    _, place, row = net.padded(pa.array(texts))
    whole = [row[place == p][0] for p in masked_places(place, row, 1, 2)]
    each = [i for i, t in enumerate(texts) for _ in masked_places(*net.padded(pa.array([t]))[1:], 1, 2)]
    assert whole == each == [0, 0, 3]


def test_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", 1.0, 2), (1, "a b c", 1.0, 2), (2, "a b", 0.0, 3)], "doc_id long, text string, log_likelihood double, n_tokens int")
    rows = sorted((tuple(r) for r in score_documents(df, own=8).collect()))
    assert len(rows) == 3 and rows[0] == rows[1] and rows[2][1] == 2


def test_scores(spark):
    common = ["the cat sat on the mat and the dog ran " * 5] * 60
    rows = list(enumerate(common)) + [(100, None), (101, ""), (102, "!!"), (103, "zq xv kj pw " * 10), (104, "the cat " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in score_documents(df, own=100, stride=2, rounds=3).collect()}
    assert len(got) == 65
    for i in (100, 101, 102):
        assert (got[i].n_tokens, got[i].log_likelihood, got[i].mean_log_likelihood) == (0, 0.0, None)
    assert got[0].n_tokens == 50 and got[104].n_tokens == 80_000
    assert got[0].mean_log_likelihood > got[103].mean_log_likelihood + 1
    assert score_documents(df.limit(0)).count() == 0
    assert fit_language_model(df, own=100, rounds=1).vocabulary.own <= 100
