import math
import time

import numpy as np
import pyarrow as pa

from plantflow.llm.language_model import MOST, Vocabulary, WindowNet
from plantflow.llm.textarrays import ALNUM_SPLIT, BLANK_SPLIT, seeded, spans

STEP = 4096


def plain_entries(own, shared, hashes):
    by = np.argsort(own)
    at = np.minimum(np.searchsorted(own[by], hashes), own.size - 1)
    hit = own[by][at] == hashes
    return np.where(hit, by[at], own.size + (hashes % np.uint64(shared)).astype(np.int64))


def softmax(z):
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def plain_steps(p, window, c, line, at, rate):
    """The steps of training as they are defined, a class at a time."""
    for a in range(0, at.size, STEP):
        part = at[a : a + STEP]
        part = part[np.argsort(line[part] // c, kind="stable")]
        group, word, n = line[part] // c, line[part] % c, part.size
        h = np.tanh(sum((p["left"][line[part - k]] + p["right"][line[part + k]]) / k for k in range(1, window + 1)))
        dz = softmax(h @ p["class"] + p["class_bias"])
        dz[np.arange(n), group] -= 1
        dh = dz @ p["class"].T
        for g in np.unique(group):
            i, j = np.searchsorted(group, [g, g + 1])
            dy = softmax(h[i:j] @ p["word"][g] + p["word_bias"][g])
            dy[np.arange(j - i), word[i:j]] -= 1
            dh[i:j] += dy @ p["word"][g].T
            p["word"][g] -= np.clip(h[i:j].T @ dy * (rate / math.sqrt(j - i)), -MOST, MOST)
            p["word_bias"][g] -= np.clip(dy.sum(axis=0) * (rate / math.sqrt(j - i)), -MOST, MOST)
        p["class"] -= np.clip(h.T @ dz * (rate / math.sqrt(n)), -MOST, MOST)
        p["class_bias"] -= np.clip(dz.sum(axis=0) * (rate / math.sqrt(n)), -MOST, MOST)
        dx = np.clip(dh * (1 - h * h), -1, 1) * rate
        for k in range(1, window + 1):
            for name, side in (("left", -k), ("right", k)):
                entry = line[part + side]
                by = np.argsort(entry, kind="stable")
                heads = np.flatnonzero(np.diff(entry[by], prepend=-1))
                p[name][entry[by][heads]] -= np.clip(np.add.reduceat(dx[by], heads, axis=0) / k, -1, 1)


def quickest(*ways):
    """Least seconds of this thread of each way, by turns."""
    took = [[] for _ in ways]
    for _ in range(7):
        for way, all_ in zip(ways, took, strict=True):
            t = time.thread_time()
            way()
            all_.append(time.thread_time() - t)
    return [min(all_) for all_ in took]


def sample(own, n, seed=5):
    """Hashes of n words, those of own by falling frequency and a third that is none of them."""
    rng = np.random.default_rng(seed)
    chance = 1 / np.arange(1, own.size + 1)
    hashes = rng.choice(own, n, p=chance / chance.sum())
    return np.where(rng.random(n) < 1 / 3, seeded(n, seed + 1), hashes)


def test_entries_of_crowded_slots():
    for size in (1, 2, 3, 50, 6000):
        own = seeded(size, 1)
        own[size // 2 :] = (own[size // 2 :] & np.uint64((1 << 40) - 1)) | (own[0] >> np.uint64(40) << np.uint64(40))  # all in one slot
        hashes = np.concatenate([sample(own, 3000), own, own ^ np.uint64(1)])
        assert (Vocabulary(own, 97, 8).entries(hashes) == plain_entries(own, 97, hashes)).all()


def test_few_words_are_searched_for():
    own = seeded(6000, 1)
    vocabulary, hashes = Vocabulary(own, 400, 128), sample(own, 200_000)
    assert (vocabulary.entries(hashes) == plain_entries(own, 400, hashes)).all()
    ours, plain = quickest(lambda: vocabulary.entries(hashes), lambda: plain_entries(own, 400, hashes))
    assert ours < 0.6 * plain


def trained(own, size, c, kind, n=20_000):
    net = WindowNet(Vocabulary(own, 400, c), size=size)
    rng = np.random.default_rng(3)
    net.params = {k: (v + rng.normal(0, 0.2, v.shape)).astype(kind) for k, v in net.params.items()}
    line, place, _ = net.padded_words(sample(own, n), np.sort(rng.integers(0, 100, n)), 100)
    return net, line, rng.permutation(place)


def test_steps_are_those_of_the_definition():
    for size, c in ((16, 128), (5, 8), (1, 64)):
        net, line, at = trained(seeded(1500, 1), size, c, np.float64)
        plain = {k: v.copy() for k, v in net.params.items()}
        before = {k: v.copy() for k, v in net.params.items()}
        net.train(line, at, 0.12)
        plain_steps(plain, net.window, c, line, at, 0.12)
        for k, v in net.params.items():
            assert np.abs(v - before[k]).max() > 1e-3 and np.allclose(v, plain[k], rtol=1e-9, atol=1e-9)


def test_steps_cost_less_than_a_class_at_a_time():
    net, line, at = trained(seeded(6000, 1), 16, 128, np.float32)
    plain = {k: v.copy() for k, v in net.params.items()}
    ours, other = quickest(lambda: net.train(line, at, 0.01), lambda: plain_steps(plain, net.window, 128, line, at, 0.01))
    assert ours < 0.66 * other


def test_rows_of_words():
    texts = pa.array(["", None, "ab, c", "", "Ünd\n9 ", " ", "z"])
    data, offsets = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode(), np.uint8), np.cumsum([0, *(len((t or "").encode()) for t in texts.to_pylist())])
    for table in (ALNUM_SPLIT, BLANK_SPLIT):
        starts, ends, row = spans(data, offsets, table)
        assert row.tolist() == [2, 2, 4, 4, 6]
        assert all(table[data[a:b]].all() for a, b in zip(starts, ends, strict=True))
