"""Document scores by masked pseudo-likelihood under a bidirectional window network.

The network sees the words on both sides of a position (their embeddings, weighted by distance) and
predicts the word there: first its class, then the word within the class, so a prediction costs two
small softmaxes. The vocabulary is counted over all texts: the most frequent words, in classes of
neighbouring frequency, have entries of their own, all others share hashed ones. The numbers of own
words, shared entries and words of a class grow with the root of the vocabulary. The table of all word
counts stays in Spark: a word without an entry has its share of the count of its shared entry, joined
by shuffle when texts are scored. Training is numpy
inside Spark tasks, by rounds of parameter averaging: every partition starts from the round's model,
goes through all its texts with one position in ROUNDS masked (the others in the other rounds), and
the models are averaged in the shuffle, weighted by what they saw. So what is gathered grows with the
corpus. Scoring predicts every token of every text from both sides and sums its conditional log-probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written
from .textarrays import ALNUM_SPLIT, list_array, slices, with_struct, words

#: Words with an entry of their own, hashed entries for all others, words of a class: at least.
OWN = 3840
SHARED = 256
CLASS = 64
#: Own words are so many times the root of the number of distinct words, where that is more.
OWN_PER_ROOT = 4
#: Weight in its shared entry of all words that were never counted.
UNSEEN = 0.5
WINDOW = 2
SIZE = 16
#: Each round masks another one of so many positions, so together they learn from every position once.
ROUNDS = 2
RATE = 0.12
#: Largest change of a parameter in one step.
MOST = 0.25
#: Below this bound exp() of single precision is far from overflow, and a row's sum from nothing.
SAFE = 60.0
_CHUNK = 1 << 20
#: Text bytes whose words are counted at once: the more, the fewer rows are left for Spark to add up.
_COUNTED = 8 << 20
_STEP = 4096
#: So many places are handled at once, or those of one class, so that their probabilities stay in a core's cache.
_BLOCK = 1024
_SCORE = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("others", T.ArrayType(T.LongType()))])


class Vocabulary:
    """Entries by hash: own words first, most frequent first; entry n is the edge of a text."""

    def __init__(self, hashes: np.ndarray, shared: int = SHARED, class_size: int = CLASS) -> None:
        self.shared = shared
        self.n = -(-(hashes.size + shared) // class_size) * class_size
        self.own, self.class_size = hashes.size, class_size
        self.classes = self.n // class_size
        # a slot for each value of the first bits of a hash; of words that share one the most frequent has it, the others are searched for
        self.hashes, bits = hashes, (8 * hashes.size).bit_length()
        self.shift = np.uint64(64 - max(bits, 1))
        slot = hashes >> self.shift
        self.slots, self.crowded = np.zeros(1 << max(bits, 1), np.int32), np.zeros(1 << max(bits, 1), bool)
        self.slots[slot[::-1]] = np.arange(hashes.size)[::-1]
        late = np.flatnonzero(self.slots[slot] != np.arange(hashes.size))
        self.crowded[slot[late]] = True
        self.late = late[np.argsort(hashes[late])]
        self.sorted = hashes[self.late]

    def entries(self, hashes: np.ndarray) -> np.ndarray:
        out = self.own + (hashes % np.uint64(self.shared)).astype(np.int64)
        if not self.own:
            return out
        slot = (hashes >> self.shift).view(np.int64)
        entry = self.slots.take(slot)
        hit = self.hashes.take(entry) == hashes
        np.copyto(out, entry, where=hit)
        if self.late.size:
            again = np.flatnonzero(self.crowded.take(slot) & ~hit)
            sought = hashes[again]
            at = np.minimum(np.searchsorted(self.sorted, sought), self.late.size - 1)
            found = self.sorted[at] == sought
            out[again[found]] = self.late[at[found]]
        return out


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """h, n: the hash and count of every word of all texts, as a written table."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, _COUNTED):
                h, n = np.unique(words(part.column(at), ALNUM_SPLIT)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return written(docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")


def frequent_words(counts: DataFrame, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the own most frequent words, most frequent first, ties by hash."""
    top = counts.orderBy(F.desc("n"), "h").limit(own).toArrow()
    if not top.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0)
    return top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(float)


def bucket_of(h: Column, shared: int) -> Column:
    """The shared entry of a hash: the remainder of its 64 bits without a sign."""
    m = F.lit(shared).cast("long")
    return F.pmod(F.pmod(h, m) + F.when(h < 0, F.lit((1 << 64) % shared)).otherwise(F.lit(0)), m)


def with_log_share(tokens: DataFrame, rare: DataFrame, shared: int) -> DataFrame:
    """tokens (h, ...) with log_share: of a word without an entry of its own in its shared entry.

    rare: h, n of all such words. Counts are smoothed by UNSEEN, and all words that were never
    counted have one place of that weight, so the shares of an entry sum to one.
    """
    buckets = rare.groupBy(bucket_of(F.col("h"), shared).alias("bucket")).agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    known = tokens.join(rare, "h", "left").withColumn("bucket", bucket_of(F.col("h"), shared)).join(F.broadcast(buckets), "bucket", "left")
    zero = F.lit(0).cast("long")
    share = (F.coalesce("n", zero) + UNSEEN) / (F.coalesce("all", zero) + UNSEEN * (F.coalesce("kinds", zero) + 1))
    return known.withColumn("log_share", F.log(share)).drop("n", "bucket", "all", "kinds")


class WindowNet:
    """Starts as the unigram distribution where counts (of the own words) and the total are given."""

    def __init__(self, vocabulary: Vocabulary, counts: np.ndarray | None = None, total: int = 0, window: int = WINDOW, size: int = SIZE, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        v, self.window = vocabulary, window
        often = np.ones(v.n)
        if counts is not None:
            often[: v.own] = counts + 1
            often[v.own : v.own + v.shared] += max(total - counts.sum(), 0) / v.shared
        often = often.reshape(v.classes, v.class_size)
        self.vocabulary = v
        self.params = {
            "left": rng.normal(0, 0.1, (v.n + 1, size)).astype(np.float32),
            "right": rng.normal(0, 0.1, (v.n + 1, size)).astype(np.float32),
            "class": np.zeros((size, v.classes), np.float32),
            "class_bias": np.log(often.sum(axis=1) / often.sum()).astype(np.float32),
            "word": np.zeros((v.classes, size, v.class_size), np.float32),
            "word_bias": np.log(often / often.sum(axis=1, keepdims=True)).astype(np.float32),
        }

    def padded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries with edges between texts, the place of each word among them, and its row."""
        return self.padded_words(*words(texts, ALNUM_SPLIT), len(texts))

    def padded_words(self, hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same from the words of n texts."""
        place = np.arange(hashes.size) + (row + 1) * self.window
        line = np.full(hashes.size + (n + 1) * self.window, self.vocabulary.n, np.int64)
        line[place] = self.vocabulary.entries(hashes)
        return line, place, row

    def hidden(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        left, right = self.params["left"], self.params["right"]
        x = left.take(line.take(at - 1), axis=0)
        x += right.take(line.take(at + 1), axis=0)
        for k in range(2, self.window + 1):
            far = left.take(line.take(at - k), axis=0)
            far += right.take(line.take(at + k), axis=0)
            far /= k
            x += far
        return np.tanh(x, out=x)

    def _with_bias(self) -> tuple[np.ndarray, np.ndarray]:
        """Copies of the parameters of classes and of words, biases as a last row: hidden values get a last column of ones."""
        p = self.params
        return np.concatenate([p["class"], p["class_bias"][None]]), np.concatenate([p["word"], p["word_bias"][:, None]], axis=1)

    @staticmethod
    def _most(classes: np.ndarray, words_: np.ndarray) -> tuple[float, list[float]]:
        """The most that |z| can be for classes, and for the words of each class: hidden values are between -1 and 1."""
        return float(np.abs(classes).sum(axis=0).max()), np.abs(words_).sum(axis=1).max(axis=1).tolist()

    def _bounds(self) -> tuple[float, list[float]]:
        return self._most(*self._with_bias())

    def log_probabilities(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the word at each place given the words around it."""
        out, c = np.empty(at.size), self.vocabulary.class_size
        classes, words_ = self._with_bias()
        of_class, of_word = self._most(classes, words_)
        room = np.empty((_BLOCK, max(c, self.vocabulary.classes)), classes.dtype)

        def score(h: np.ndarray, w: np.ndarray, target: np.ndarray, most: float) -> np.ndarray:
            z = room.reshape(-1)[: target.size * w.shape[1]].reshape(target.size, -1)
            _shifted(np.matmul(h, w, out=z), most)
            own = _picked(z, target)
            return own - np.log(_row_sums(np.exp(z, out=z)))

        for a in range(0, at.size, 1 << 15):
            part = at[a : a + (1 << 15)]
            target = line.take(part)
            by = _order(target // c, self.vocabulary.classes)
            part, target = part[by], target[by]
            h = _with_ones(self.hidden(line, part))
            group, word = target // c, target % c
            done = np.empty(part.size, h.dtype)
            for i in range(0, part.size, _BLOCK):
                done[i : i + _BLOCK] = score(h[i : i + _BLOCK], classes, group[i : i + _BLOCK], of_class)
            for g, begin, end in _runs(group):
                for i in range(begin, end, _BLOCK):
                    j = min(i + _BLOCK, end)
                    done[i:j] += score(h[i:j], words_[g], word[i:j], of_word[g])
            out[a + by] = done
        return out

    def train(self, line: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One pass of minibatch steps over the masked places, with clipped gradients.

        z and y hold exp() of a row and stay unnormalised: their sums divide what they are multiplied with,
        which has fewer columns.
        """
        p, c, size = self.params, self.vocabulary.class_size, self.params["class"].shape[0]
        classes, words_ = self._with_bias()
        room = np.empty((min(_STEP, at.size), c), classes.dtype)
        steps = np.zeros_like(words_)
        sums = RowSums(self.vocabulary.n + 1, size, classes.dtype)
        for a in range(0, at.size, _STEP):
            part = at[a : a + _STEP]
            part = part[_order(line.take(part) // c, self.vocabulary.classes)]
            target = line.take(part)
            group, word, n = target // c, target % c, part.size
            h = _with_ones(self.hidden(line, part))
            of_class, of_word = self._most(classes, words_)
            z = _shifted(h @ classes, of_class)
            total = _row_sums(np.exp(z, out=z))[:, None]
            _pick(z, group, total[:, 0])
            dh = z @ classes[:size].T
            dh /= total
            classes -= _bounded((h / total).T @ z, rate / math.sqrt(n))
            dw, each = np.empty_like(dh), (rate / np.sqrt(np.bincount(group)[group])).astype(dh.dtype)
            for _, block in groupby(_runs(group), lambda run: run[1] // _BLOCK):
                runs = list(block)
                low, high = runs[0][1], runs[-1][2]
                y = room[: high - low]
                for g, i, j in runs:
                    _shifted(np.matmul(h[i:j], words_[g], out=y[i - low : j - low]), of_word[g])
                total = _row_sums(np.exp(y, out=y))[:, None]
                _pick(y, word[low:high], total[:, 0])
                weighed = (h[low:high] * (each[low:high, None] / total)).T
                for g, i, j in runs:
                    y_g = y[i - low : j - low]
                    np.matmul(y_g, words_[g, :size].T, out=dw[i:j])
                    np.matmul(weighed[:, i - low : j - low], y_g, out=steps[g])
                dw[low:high] /= total
            dh += dw
            words_ -= _bounded(steps, 1)
            steps[:] = 0
            h = h[:, :size]
            dh *= 1 - h * h
            dx = np.minimum(np.maximum(dh, -1, out=dh), 1, out=dh)
            dx *= rate
            for k in range(1, self.window + 1):
                for name, side in (("left", -k), ("right", k)):
                    entry, step = sums(line.take(part + side), dx)
                    step /= k
                    new = p[name].take(entry, axis=0)
                    new -= np.minimum(np.maximum(step, -1, out=step), 1, out=step)
                    _rows(p[name])[entry] = _rows(new)
        p["class"][:], p["class_bias"][:] = classes[:size], classes[size]
        p["word"][:], p["word_bias"][:] = words_[:, :size], words_[:, size]

    def blocks(self) -> Iterator[tuple[str, int, np.ndarray]]:
        """The parameters in pieces of 64 kB at most."""
        for name, value in sorted(self.params.items()):
            flat = value.ravel()
            for k, a in enumerate(range(0, flat.size, 1 << 14)):
                yield name, k, flat[a : a + (1 << 14)]


class RowSums:
    """Sums of rows by entry, made many times for the same number of entries."""

    def __init__(self, n: int, size: int, kind: np.dtype) -> None:
        half = -(-size // 2)  # two numbers are added as a complex one: half as many additions
        self.size, self.seen = size, np.zeros(n, bool)
        self.sums, self.zero = np.zeros((n, 2 * half), kind), np.zeros((1, 2 * half), kind)
        self.pairs = self.sums.reshape(-1).view(np.result_type(kind, np.complex64))
        self.place = np.arange(n * half).reshape(n, half)

    def __call__(self, entry: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct entries, in order, and the sum of the rows of x of each."""
        if self.sums.shape[1] != self.size:
            x = np.pad(x, ((0, 0), (0, 1)))
        np.add.at(self.pairs, self.place.take(entry, axis=0).reshape(-1), x.reshape(-1).view(self.pairs.dtype))
        self.seen[entry] = True
        some = np.flatnonzero(self.seen)
        out = self.sums.take(some, axis=0)[:, : self.size]
        _rows(self.sums)[some] = _rows(self.zero)
        self.seen[some] = False
        return some, out


def _rows(a: np.ndarray) -> np.ndarray:
    """Each row as one item: those are set by index several times faster."""
    return a.view(np.dtype((np.void, a.itemsize * a.shape[1]))).reshape(-1)


def _with_ones(h: np.ndarray) -> np.ndarray:
    """h with a last column of ones."""
    out = np.ones((h.shape[0], h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def _runs(group: np.ndarray) -> list[tuple[int, int, int]]:
    """Value, begin and end of the runs of equal values."""
    edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), group.size)
    return list(zip(group[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _shifted(z: np.ndarray, most: float) -> np.ndarray:
    """z, in place, with the largest of each row subtracted; as it is where most, a bound of all |z|, is far from overflow of exp()."""
    if not most < SAFE:
        z -= z.max(axis=1, keepdims=True)
    return z


def _at(z: np.ndarray, column: np.ndarray) -> np.ndarray:
    return np.arange(0, z.size, z.shape[1]) + column


def _picked(z: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The number in the given column of each row."""
    return z.reshape(-1).take(_at(z, column))


def _pick(z: np.ndarray, column: np.ndarray, less: np.ndarray) -> None:
    """Subtracts less from the number in the given column of each row."""
    z.reshape(-1)[_at(z, column)] -= less


def _row_sums(z: np.ndarray) -> np.ndarray:
    """Of each row, as a product with ones: much faster than a sum over short rows."""
    return z @ np.ones(z.shape[1], z.dtype)


def _bounded(step: np.ndarray, rate: float) -> np.ndarray:
    """step times rate, in place: a step of at most MOST for each parameter: thousands of equal words may not throw it far."""
    if rate != 1:
        step *= rate
    return np.minimum(np.maximum(step, -MOST, out=step), MOST, out=step)


def _order(entries: np.ndarray, n: int) -> np.ndarray:
    """A stable order of numbers below n; 16-bit ones are sorted by radix."""
    return np.argsort(entries.astype(np.uint16) if n <= 1 << 16 else entries, kind="stable")


def masked_places(place: np.ndarray, row: np.ndarray, round_: int, stride: int) -> np.ndarray:
    """The places to learn from in a round, counted from the start of each text; so many rounds as stride have each place once."""
    many = np.bincount(row) if row.size else np.zeros(0, np.int64)
    number = np.arange(row.size) - (np.cumsum(many) - many)[row]
    return place[(number + round_) % stride == 0]


def _averaged(docs: DataFrame, text: str, net: WindowNet, round_: int, stride: int, rate: float) -> None:
    """One round: every partition trains on all its texts; net becomes the average by masked places.

    Partial averages of ROOT partitions each are averaged again, so no task gets all models.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((net.vocabulary, net.window, net.params))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, window, params = sent.value
        own = WindowNet.__new__(WindowNet)
        own.vocabulary, own.window, own.params = vocabulary, window, {k: v.copy() for k, v in params.items()}
        seen = 0
        for batch in batches:
            for part in slices(batch, at, _CHUNK):
                line, place, row = own.padded(part.column(at))
                masked = masked_places(place, row, round_, stride)
                own.train(line, np.random.default_rng(round_).permutation(masked), rate)
                seen += masked.size
        if not seen:
            return
        rows = list(own.blocks())
        group = TaskContext.get().partitionId() // 64
        yield pa.RecordBatch.from_arrays([pa.array([group] * len(rows)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([float(seen)] * len(rows)), pa.array([r[2].astype("<f4").tobytes() for r in rows], pa.binary())], names=["part", "name", "block", "seen", "data"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, key = None, 0.0, None
        for batch in batches:
            for r in batch.to_pylist():
                value = np.frombuffer(r["data"], "<f4").astype(np.float64) * r["seen"]
                total = value if total is None else total + value
                seen, key = seen + r["seen"], r
        yield pa.RecordBatch.from_arrays([pa.array([key["part"] // 64]), pa.array([key["name"]]), pa.array([key["block"]], pa.int32()), pa.array([seen]), pa.array([(total / seen).astype("<f4").tobytes()], pa.binary())], names=["part", "name", "block", "seen", "data"])

    schema = "part long, name string, block int, seen double, data binary"
    models = docs.mapInArrow(run, schema)
    parts = docs.rdd.getNumPartitions()
    while True:
        models = models.groupBy("part", "name", "block").applyInArrow(lambda t: pa.Table.from_batches(list(mean(t.to_batches()))), schema)
        if parts <= 64:
            break
        parts = -(-parts // 64)
    for r in models.collect():  # one model
        flat = net.params[r["name"]].reshape(-1)
        data = np.frombuffer(r["data"], "<f4")
        flat[r["block"] * (1 << 14) : r["block"] * (1 << 14) + data.size] = data


def fit_language_model(docs: DataFrame, *, text: str = "text", own: int | None = None, rounds: int = ROUNDS, stride: int | None = None, rate: float = RATE) -> WindowNet:
    """The network trained on all texts. Null and empty texts add nothing; without words it is untrained.

    stride, rounds by default, may not be larger than rounds: every position is learned from.
    """
    return _fitted(docs, text, own, rounds, stride, rate)[0]


def _fitted(docs: DataFrame, text: str = "text", own: int | None = None, rounds: int = ROUNDS, stride: int | None = None, rate: float = RATE) -> tuple[WindowNet, DataFrame]:
    """The network, and h, n of all words that have no entry of their own."""
    stride = stride or rounds
    if stride > rounds:
        raise ValueError(f"{rounds} rounds leave out positions at a stride of {stride}")
    rows = docs.select(F.col(text).cast("string").alias("text"))
    all_words = word_counts(rows, "text")
    kinds, total = all_words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    own = own or max(OWN, OWN_PER_ROOT * math.isqrt(kinds))
    hashes, counts = frequent_words(all_words, own)
    shared = max(SHARED, own // 15)
    class_size = max(CLASS, 1 << math.ceil(math.log2(own + shared) / 2))  # fewer classes than words of one: they cost more
    net = WindowNet(Vocabulary(hashes, shared, class_size), counts, total)
    for k in range(rounds):
        _averaged(rows, "text", net, k, stride, rate / (1 + k))
    if not hashes.size:
        return net, all_words
    n, h = int(counts[-1]), int(hashes[-1:].view(np.int64)[0])
    return net, all_words.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("h") > h)))


def score_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, log_likelihood (natural, summed), mean_log_likelihood.

    A text without words, null and empty ones too, has 0 tokens, a sum of 0 and a null mean. Texts are
    read whole, however long. Rows that repeat a text have one score and are all learned from; other
    columns are left out; an empty table gives no rows. What is masked depends on the texts alone, but
    models are averaged over the partitions of docs, so scores of another partitioning differ slightly.
    """
    net, rare = _fitted(docs, text, **options)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def start():
        own = sent.value

        def score(texts: pa.Array) -> list:
            hashes, row = words(texts, ALNUM_SPLIT)
            n = len(texts)
            line, place, _ = own.padded_words(hashes, row, n)
            likelihood = np.bincount(row, weights=own.log_probabilities(line, place), minlength=n).astype(float)
            other = line[place] >= own.vocabulary.own
            return [pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(likelihood), list_array(hashes[other].view(np.int64), row[other], n, pa.int64())]

        return score

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = with_struct(base, "text", "s", _SCORE, start, _CHUNK).select(F.monotonically_increasing_id().alias("row"), "doc_id", "s.*")
    scored = written(scored, "scores")
    tokens = scored.select("row", F.explode("others").alias("h"))
    shares = with_log_share(tokens, rare, net.vocabulary.shared).groupBy("row").agg(F.sum("log_share").alias("share"))
    out = scored.drop("others").join(shares, "row", "left")
    out = out.select("doc_id", "n_tokens", (F.col("log_likelihood") + F.coalesce("share", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
