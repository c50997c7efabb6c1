"""Toxicity scores by a convolutional network over hashed word embeddings, trained in numpy.

A word's vector is the sum of three hashed embeddings: of the word and of its first 4 and 6 bytes, so
that inflected forms share what they have in common. Filters of several widths run over the words, each
filter's largest response in the text is one feature (so texts count whole, however long), and a
logistic unit gives the score. Filters and embeddings learn by Adagrad from all labelled rows: in each
round every partition trains on its rows, and the models are averaged, an embedding over those that
learned it; the driver sees only the average. The model (a few MB, fixed by its parameters) is
broadcast; scoring is one pass over the documents without a shuffle. Only the text is an input of the
score. About every fifth labelled row is held back from the first rounds; those calibrate the score and
the decision thresholds by language and are learned from in the last round, as often as the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import forget, written
from .textarrays import ALNUM_SPLIT, fresh_name, give_back, slices, span_hashes, spans, text_bytes, with_struct

WIDTHS = (1, 2, 3)
FILTERS = 12
SIZE = 12
BUCKETS = 1 << 15
PREFIXES = (4, 6)
#: Rounds over all labelled rows.
EPOCHS = 3
#: Few rows are gone through more often in a round, until so many were seen in all.
SEEN_ROWS = 24_000
#: A model of a round learns from so many rows or bytes of text at least, where there are as many.
MODEL_ROWS = 4000
MODEL_BYTES = 16 << 20
#: Bytes of hashed words that a task trains on at once; a longer text is alone.
HELD_BYTES = 32 << 20
#: Rows held back that a language needs for a threshold of its own.
LANGUAGE_ROWS = 50
_BLOCK = 1 << 15
_SHIFT = np.arange(1 + len(PREFIXES)) * BUCKETS
#: Entries of a parameter that are averaged together, and models that meet in a task.
_ENTRIES = 1 << 14
_MODELS = 64
_PART = "part long, name string, block int, at binary, weight binary, data binary, sums binary"
#: Where thresholds may be.
_CUTS = np.linspace(0.05, 0.95, 91)
_LOGIT = T.StructType([T.StructField("z", T.DoubleType())])
_SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for each word (words x 3), and each word's text."""
    data, offsets = text_bytes(texts)
    starts, ends, row = spans(data, offsets, ALNUM_SPLIT)
    out = np.empty((starts.size, 1 + len(PREFIXES)), np.int64)
    for k, size in enumerate((None, *PREFIXES)):
        h = span_hashes(data, starts, ends if size is None else np.minimum(ends, starts + size))
        out[:, k] = (h % np.uint64(BUCKETS)).astype(np.int64) + k * BUCKETS
    return out, row


@dataclass
class ConvNet:
    widths: tuple = WIDTHS
    filters: int = FILTERS
    size: int = SIZE
    params: dict = field(default_factory=dict)

    def start(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.params = {"table": rng.normal(0, 0.1, ((1 + len(PREFIXES)) * BUCKETS, self.size)).astype(np.float32), "out": rng.normal(0, 0.1, len(self.widths) * self.filters).astype(np.float32), "bias": np.zeros(1, np.float32), "shift": np.zeros(len(self.widths) * self.filters, np.float32)}
        for w in self.widths:
            self.params[f"w{w}"] = rng.normal(0, 0.5 / np.sqrt(w), (w, self.size, self.filters)).astype(np.float32)

    def _responses(self, ids: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Every filter at each word of one text; beyond its last word (and tail) stand zeros."""
        most = max(self.widths) - 1
        whole = np.concatenate([ids, tail])
        x = self.params["table"][whole].sum(axis=1)
        x = np.concatenate([x, np.zeros((most + ids.shape[0] - whole.shape[0] + most, self.size), np.float32)])
        n, out = ids.shape[0], []
        for w in self.widths:
            kernel = self.params[f"w{w}"]
            out.append(sum(x[j : j + n] @ kernel[j] for j in range(w)))
        return np.concatenate(out, axis=1)

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in one text and where it stands."""
        n = len(self.widths) * self.filters
        best, at = np.full(n, -np.inf, np.float32), np.zeros(n, np.int64)
        for a in range(0, ids.shape[0], _BLOCK):
            b = min(a + _BLOCK, ids.shape[0])
            r = self._responses(ids[a:b], ids[b : b + max(self.widths) - 1])
            k = r.argmax(axis=0)
            v = r[k, np.arange(n)]
            better = v > best
            best[better], at[better] = v[better], a + k[better]
        return best, at

    def logits(self, ids: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """The logit of each of n texts; one without words has the bias alone."""
        counts = np.bincount(row, minlength=n)
        first = np.cumsum(counts) - counts
        out = np.full(n, self.params["bias"][0], np.float64)
        p = self.params
        many = np.flatnonzero((counts > 0) & (counts <= _BLOCK))
        most = max(self.widths) - 1
        for group in np.split(many, np.flatnonzero(np.diff(np.cumsum(counts[many]) // _BLOCK)) + 1) if many.size else []:
            # the texts of a group stand together with zeros between them
            at = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in group])
            sizes = counts[group]
            heads = np.cumsum(sizes + most) - (sizes + most)
            x = np.zeros((int((sizes + most).sum()) + most, self.size), np.float32)
            place = np.arange(at.size) + np.repeat(heads - (np.cumsum(sizes) - sizes), sizes)
            x[place] = p["table"][ids[at, 0]] + p["table"][ids[at, 1]] + p["table"][ids[at, 2]]
            last = x.shape[0] - most
            r = np.concatenate([sum(x[j : j + last] @ p[f"w{w}"][j] for j in range(w)) for w in self.widths], axis=1)
            gaps = np.ones(last, bool)
            gaps[place] = False
            r[gaps] = -np.inf
            best = np.maximum.reduceat(r, heads, axis=0)
            out[group] = np.maximum(best + p["shift"], 0) @ p["out"] + p["bias"][0]
        for i in np.flatnonzero(counts > _BLOCK):
            best, _ = self.pooled(ids[first[i] : first[i] + counts[i]])
            out[i] = np.maximum(best + p["shift"], 0) @ p["out"] + p["bias"][0]
        return out

    def logit(self, words: np.ndarray) -> float:
        """The logit of one text from its 16-bit words."""
        if not words.shape[0]:
            return float(self.params["bias"][0])
        best, _ = self.pooled(words + _SHIFT)
        return float(np.maximum(best + self.params["shift"], 0) @ self.params["out"] + self.params["bias"][0])

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, learned: np.ndarray, seen: dict, epochs: int = EPOCHS, batch: int = 16, rate: float = 0.1, seed: int = 5) -> None:
        """Learn from texts as 16-bit words. seen: Adagrad's sums; learned: how often each row of the table was learned."""
        rng = np.random.default_rng(seed)
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, order.size, batch):
                some = order[a : a + batch]
                grads = {k: np.zeros_like(v) for k, v in self.params.items() if k != "table"}
                rows, deltas = [], []
                for i in some:
                    if texts[i].shape[0]:
                        self._backward(texts[i] + _SHIFT, labels[i], weight[i] / some.size, grads, rows, deltas)
                    else:
                        grads["bias"] += (1 / (1 + np.exp(-self.params["bias"])) - labels[i]) * weight[i] / some.size
                for k, g in grads.items():
                    seen[k] += g * g
                    self.params[k] -= rate * g / np.sqrt(seen[k])
                if rows:
                    unique, back = np.unique(np.concatenate(rows), return_inverse=True)
                    g = np.zeros((unique.size, self.size), np.float32)
                    np.add.at(g, back, np.concatenate(deltas))
                    seen["table"][unique] += g * g
                    self.params["table"][unique] -= rate * g / np.sqrt(seen["table"][unique])
                    learned[unique] += 1

    def _backward(self, ids: np.ndarray, label: float, weight: float, grads: dict, rows: list, deltas: list) -> None:
        p = self.params
        best, at = self.pooled(ids)
        active = np.maximum(best + p["shift"], 0)
        wrong = (1 / (1 + np.exp(-(active @ p["out"] + p["bias"][0]))) - label) * weight
        grads["out"] += wrong * active
        grads["bias"] += wrong
        up = np.where(best + p["shift"] > 0, wrong * p["out"], 0).astype(np.float32)
        grads["shift"] += up
        for k, w in enumerate(self.widths):
            u, pos = up[k * self.filters : (k + 1) * self.filters], at[k * self.filters : (k + 1) * self.filters]
            on = np.flatnonzero(u)
            for j in range(w):
                inside = on[pos[on] + j < ids.shape[0]]
                if inside.size == 0:
                    continue
                words = ids[pos[inside] + j]
                x = p["table"][words].sum(axis=1)
                grads[f"w{w}"][j][:, inside] += (u[inside, None] * x).T
                d = u[inside, None] * p[f"w{w}"][j][:, inside].T
                for c in range(words.shape[1]):
                    rows.append(words[:, c])
                    deltas.append(d)


@dataclass
class Toxicity:
    net: ConvNet
    scale: float
    shift: float
    #: By language, and None for any other.
    thresholds: dict

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        batch = pa.RecordBatch.from_arrays([texts], ["t"])
        for part in slices(batch, 0, 1 << 20):
            ids, row = features(part.column(0))
            out.append(self.net.logits(ids, row, part.num_rows))
        z = np.concatenate([*out, np.zeros(0)]) * self.scale + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _hashed(texts: pa.Array) -> list[np.ndarray]:
    """The words of each text as 16-bit rows of the three parts of the embedding table."""
    ids, row = features(texts)
    small = (ids % BUCKETS).astype("<u2")
    ends = np.cumsum(np.bincount(row, minlength=len(texts)))
    return np.split(small, ends[:-1]) if len(texts) else []


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str, label: str, rows: int | None) -> DataFrame:
    """text, lang, label of the rows to learn from, and whether they calibrate."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).where(~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    if rows is not None:
        halves = [known.where(F.col("label") == v).orderBy(F.xxhash64("_id"), "_id").limit(rows // 2) for v in (0, 1)]
        known = halves[0].unionByName(halves[1])
    own = docs.where(~held_out(F.col(doc_id))).select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"), (F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")).alias("lang"))
    return own.join(known.hint("merge"), "_id").select("text", "lang", "label", (F.pmod(F.xxhash64("_id"), F.lit(5)) == 4).alias("calibrates"))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Hashed words and labels of (text, label) rows, HELD_BYTES at once or a longer text alone."""
    words, labels, size = [], [], 0
    for batch in batches:
        for part in slices(batch, 0, 1 << 20):
            made = _hashed(part.column(0))
            new = sum(w.nbytes for w in made)
            if words and size + new > HELD_BYTES:
                yield words, np.concatenate(labels)
                words, labels, size = [], [], 0
            words, size = [*words, *made], size + new
            labels.append(part.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
    if words:
        yield words, np.concatenate(labels)


def _entries(a: np.ndarray, name: str) -> np.ndarray:
    """A parameter by its entries: rows of the table, single numbers of all others."""
    return a.reshape(-1, a.shape[-1] if name == "table" else 1)


def _blocks(net: ConvNet, sums: dict, learned: np.ndarray, seen: int) -> Iterator[tuple]:
    """name, block, and places, weights, values and Adagrad's sum of the entries of a trained model that were learned."""
    for name, value in net.params.items():
        flat, sum_ = _entries(value, name), _entries(sums[name], name).mean(axis=1)
        weight = learned if name == "table" else np.full(flat.shape[0], seen)
        for k in range(0, flat.shape[0], _ENTRIES):
            at = np.flatnonzero(weight[k : k + _ENTRIES])
            if at.size:
                yield name, k // _ENTRIES, at.astype("<i4").tobytes(), weight[k + at].astype("<f8").tobytes(), flat[k + at].astype("<f4").tobytes(), sum_[k + at].astype("<f4").tobytes()


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["part", "name", "block", "at", "weight", "data", "sums"])


def _mean(models: pa.Table) -> pa.Table:
    """One block averaged over models, each entry over those that learned it."""
    total, weights, key = None, np.zeros(_ENTRIES), None
    for batch in models.to_batches():
        for key in batch.to_pylist():
            at, weight = np.frombuffer(key["at"], "<i4"), np.frombuffer(key["weight"], "<f8")
            value = np.column_stack([np.frombuffer(key["data"], "<f4").reshape(at.size, -1), np.frombuffer(key["sums"], "<f4")])
            total = np.zeros((_ENTRIES, value.shape[1])) if total is None else total
            total[at] += value * weight[:, None]
            weights[at] += weight
    at = np.flatnonzero(weights)
    mean = (total[at] / weights[at, None]).astype("<f4")
    row = key["part"] // _MODELS, key["name"], key["block"], at.astype("<i4").tobytes(), weights[at].astype("<f8").tobytes(), mean[:, :-1].tobytes(), mean[:, -1].tobytes()
    return pa.Table.from_batches([_parts([row])])


def _round(rows: DataFrame, net: ConvNet, sums: dict, share: float, epochs: int, round_: int) -> None:
    """Every partition of rows (text, label) trains net on all of them; net and sums (Adagrad's, one for an entry) become the average. share: of label 1."""
    sent = rows.sparkSession.sparkContext.broadcast((net.params, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, sums = sent.value
        own = ConvNet(params={k: v.copy() for k, v in params.items()})
        sums = {k: (np.zeros_like(_entries(v, k)) + sums[k][:, None]).reshape(v.shape) for k, v in own.params.items()}
        learned, n = np.zeros(own.params["table"].shape[0], np.int64), 0
        for words, labels in _held(batches):
            own.fit(words, labels, np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)), learned, sums, epochs, seed=5 + round_)
            n += len(words)
        if n:
            part = TaskContext.get().partitionId() // _MODELS
            yield _parts([(part, *block) for block in _blocks(own, sums, learned, n)])
        give_back()

    models, parts = rows.mapInArrow(run, _PART), rows.rdd.getNumPartitions()
    while True:
        models = models.groupBy("part", "name", "block").applyInArrow(_mean, _PART)
        if parts <= _MODELS:
            break
        parts = -(-parts // _MODELS)
    for r in models.collect():  # one model
        flat, at = _entries(net.params[r["name"]], r["name"]), np.frombuffer(r["at"], "<i4")
        flat[r["block"] * _ENTRIES + at] = np.frombuffer(r["data"], "<f4").reshape(at.size, -1)
        sums[r["name"]][r["block"] * _ENTRIES + at] = np.frombuffer(r["sums"], "<f4")
    sent.destroy()


def _platt(z: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """scale and shift of a logistic calibration with a small ridge, by Newton steps that are halved until they lower the loss; n: rows that each logit stands for."""
    x, at = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    away = lambda t: t - np.array([1.0, 0.0])
    loss = lambda t: (n * (np.logaddexp(0, x @ t) - y * (x @ t))).sum() + 0.5e-2 * (away(t) ** 2).sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) * n)[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ ((p - y) * n) + 1e-2 * away(at))
        while loss(at - step) > loss(at) and np.abs(step).max() >= 1e-8:
            step /= 2
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(at[0], 1e-3)), float(at[1])


def _threshold(reached: list, n: list, ones: list) -> float:
    """The middle of the widest run of cuts with the best F1, from the rows and those of label 1 by how many cuts they reach; 0.5 where a label is missing."""
    if sum(ones) in (0, sum(n)):
        return 0.5
    many, good = (np.bincount(reached, weights=w, minlength=_CUTS.size + 1)[::-1].cumsum()[::-1][1:] for w in (n, ones))
    f1 = 2 * good / np.maximum(1, many + sum(ones))
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(_CUTS[best[best.size // 2]])


def _calibrated(rows: DataFrame, net: ConvNet) -> Toxicity:
    """The model with scale, shift and thresholds from rows (text, lang, label). Only counts by bin reach the driver."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def start():
        def logits(texts: pa.Array) -> list:
            ids, row = features(texts)
            return [pa.array(sent.value.logits(ids, row, len(texts)))]

        return logits

    told = written(with_struct(rows, "text", "w", _LOGIT, start, 1 << 20).select("lang", "label", F.col("w.z").alias("z")), "logits")
    bins = told.groupBy(F.round(F.greatest(F.least("z", F.lit(64.0)), F.lit(-64.0)) * 32), "label").agg(F.count("*").alias("n"), F.avg("z").alias("z")).collect()
    z, y, n = (np.array([r[k] for r in bins], np.float64) for k in ("z", "label", "n"))
    scale, shift = _platt(z, y, n) if bins else (1.0, 0.0)
    least = [float((np.log(c / (1 - c)) - shift) / scale) for c in _CUTS]
    reached = told.groupBy("lang", F.size(F.filter(F.array(*map(F.lit, least)), lambda c: F.col("z") >= c)).alias("reached")).agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    total = reached.groupBy("reached").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).agg(F.collect_list(F.struct("reached", "n", "ones")).alias("cuts")).select(F.lit(None).cast("string").alias("lang"), "cuts")
    large = reached.where("lang IS NOT NULL").groupBy("lang").agg(F.collect_list(F.struct("reached", "n", "ones")).alias("cuts"), F.sum("n").alias("rows")).where(F.col("rows") >= LANGUAGE_ROWS).select("lang", "cuts")
    thresholds = {r["lang"]: _threshold(*([c[k] for c in r["cuts"]] for k in ("reached", "n", "ones"))) for r in total.unionByName(large).collect()}
    forget(told)
    return Toxicity(net, scale, shift, thresholds)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", sample_rows: int | None = None, epochs: int = EPOCHS) -> Toxicity:
    """A model of the label, from all labelled rows and their whole texts; from sample_rows of them at most, if it is given.

    A document whose rows disagree counts as toxic; every row of its text is learned from. Labels that
    are not 0 or 1, and ids whose crc32 modulo 5 is 0, are not learned from. Without labelled rows every
    score is 0.5 at most. lang may be missing; a language with LANGUAGE_ROWS rows held back has a
    threshold of its own. Models are averaged over the partitions of the rows, so another partitioning
    gives slightly other scores.
    """
    net = ConvNet()
    net.start()
    rows = written(_labelled(docs, labels, doc_id, text, lang, label, sample_rows), "labelled")
    n, ones, size = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if ones in (0, n):
        net.params["out"][:] = 0
        return Toxicity(net, 1.0, 0.0 if n and ones else -1.0, {None: 0.5})
    models = max(1, -(-n // MODEL_ROWS), -(-size // MODEL_BYTES))
    learn, rest = (rows.where(c).select("text", "label").coalesce(models) for c in (~F.col("calibrates"), F.col("calibrates")))
    passes = max(1, min(4, SEEN_ROWS // (epochs * n)))
    sums = {k: np.full(_entries(v, k).shape[0], 1e-2, np.float32) for k, v in net.params.items()}
    for k in range(epochs):
        _round(learn, net, sums, ones / n, passes, k)
    model = _calibrated(rows.where("calibrates").select("text", "lang", "label"), net)
    _round(rest, net, sums, ones / n, epochs * passes, epochs)
    forget(rows)
    return model


def with_scores(docs: DataFrame, model: Toxicity, *, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a struct column (score), and its name. Null and empty texts have one fixed score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = fresh_name(docs, "_toxicity")
    return with_struct(docs, text, name, _SCORE, lambda: lambda t: [pa.array(sent.value.scores(t.cast(pa.string()) if isinstance(t, pa.Array) else t))]), name


def flagged(score: Column, lang: Column, model: Toxicity) -> Column:
    """Whether the score reaches the threshold of the language, or the general one for others and null."""
    least = F.lit(model.thresholds[None])
    for name, cut in sorted((k, v) for k, v in model.thresholds.items() if k is not None):
        least = F.when(lang == name, F.lit(cut)).otherwise(least)
    return score >= least


def drop_toxic(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """docs without the texts that reach their language's threshold; columns as before.

    A null or unknown language, or a missing column, has the general threshold. Null and empty texts
    have one score. Repeated rows stay or go together.
    """
    model = fit_toxicity(docs, labels, doc_id=doc_id, text=text, lang=lang, **options)
    scored, name = with_scores(docs, model, text=text)
    language = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    return scored.where(~flagged(F.col(name)["score"], language, model)).drop(name)
