"""Quality by co-training of a text-content and a page-metadata classifier.

Both views are naive Bayes tables of discrete features. The text view has bins of shares of signs,
letters, repeats and lengths of the whole text, and its distinct words, hashed; the metadata view has
source, language and length as the crawl gave them. They start from a bounded sample of labelled rows.
In each round one pass over all documents scores both views; the rows that one view is sure of are
counted, with that label, into the other view's table, while labelled rows keep their labels. Tables are
sums over a fixed number of features, so a round is one aggregation with a bounded number of rows from
each task. Each view is then calibrated on labelled rows that its table does not hold, a logistic unit
joins them, and all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written
from .textarrays import BLANK_SPLIT, fresh_name, slices, span_hashes, spans, text_bytes, with_struct

#: Labelled rows that are learned from, at most.
SAMPLE_ROWS = 20_000
ROUNDS = 2
#: A view is sure of a label at this calibrated probability.
SURE = 0.98
#: Pseudo-labelled rows together weigh so many times a view's labelled rows at most. Measured, they do best in full.
PSEUDO_WEIGHT = float("inf")
_CHUNK = 1 << 20
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CUTS = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.7, 0.9])
_SHARES = len(_SIGNS) + 7
TEXT_FEATURES = (_SHARES + 2) * 32
META_FEATURES = 64 + 32 + 32
#: Buckets of hashed words.
WORDS = 1 << 14
_ALL = TEXT_FEATURES + WORDS + META_FEATURES


@dataclass
class Features:
    """Of n texts: the bins of all measures (n x measures), and their distinct words as buckets with the row of each."""

    bins: np.ndarray
    words: np.ndarray
    row: np.ndarray


def _signs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each byte stands in each text."""
    out = np.zeros((offsets.size - 1, 256), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for k in range(a, b, _CHUNK):
            out[i] += np.bincount(data[k : min(b, k + _CHUNK)], minlength=256)
    return out


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts as they are, or one long text in parts that end at a blank."""
    if offsets.size != 2 or data.size <= 2 * _CHUNK:
        yield data, offsets
        return
    at = 0
    while at < data.size:
        end = min(at + _CHUNK, data.size)
        while end < data.size:
            blank = np.flatnonzero(~BLANK_SPLIT[data[end : end + _CHUNK]])
            end = end + int(blank[0]) if blank.size else min(end + _CHUNK, data.size)
            if blank.size:
                break
        yield data[at:end], np.array([0, end - at])
        at = end


def text_features(texts: pa.Array) -> Features:
    """Empty and null texts have the first bin of each measure and no words. A long text is read in parts."""
    data, offsets = text_bytes(texts)
    n = offsets.size - 1
    table = _signs(data, offsets)
    lower, upper = table[:, 97:123].sum(1), table[:, 65:91].sum(1)
    high, digit, line = table[:, 128:].sum(1), table[:, 48:58].sum(1), table[:, 10]
    solid = np.maximum(table.sum(1) - table[:, [9, 10, 11, 12, 13, 32]].sum(1), 1)
    count, again, signed, length = (np.zeros(n) for _ in range(4))
    own, of_own, last = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
    for part, ends_at in _parts(data, offsets):
        starts, ends, of = spans(part, ends_at, BLANK_SPLIT)
        words = span_hashes(part, starts, ends)
        count += np.bincount(of, minlength=n)
        length += np.bincount(of, weights=ends - starts, minlength=n)
        same = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        again += np.bincount(of[1:][same], minlength=n)
        if words.size:
            again[of[0]] += last is not None and last == words[0]
            last = words[-1]
            tail = part[ends - 1]
            signed += np.bincount(of[(tail < 128) & ~_ALNUM[tail]], minlength=n)
        words, of = np.concatenate([own, words]), np.concatenate([of_own, of])
        by = np.lexsort((words, of))
        words, of = words[by], of[by]
        new = np.ones(words.size, bool)
        new[1:] = (words[1:] != words[:-1]) | (of[1:] != of[:-1])
        own, of_own = words[new], of[new]
    some = np.maximum(count, 1)
    different = np.bincount(of_own, minlength=n)
    shares = [*(table[:, b] / solid for b in _SIGNS), upper / np.maximum(upper + lower, 1), high / solid, digit / solid, line / some, again / some, 1 - different / some, signed / some]
    out = np.empty((n, _SHARES + 2), np.int64)
    for k, share in enumerate(shares):
        out[:, k] = np.where(share > 0, np.searchsorted(_CUTS, share, side="right") + 1, 0) + 32 * k
    out[:, _SHARES] = np.minimum(np.log2(count + 1).astype(np.int64), 31) + 32 * _SHARES
    out[:, _SHARES + 1] = np.minimum((length / some).astype(np.int64), 31) + 32 * (_SHARES + 1)
    return Features(out, (own % np.uint64(WORDS)).astype(np.int64), of_own)


_ALNUM = np.array([chr(b).isalnum() for b in range(128)] + [True] * 128)


def meta_columns(docs: DataFrame, source: str, lang: str, n_chars: str) -> Column:
    """Three ids of the metadata view; null has its own."""
    own = lambda c: F.col(c) if c in docs.columns else F.lit(None)
    hashed = lambda c, n: F.when(own(c).isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(own(c).cast("string")), F.lit(n - 1)))
    size = F.when(own(n_chars).isNull(), F.lit(0)).otherwise(F.least(F.lit(31), 1 + F.floor(F.log2(F.greatest(own(n_chars).cast("double"), F.lit(1.0))))))
    return F.array(hashed(source, 64).cast("long"), (64 + hashed(lang, 32)).cast("long"), (96 + size).cast("long"))


def _odds(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log-odds of good against bad by feature. counts: 2 x features, bad and good; rows: how many of each."""
    smooth = (counts + 0.5) / (np.maximum(rows, 1)[:, None] + 8)
    return np.log(smooth[1] / smooth[0])


@dataclass
class Content:
    """The text view: log-odds of bins and of words, and a calibration of their sums."""

    bins: np.ndarray
    words: np.ndarray
    weights: np.ndarray

    def raw(self, f: Features) -> np.ndarray:
        """n x 2: the sum over the bins, and over the distinct words for the root of their number."""
        n = f.bins.shape[0]
        many = np.sqrt(np.maximum(np.bincount(f.row, minlength=n), 1))
        return np.column_stack([self.bins[f.bins].sum(axis=1) / 10, np.bincount(f.row, weights=self.words[f.words], minlength=n) / many])

    def logit(self, f: Features) -> np.ndarray:
        return self.raw(f) @ self.weights[:2] + self.weights[2]


@dataclass
class Page:
    """The metadata view: log-odds of its three ids, and a calibration of their sum."""

    odds: np.ndarray
    weights: np.ndarray

    def raw(self, ids: np.ndarray) -> np.ndarray:
        return self.odds[ids].sum(axis=1, keepdims=True) / 10

    def logit(self, ids: np.ndarray) -> np.ndarray:
        return self.raw(ids) @ self.weights[:1] + self.weights[1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression on the columns of x and a constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(w.size), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Quality:
    content: Content
    page: Page
    join: np.ndarray

    def probability(self, content: Column, page: Column) -> Column:
        a, b, c = (F.lit(float(v)) for v in self.join)
        z = content * a + page * b + c
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def _pages(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)


def _sums(rows: DataFrame, vote) -> tuple[np.ndarray, np.ndarray]:
    """2 x features: how often each stands in rows of label 0 and 1; and 2 x 2, the rows of each label for text and page.

    vote(features, pages, batch) gives, for text and for page, the rows of each label as masks.
    """
    at_text, at_meta = rows.columns.index("_text"), rows.columns.index("_meta")
    size = _ALL + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size))
        for batch in batches:
            for part in slices(batch, at_text, _CHUNK):
                f, pages = text_features(part.column(at_text)), _pages(part.column(at_meta))
                for v, (text, page) in enumerate(zip(*vote(f, pages, part), strict=True)):
                    sums[v, :TEXT_FEATURES] += np.bincount(f.bins[text].ravel(), minlength=TEXT_FEATURES)
                    sums[v, TEXT_FEATURES : TEXT_FEATURES + WORDS] += np.bincount(f.words[text[f.row]], minlength=WORDS)
                    sums[v, TEXT_FEATURES + WORDS : _ALL] += np.bincount(pages[page].ravel(), minlength=META_FEATURES)
                    sums[v, _ALL:] += text.sum(), page.sum()
        for v in (0, 1):
            on = np.flatnonzero(sums[v])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(on.size, v), pa.int32()), pa.array(on.astype(np.int32)), pa.array(sums[v, on])], names=["label", "feature", "n"])

    found = rows.mapInArrow(run, "label int, feature int, n double").groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, size))  # a fixed number of features, whatever the input
    out[found.column("label").to_numpy(), found.column("feature").to_numpy()] = found.column("n").to_numpy()
    return out[:, :_ALL], out[:, _ALL:]


def _calibration(labelled: DataFrame, content: Content, page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw scores of both views and labels of the rows held back from the tables: sample_rows at most."""
    at_text, at_meta = labelled.columns.index("_text"), labelled.columns.index("_meta")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at_text, _CHUNK):
                a = content.raw(text_features(part.column(at_text)))
                b = page.raw(_pages(part.column(at_meta)))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(b[:, 0]), part.column("_label")], names=["_id", "bins", "words", "page", "y"])

    kind = labelled.schema["_id"].dataType.simpleString()
    t = labelled.where(~F.col("_own")).mapInArrow(run, f"_id {kind}, bins double, words double, page double, y int").orderBy("_id", "bins", "words").toArrow()
    return np.column_stack([t.column("bins").to_numpy(), t.column("words").to_numpy()]), t.column("page").to_numpy()[:, None], t.column("y").to_numpy().astype(float)


def _added(own: np.ndarray, rows: np.ndarray, pseudo: np.ndarray, more: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """own plus pseudo and their rows, class by class, scaled down to weight times own's rows at most."""
    share = np.minimum(1.0, weight * rows / np.maximum(more, 1))
    return own + pseudo * share[:, None], rows + more * share


def fit_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", label: str = "quality", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, sure: float = SURE, weight: float = PSEUDO_WEIGHT) -> Quality:
    """The model from at most sample_rows labelled rows and pseudo-labels over all of docs.

    A document whose labels disagree counts as bad; labels that are not 0 or 1 are ignored. Half of the
    labelled ids, by a hash, make the tables, half calibrate. Rows that repeat an id all count. Without
    rows of both labels in both halves, every document gets the probability 1.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).withColumn("_own", F.crc32(F.col("_id").cast("string").cast("binary")) % 2 == 0)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"), meta_columns(docs, source, lang, n_chars).alias("_meta"))
    labelled = written(rows.join(F.broadcast(known), "_id"), "labelled")
    nothing = Quality(Content(np.zeros(TEXT_FEATURES), np.zeros(WORDS), np.zeros(3)), Page(np.zeros(META_FEATURES), np.zeros(2)), np.array([0.0, 0.0, 30.0]))

    def by_label(f: Features, pages: np.ndarray, part: pa.RecordBatch) -> tuple[list, list]:
        y = part.column("_label").to_numpy()
        return [y == 0, y == 1], [y == 0, y == 1]

    own, own_rows = _sums(labelled.where("_own"), by_label)
    if not own_rows.all():
        return nothing
    least = np.log(sure / (1 - sure))
    counts, many = own, own_rows
    for round_ in range(rounds + 1):
        cut = TEXT_FEATURES + WORDS
        content = Content(_odds(counts[:, :TEXT_FEATURES], many[:, 0]), _odds(counts[:, TEXT_FEATURES:cut], many[:, 0]), np.zeros(3))
        page = Page(_odds(counts[:, cut:], many[:, 1]), np.zeros(2))
        a, b, y = _calibration(labelled, content, page)
        if y.size == 0 or y.min() == y.max():
            return nothing
        content.weights, page.weights = logistic(a, y), logistic(b, y)
        if round_ == rounds:
            return Quality(content, page, logistic(np.column_stack([a @ content.weights[:2] + content.weights[2], b @ page.weights[:1] + page.weights[1]]), y))

        def confident(f: Features, pages: np.ndarray, part: pa.RecordBatch, content=content, page=page) -> tuple[list, list]:
            a, b = content.logit(f), page.logit(pages)
            return [b <= -least, b >= least], [a <= -least, a >= least]

        pseudo, more = _sums(rows, confident)
        text_counts, text_rows = _added(own[:, :cut], own_rows[:, 0], pseudo[:, :cut], more[:, 0], weight)
        page_counts, page_rows = _added(own[:, cut:], own_rows[:, 1], pseudo[:, cut:], more[:, 1], weight)
        counts, many = np.concatenate([text_counts, page_counts], axis=1), np.column_stack([text_rows, page_rows])
    raise ValueError("rounds must be 0 or more")


def with_quality(docs: DataFrame, model: Quality, *, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> tuple[DataFrame, Column, str, list[str]]:
    """docs with helper columns; the probability of good quality; the struct's name; the helpers to drop."""
    meta = fresh_name(docs, "_page_ids")
    rows = docs.withColumn(meta, meta_columns(docs, source, lang, n_chars))
    name = fresh_name(rows, "_quality")
    sent = docs.sparkSession.sparkContext.broadcast(model.content)  # a fixed number of features

    def start():
        view = sent.value
        return lambda t: [pa.array(view.logit(text_features(t)))]

    scored = with_struct(rows, text, name, T.StructType([T.StructField("content", T.DoubleType())]), start, _CHUNK)
    table = F.array(*(F.lit(float(v)) for v in model.page.odds))
    page = F.aggregate(F.transform(F.col(meta), lambda i: F.element_at(table, (i + 1).cast("int"))), F.lit(0.0), lambda a, b: a + b) * float(model.page.weights[0] / 10) + float(model.page.weights[1])
    return scored, model.probability(F.col(name)["content"], page), name, [meta, name]


def score_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs: doc_id, quality_score (0 to 1), predicted (1: good).

    Null and empty texts, and null metadata, are scored like any other; repeated rows have one score;
    an empty table has none. Other columns are not looked at.
    """
    model = fit_quality(docs, labels, doc_id=doc_id, **options)
    scored, probability, _, _ = with_quality(docs, model)
    return scored.select(F.col(doc_id).alias("doc_id"), probability.alias("quality_score")).withColumn("predicted", (F.col("quality_score") >= 0.5).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, **options) -> DataFrame:
    """docs whose probability of good quality is least or more; columns as before.

    Null and empty texts are scored like any other. Repeated rows stay or go together.
    """
    model = fit_quality(docs, labels, **options)
    scored, probability, _, helpers = with_quality(docs, model)
    return scored.where(probability >= least).drop(*helpers)
