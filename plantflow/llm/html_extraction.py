"""Main text of web pages by a linear-chain conditional random field over their leaf blocks.

A block's features are the names, classes, ids and roles of the elements open around it, and shapes of its text: size,
share of links, punctuation. The field has a weight for each feature and label, and one for each pair of neighbouring
labels; it is fitted to labelled pages by its likelihood (forward and backward sums in numpy) and decoded by Viterbi.
Labelled pages are layouts (page_layouts), and, as far as given pages mark their parts with landmark elements, a bounded
sample of them. The model is a few thousand numbers and goes to tasks with the plan; extraction is one pass over the pages.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .html_blocks import Block, blocks
from .page_layouts import labelled_pages
from .textarrays import give_back, slices

LAYOUT_PAGES = 800
#: Pages of the table that are looked at for landmarks, and of them those up to so many characters.
SAMPLE_PAGES = 200
SAMPLE_CHARS = 100_000
#: Elements whose text is the article's, and those whose text never is.
INSIDE, OUTSIDE = frozenset(("article", "main")), frozenset(("nav", "aside", "footer", "form", "title", "noscript", "button", "select", "menu"))
STEPS = 60
PENALTY = 0.0005
#: Blocks of a labelled page that are learned from, for padding.
LONGEST = 60
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_KEPT_TAGS = 4096


def tag_features(tag: str, attributes: str) -> tuple:
    """An element's name, and the words of its class, id and role."""
    names = _WORD.findall(" ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower()) if attributes else ()
    return (f"tag {tag}", *sorted({f"name {n}" for n in names}))


def text_features(b: Block) -> tuple:
    text, n = b.text, len(b.text)
    words = text.count(" ") + 1
    share = b.linked / n
    return (
        "any",
        f"size {min(words.bit_length(), 7)}",
        f"linked {'none' if share == 0 else 'some' if share < 0.4 else 'most'}",
        f"own {b.tag}",
        "stop" if text[-1] in ".!?…。:;\"”»" else "no stop",
        f"commas {min(text.count(',') + text.count(', '), 2)}",
        "mark" if text[0] == "©" else "no mark",
    )


@dataclass
class Field:
    """Weights of a chain with two labels: 0 for other parts, 1 for the article."""

    rows: dict = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def labels(self, scores: np.ndarray) -> list[int]:
        """The likeliest labels of a page's blocks, from their scores; ties are no article."""
        (t00, t01), (t10, t11) = self.pairs.tolist()
        a, b = self.starts.tolist()
        back = []
        for k, (x, y) in enumerate(scores.tolist()):
            if k:
                from0, from1 = b + t10 > a + t00, b + t11 > a + t01
                back.append((from0, from1))
                a, b = (b + t10 if from0 else a + t00), (b + t11 if from1 else a + t01)
            a, b = a + x, b + y
        out = [int(b > a)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]


def _chain(scores: np.ndarray, mask: np.ndarray, model: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, probability of each label, and summed probability of each pair of labels, of padded pages."""
    most = scores.shape[1]
    (t00, t01), (t10, t11) = model.pairs.tolist()
    join = np.logaddexp
    x, y, on = scores[..., 0].T, scores[..., 1].T, mask.T
    f0, f1, b0, b1 = (np.zeros(x.shape) for _ in range(4))
    f0[0], f1[0] = x[0] + model.starts[0], y[0] + model.starts[1]
    for k in range(1, most):
        f0[k] = np.where(on[k], join(f0[k - 1] + t00, f1[k - 1] + t10) + x[k], f0[k - 1])
        f1[k] = np.where(on[k], join(f0[k - 1] + t01, f1[k - 1] + t11) + y[k], f1[k - 1])
    total = join(f0[-1], f1[-1])
    for k in range(most - 2, -1, -1):
        to0, to1 = x[k + 1] + b0[k + 1], y[k + 1] + b1[k + 1]
        b0[k] = np.where(on[k + 1], join(t00 + to0, t01 + to1), 0)
        b1[k] = np.where(on[k + 1], join(t10 + to0, t11 + to1), 0)
    steps = on[1:]
    pair = np.array([[np.exp((f[:-1] + t + s[1:] + b[1:] - total)[steps]).sum() for t, s, b in ((ta, x, b0), (tb, y, b1))] for f, ta, tb in ((f0, t00, t01), (f1, t10, t11))])
    chance = np.stack([np.exp(f0 + b0 - total).T, np.exp(f1 + b1 - total).T], axis=2) * mask[..., None]
    return total, chance, pair


def fit(pages: Iterable[tuple[list[tuple], list[int]]], steps: int = STEPS) -> Field:
    """A field from (features of blocks, labels) of pages, by resilient steps (Rprop) up the penalised likelihood."""
    pages = [(f[:LONGEST], y[:LONGEST]) for f, y in pages if y]
    model = Field()
    if not pages:
        return model
    most = max(len(y) for _, y in pages)
    page, place, row, gold = [], [], [], np.zeros((len(pages), most), np.int64)
    mask = np.zeros((len(pages), most), bool)
    for p, (features, y) in enumerate(pages):
        gold[p, : len(y)], mask[p, : len(y)] = y, True
        for k, names in enumerate(features):
            for name in names:
                page.append(p)
                place.append(k)
                row.append(model.rows.setdefault(name, len(model.rows)))
    at, row = np.array(page) * most + np.array(place), np.array(row)
    n = len(model.rows)
    one = np.eye(2)[gold] * mask[..., None]

    def by_feature(x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(row, x.reshape(-1, 2)[at, c], n) for c in (0, 1)], axis=1)

    pair_gold = np.zeros((2, 2))
    np.add.at(pair_gold, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    model.weights = np.zeros((n, 2))
    held = (model.weights, model.pairs, model.starts)
    size, last = [np.full_like(x, 0.1) for x in held], [np.zeros_like(x) for x in held]
    for _ in range(steps):
        scores = np.stack([np.bincount(at, model.weights[row, c], mask.size) for c in (0, 1)], axis=1).reshape(*mask.shape, 2)
        _, chance, pair = _chain(scores, mask, model)
        grads = (by_feature(one - chance) / len(pages) - PENALTY * model.weights, (pair_gold - pair) / len(pages) - PENALTY * model.pairs, (one[:, 0] - chance[:, 0]).mean(axis=0) - PENALTY * model.starts)
        for x, g, step, before in zip(held, grads, size, last, strict=True):
            step *= np.where(g * before > 0, 1.2, np.where(g * before < 0, 0.5, 1.0))
            np.clip(step, 1e-6, 1.0, out=step)
            x += step * np.sign(g)
            before[:] = g
    return model


def _layout_page(parts: list[tuple[str, bool]]) -> tuple[list[tuple], list[int]]:
    """Features and labels of a page of pieces; a mark in each piece's texts tells whose they are."""
    text = "".join(re.sub(r">([^<]+)", lambda m: f">{chr(0xE000 + main)}{m[1]}", html) for html, main in parts)
    features, labels = [], []
    for b in blocks(text, tag_features):
        labels.append(int(chr(0xE001) in b.text))
        b.text = re.sub("[]", "", b.text).strip() or "-"
        features.append((*b.open_features, *text_features(b)))
    return features, labels


def landmark_page(page: str) -> tuple[list[tuple], list[int]] | None:
    """Features and labels of a page that marks its article; None where it does not."""
    features, labels = [], []
    for b in blocks(page, tag_features):
        tags = {f[4:] for f in b.open_features if f.startswith("tag ")}
        labels.append(int(bool(tags & INSIDE) and not tags & OUTSIDE))
        features.append((*b.open_features, *text_features(b)))
    return (features, labels) if any(labels) else None


def train_extractor(pages: DataFrame | None = None, *, page_id: str = "page_id", html: str = "html", layouts: int = LAYOUT_PAGES, sample_pages: int = SAMPLE_PAGES) -> Field:
    """A field from layouts and from landmarks in at most sample_pages of pages, those of smallest hash of their id."""
    learned = [_layout_page(p) for p in labelled_pages(layouts)]
    if pages is not None and sample_pages:
        key = F.xxhash64(F.col(page_id).cast("string"))
        chosen = pages.select(page_id).where(F.col(page_id).isNotNull()).distinct().orderBy(key, page_id).limit(sample_pages)
        rows = pages.where(F.length(html) <= SAMPLE_CHARS).join(F.broadcast(chosen), page_id, "left_semi").select(page_id, html).orderBy(key, page_id, F.xxhash64(html)).limit(sample_pages).collect()  # a bounded sample
        learned += [p for r in rows if (p := landmark_page(r[html]))]
    random.Random(3).shuffle(learned)
    return fit(learned)


def extract_page(page: str, model: Field, cache: dict | None = None) -> str:
    """The article's blocks of a page, a line each."""
    cache = {} if cache is None else cache
    rows = model.rows

    def features_of(tag: str, attributes: str) -> tuple:
        found = cache.get((tag, attributes))
        if found is None:
            if len(cache) > _KEPT_TAGS:
                cache.clear()
            found = cache[tag, attributes] = tuple(rows[f] for f in tag_features(tag, attributes) if f in rows)
        return found

    found = list(blocks(page, features_of))
    if not found:
        return ""
    flat, ends = [], []
    for b in found:
        flat += b.open_features
        flat += [rows[f] for f in text_features(b) if f in rows]
        ends.append(len(flat))
    sums = np.zeros((len(flat) + 1, 2))
    np.cumsum(model.weights[np.array(flat, np.int64)], axis=0, out=sums[1:])
    ends = np.array(ends)
    scores = sums[ends] - sums[np.r_[0, ends[:-1]]]
    return "\n".join(b.text for b, y in zip(found, model.labels(scores), strict=True) if y)


def extract(pages: DataFrame, model: Field | None = None, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page; text is empty if there is none.

    A null or empty page has no text, an empty table no rows; repeated rows stay, null ids and urls too; pages of any
    length count whole; other columns are not read. Without a model, one is fitted to layouts and to landmarks of a
    sample of the pages.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or train_extractor(pages, page_id=page_id, html=html))
    named = (("page_id", page_id), ("url", url))
    schema = T.StructType([*(T.StructField(n, pages.schema[c].dataType) for n, c in named), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, cache = to_arrow_schema(schema), {}
        for batch in batches:
            for part in slices(batch, 2):
                texts = [extract_page(t, sent.value, cache) if t else "" for t in part.column(2).to_pylist()]
                made = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow, strict=True)], names=arrow.names)
        give_back()

    return pages.select(*(F.col(c).alias(n) for n, c in named), F.col(html).alias("html")).mapInArrow(run, schema)
