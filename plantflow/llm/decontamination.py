"""Benchmark decontamination by suffix arrays of the training texts.

Every task turns a slice of the training documents into one word sequence with a separator after
each document and sorts its suffixes to the depth of a window: first by packed keys of the leading
words, then by prefix doubling over the positions that are still tied. Each suffix of each benchmark
item is binary-searched in that array, equal windows once; the interval it ends with holds every place
where the window stands verbatim. A place whose word before also stands before the window in the item
only continues another match; from all others the longest match is read off word by word. So the work
follows the matches that come out, in texts of one repeated word too.

Only the benchmark is broadcast, in blocks of at most BLOCK_BYTES of text: one block for the usual
few megabytes, and as many passes over the documents as a larger benchmark has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import forget, written
from .textarrays import ALNUM_SPLIT, fresh_name, list_array, text_bytes, with_struct, words

WINDOW = 10
BLOCK_BYTES = 16 << 20

MATCH = T.StructType([T.StructField("item", T.StringType()), T.StructField("item_start", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))])


class SuffixArray:
    """Suffixes of words[], sorted by their first depth words; rank 0 separates documents."""

    def __init__(self, hashes: np.ndarray, row: np.ndarray, n_rows: int, depth: int) -> None:
        self.vocabulary, inverse = np.unique(hashes, return_inverse=True)
        self.width = 3 if self.vocabulary.size < (1 << 21) - 1 else 2
        self.bits = 63 // self.width
        pad = depth + self.width
        # a document's word i stands at i + row, so one place between documents stays 0
        self.rank = np.zeros(hashes.size + n_rows + pad, np.int64)
        self.rank[np.arange(hashes.size) + row] = inverse + 1
        n = hashes.size + n_rows
        keys = np.zeros(n, np.int64)
        for k in range(self.width):
            keys = (keys << self.bits) | self.rank[k : k + n]
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        new = np.ones(n, bool)
        new[1:] = self.keys[1:] != self.keys[:-1]
        self._double(new, n, depth, pad)

    def _double(self, new: np.ndarray, n: int, depth: int, pad: int) -> None:
        if n == 0:
            return
        sorted_to = self.width
        place = np.zeros(n + pad, np.int64)
        while sorted_to < depth:
            group = np.cumsum(new)
            place[self.order] = group
            alone = new.copy()
            alone[:-1] &= new[1:]
            tied = np.flatnonzero(~alone)
            # what starts with a separator can match nothing
            tied = tied[self.rank[self.order[tied]] > 0]
            if tied.size == 0:
                return
            at = self.order[tied]
            follow = place[np.minimum(at + sorted_to, n + pad - 1)]
            by = np.lexsort((follow, group[tied]))
            self.order[tied] = at[by]
            g, f = group[tied][by], follow[by]
            new[tied[1:]] |= (g[1:] != g[:-1]) | (f[1:] != f[:-1])
            sorted_to *= 2

    def find(self, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each query's first lengths[i] words; queries is a matrix of word hashes."""
        at = np.searchsorted(self.vocabulary, queries)
        known = at < self.vocabulary.size
        known[known] = self.vocabulary[at[known]] == queries[known]
        rank = np.where(known, at + 1, -1)
        low, high = np.zeros(lengths.size, np.int64), np.zeros(lengths.size, np.int64)
        inside = np.arange(queries.shape[1])[None, :] < lengths[:, None]
        alive = np.flatnonzero(((rank > 0) | ~inside).all(axis=1))
        if alive.size == 0 or self.keys.size == 0:
            return low, high
        lead, span = np.zeros(alive.size, np.int64), np.ones(alive.size, np.int64)
        for k in range(self.width):
            has = lengths[alive] > k
            word = rank[alive, k] if k < queries.shape[1] else np.zeros(alive.size, np.int64)
            lead = (lead << self.bits) | np.where(has, word, 0)
            span = np.where(has, span, span << self.bits)
        low[alive] = np.searchsorted(self.keys, lead, side="left")
        high[alive] = np.searchsorted(self.keys, lead + (span - 1), side="right")
        for depth in range(self.width, queries.shape[1]):
            alive = alive[high[alive] > low[alive]]
            live = alive[lengths[alive] > depth]
            if live.size == 0:
                break
            low[live], high[live] = self._narrow(low[live], high[live], rank[live, depth], depth)
        return low, high

    def _narrow(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        ends = []
        for side in (np.less, np.less_equal):
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                right = side(self.rank[self.order[np.where(open_, mid, low)] + depth], word) & open_
                a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
            ends.append(a)
        return ends[0], ends[1]


class Items:
    """A block of benchmark items as query suffixes: one for each different window of the items.

    occurrences (item, start, and the number of the word before, 0 for none) are sorted by window and
    that word, so that those with a given word before are one run.
    """

    def __init__(self, ids: list, texts: list, window: int) -> None:
        self.hashes, row = words(pa.array(texts, pa.string()), ALNUM_SPLIT)
        counts = np.bincount(row, minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
        self.first = np.cumsum(counts) - counts
        self.end = self.first + counts
        sizes = np.minimum(counts, window)
        each = np.where(counts > 0, counts - sizes + 1, 0)
        item = np.repeat(np.arange(len(ids)), each)
        start = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        padded = np.concatenate([self.hashes, np.zeros(window, np.uint64)])
        at = self.first[item] + start
        inside = np.arange(window)[None, :] < sizes[item][:, None]
        windows = np.where(inside, padded[at[:, None] + np.arange(window)[None, :]], np.uint64(0)) if item.size else np.zeros((0, window), np.uint64)
        self.queries, where, which = np.unique(windows, axis=0, return_index=True, return_inverse=True)
        self.length = sizes[item][where]
        self.before = np.unique(self.hashes)
        before = np.where(start > 0, np.searchsorted(self.before, padded[at - 1]) + 1, 0)
        self.keys = which.ravel() * (self.before.size + 1) + before
        by = np.argsort(self.keys, kind="stable")
        self.keys, self.item, self.start = self.keys[by], item[by], start[by]
        self.run = np.searchsorted(self.keys, np.arange(self.length.size + 1) * (self.before.size + 1))
        self.ids = np.array([None if i is None else str(i) for i in ids], dtype=object)
        self.window = window

    def heads(self, query: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each query whose word before is not before (a hash, 0 for none), and the query's place in the list."""
        at = np.minimum(np.searchsorted(self.before, before), max(self.before.size - 1, 0))
        known = self.before[at] == before
        key = query * (self.before.size + 1) + at + 1
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        low, high = np.where(known, low, self.run[query]), np.where(known, high, self.run[query])
        parts = [(self.run[query], low), (high, self.run[query + 1])]
        many = [b - a for a, b in parts]
        index = [np.repeat(np.arange(query.size), m) for m in many]
        found = [np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(a, m) for m, (a, _) in zip(many, parts, strict=True)]
        return np.concatenate(found), np.concatenate(index)


def _matches(items: Items, texts: pa.Array) -> list:
    hashes, row = words(texts, ALNUM_SPLIT)
    n_rows = len(texts)
    n_words = np.bincount(row, minlength=n_rows).astype(np.int64)
    array = SuffixArray(hashes, row, n_rows, items.window)
    low, high = array.find(items.queries, items.length) if items.length.size else (np.zeros(0, np.int64),) * 2
    many = high - low
    query = np.repeat(np.arange(many.size), many)
    place = array.order[np.repeat(low, many) + np.arange(query.size) - np.repeat(np.cumsum(many) - many, many)]
    # the words with one place of 0 between documents, and before the first one
    line = np.zeros(hashes.size + n_rows + items.window + 2, np.uint64)
    line[np.arange(hashes.size) + row + 1] = hashes
    found, index = items.heads(query, line[place]) if query.size else (query, query)
    query, place = query[index], place[index]
    item, start, length = items.item[found], items.start[found], items.length[query].copy()
    going = np.arange(place.size)
    while going.size:
        next_ = items.first[item[going]] + start[going] + length[going]
        going, next_ = going[next_ < items.end[item[going]]], next_[next_ < items.end[item[going]]]
        going = going[items.hashes[next_] == line[place[going] + 1 + length[going]]]
        length[going] += 1
    # the document of a place, and the word's number in it: word i of row r stands at first[r] + r + i
    begin = np.cumsum(n_words) - n_words + np.arange(n_rows)
    doc = np.searchsorted(begin, place, side="right") - 1
    at = place - begin[doc] if place.size else place
    by = np.lexsort((start, at, item, doc))
    doc, at, item, start, length = doc[by], at[by], item[by], start[by], length[by]
    one = pa.StructArray.from_arrays(
        [pa.array(items.ids[item], pa.string()), pa.array(start, pa.int32()), pa.array(at, pa.int32()), pa.array(length, pa.int32())],
        names=MATCH.names,
    )
    offsets = np.zeros(n_rows + 1, np.int32)
    np.cumsum(np.bincount(doc, minlength=n_rows), out=offsets[1:])
    return [pa.array(n_words), pa.ListArray.from_arrays(pa.array(offsets), one)]


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[list[str], list[str]]]:
    """Ids and texts of the benchmark's different rows, in parts of block_bytes at most about, by a hash of the row; one at least."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    rows = written(rows.distinct(), "items")
    n = -(-rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0] // block_bytes)
    n = 2 * n if n > 1 else 1  # room for uneven parts
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("text", "id"), F.lit(n)) == k).collect()  # of block_bytes
        yield [r[0] for r in part], [r[1] for r in part]
    forget(rows)


def find_matches(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """docs with a struct column (n_words, matches), and that column's name.

    A match is a longest run of words, window or more, that an item and the document share: item,
    item_start, start (both count words from 0) and length. An item of fewer words than window
    matches as a whole. Words are runs of [0-9a-z] and non-ASCII characters after folding A-Z. Null
    and empty texts have no words and no matches; an empty benchmark matches nothing. Repeated item
    rows are one item; a null item_id stays null. Longest matches that overlap are all
    kept. Rows and extra columns of docs are kept as they are.
    """
    context = docs.sparkSession.sparkContext
    name = fresh_name(docs, "_contamination")
    out, parts = docs, []
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        sent = context.broadcast(block)
        part = fresh_name(out, name)

        def start(sent=sent):
            items = Items(*sent.value, window)
            return lambda texts: _matches(items, texts)

        out, parts = with_struct(out, text, part, FOUND, start), [*parts, part]
    if len(parts) > 1:
        merged = F.struct(F.col(parts[0])["n_words"].alias("n_words"), F.flatten(F.array(*(F.col(p)["matches"] for p in parts))).alias("matches"))
        out = out.withColumn(parts[0], merged).drop(*parts[1:])
    return out, parts[0]


def covered_words(matches: Column) -> Column:
    """The number of different words inside an array of matches, however they overlap."""
    order = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].cast("long").alias("a"), (m["start"] + m["length"]).cast("long").alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("end"))
    step = lambda s, m: F.struct((s["sum"] + F.greatest(m["b"] - F.greatest(m["a"], s["end"]), F.lit(0))).alias("sum"), F.greatest(s["end"], m["b"]).alias("end"))
    return F.aggregate(order, zero, step, lambda s: s["sum"])


def contamination_report(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, matches.

    n_hit counts the words inside any match; items with a null id count there but are not listed.
    """
    found, name = find_matches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), benchmark, **options)
    col = F.col(name)
    hit, items = covered_words(col["matches"]), F.array_sort(F.array_distinct(F.filter(col["matches"]["item"], lambda i: i.isNotNull())))
    return found.select("doc_id", col["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), col["matches"].alias("matches"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_hit: int = 1, **options) -> DataFrame:
    """docs without the rows in which min_hit words or more stand in matches; columns as before."""
    found, name = find_matches(docs, benchmark, **options)
    return found.where(covered_words(F.col(name)["matches"]) < min_hit).drop(name)
