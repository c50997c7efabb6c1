"""Spelling variants: words one edit apart, found by dense prefix and suffix tiles.

Two words are near if one inserted, deleted or replaced code point makes one of the other: if the
length of their common prefix plus that of their common suffix reaches the longer length minus one.

Words meet in buckets. For a longer length L, the places 0 to L are cut into gaps [a, b); a bucket holds
the words of length L or L - 1 that agree in the first a and the last L - b code points. A near pair
with a common prefix of p stands in the one bucket whose gap holds p, so every pair is found and none
twice. Gaps of a bucket with more than BUCKET words are halved, over and over; a gap of two code points
bounds its bucket by the square of the alphabet, so no group of words can grow hot. Inside a
bucket tasks compare block pairs of padded code-point matrices. Tiles return counts and the best
partner of each word, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import forget, written
from .textarrays import give_back

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A bucket with more words has its gap halved while it is wider than LEAST_GAP.
BUCKET = 512
LEAST_GAP = 2
PIECES = 4
#: Code points compared at once.
TILE = 1 << 21
_NEAR = "word string, near long, best_n long, best string"


def folded(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def counted_words(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", per: int = 31, least_points: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n): runs of letters, one in `per` without one code point by their crc32, with their occurrences.

    A null text has no words; a null id is written as nothing before the colon. Repeated rows count each.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least_points},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", folded(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"), F.char_length("run").alias("points"))
    at = (F.col("h") % F.col("points")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("points")))
    words = runs.select(F.when(F.col("h") % per == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_points).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (word, n, points, longer, a, b) with the key of their bucket."""
    kept = F.col("longer") - F.col("b")
    return rows.withColumn("key", F.xxhash64("longer", "a", "b", F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.col("points") - kept + 1, kept)))


def _first_gaps(words: DataFrame) -> DataFrame:
    """A row for each word, longer length (its own, and one more) and gap."""
    both = words.select("word", "n", F.char_length("word").alias("points")).withColumn("longer", F.explode(F.array("points", F.col("points") + 1)))
    both = both.withColumn("step", F.greatest(F.lit(LEAST_GAP), F.ceil(F.col("longer") / PIECES).cast("int")))
    both = both.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("longer") - 1, F.col("step"))))
    return _keyed(both.withColumn("b", F.least("longer", F.col("a") + F.col("step"))).drop("step"))


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b"))))
    return _keyed(rows.withColumn("half", halves).select("word", "n", "points", "longer", "half.a", "half.b"))


def _buckets(words: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of all buckets, none of them large, and the tables that this has written."""
    rows, done, kept = _first_gaps(words), None, []
    while True:
        full = rows.where(F.col("b") - F.col("a") > LEAST_GAP).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BUCKET).select("key")
        full = written(full, "full")
        kept.append(full)
        if full.isEmpty():
            return (rows if done is None else done.unionByName(rows)), kept
        cold = rows.join(full, "key", "left_anti").select(rows.columns)
        done = cold if done is None else done.unionByName(cold)
        rows = _halved(rows.join(full, "key", "left_semi"))


def _matrices(codes: np.ndarray, start: np.ndarray, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words aligned to the left, and reversed; beyond a word stands a value that is none."""
    at = np.arange(width)
    inside = at < points[:, None]
    last = codes.size - 1
    left = np.where(inside, codes[np.minimum(start[:, None] + at, last)], np.uint32(0xFFFFFFFF))
    right = np.where(inside, codes[np.maximum(start[:, None] + points[:, None] - 1 - at, 0)], np.uint32(0xFFFFFFFF))
    return left, right


def _run_length(same: np.ndarray) -> np.ndarray:
    """How many columns are true from the first on."""
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))


def near_pairs(codes: np.ndarray, points: np.ndarray, bucket: np.ndarray, longer: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of near words, from rows sorted by longer length, bucket and falling own length."""
    start = np.cumsum(points) - points
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cuts = np.flatnonzero(np.diff(longer)) + 1
    for low, high in zip(np.r_[0, cuts], np.r_[cuts, longer.size], strict=True):
        width = int(longer[low])
        ends = np.searchsorted(bucket[low:high], bucket[low:high], side="right") + low
        rows = np.arange(low, high)
        # two words of length L - 1 meet where L - 1 is the longer length
        partners = np.where(points[low:high] == width, ends - rows - 1, 0)
        total = np.cumsum(partners)
        most = max(1, TILE // width)
        for first in range(0, int(total[-1]), most):
            flat = np.arange(first, min(first + most, int(total[-1])))
            i = np.searchsorted(total, flat, side="right")
            j = i + 1 + flat - (total[i] - partners[i])
            f, t = int(i[0]), int(max(i[-1], j.max())) + 1
            left, right = _matrices(codes, start[low + f : low + t], points[low + f : low + t], width)
            p = _run_length(left[i - f] == left[j - f])
            i, j, p = (x[ok] for ok in [(p >= a[low + i]) & (p < b[low + i])] for x in (i, j, p))
            s = _run_length(right[i - f] == right[j - f]) if i.size else p
            ok = p + s >= width - 1
            out_i.append(low + i[ok])
            out_j.append(low + j[ok])
    return np.concatenate(out_i), np.concatenate(out_j)


def _tile(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """(word, near, best_n, best) of whole buckets."""
    words = batch.column(0).to_pylist()
    n, points, longer, a, b, key = (batch.column(k).to_numpy() for k in range(1, 7))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    fresh = np.r_[True, (np.diff(key) != 0) | (np.diff(longer) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)]
    i, j = near_pairs(codes, points.astype(np.int64), np.cumsum(fresh), longer, a, b)
    if not i.size:
        return None
    row, other = np.r_[i, j], np.r_[j, i]
    names = {k: words[k] for k in np.unique(other)}
    rank = np.zeros(len(words), np.int64)
    for r, k in enumerate(sorted(names, key=names.get)):
        rank[k] = r
    order = np.lexsort((rank[other], -n[other], row))
    row, other = row[order], other[order]
    head = np.flatnonzero(np.r_[True, np.diff(row) != 0])
    count = np.diff(np.r_[head, row.size])
    return pa.RecordBatch.from_arrays([pa.array([words[k] for k in row[head]], pa.string()), pa.array(count, pa.int64()), pa.array(n[other[head]], pa.int64()), pa.array([words[k] for k in other[head]], pa.string())], names=["word", "near", "best_n", "best"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = now.column(6).to_numpy()
        cut = int(np.r_[0, np.flatnonzero(np.diff(key)) + 1][-1])
        if cut and (made := _tile(now.slice(0, cut))) is not None:
            yield made
        held = now.slice(cut)
    if held is not None and (made := _tile(held)) is not None:
        yield made
    give_back()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words, distinct in (word, n), that have a near one.

    best is the near word of largest n, and of those the smallest in code-point order. The result is a
    table of the shared folder.
    """
    rows, kept = _buckets(words)
    rows = rows.select("word", "n", "points", "longer", "a", "b", "key").repartition("key").sortWithinPartitions("longer", "a", "b", "key", F.desc("points"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    near = rows.mapInArrow(_tiles, _NEAR).groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    found = written(near.select("word", "n_near", F.col("best.best").alias("best"), (-F.col("best.less")).alias("best_n")), "near")
    for t in kept:
        forget(t)
    return found


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without cycles: the end of each chain, by doubling its hops."""
    hops = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = hops.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        table = written(moved, "roots")
        forget(hops)
        hops = table
        if hops.where("moved").isEmpty():
            return hops.select("word", "root")


def spelling_variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", per: int = 31, least_points: int = 7, least_count: int = 2, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs.

    form is the near word of largest n, if that is `ratio` times the word's n at least, else null; root is
    where following forms ends, the word itself without a form. Null and empty texts have no words, an empty
    table has no rows, very long texts and words count whole, repeated rows count each, ties go to the
    smaller word, other columns are not read.
    """
    words = written(counted_words(docs, doc_id=doc_id, text=text, per=per, least_points=least_points, least_count=least_count), "words")
    near = words.join(near_words(words), "word", "left")
    formed = F.col("best_n") >= ratio * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    near = written(near, "forms")
    ends = roots(near.where("form IS NOT NULL"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
