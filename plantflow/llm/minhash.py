"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Sketch: coordinates are bins. In round i every shingle falls into a hashed bin with the value
(i, hash); a bin keeps its smallest value. A document whose bins are all filled stops; rounds t to
2t - 1 send every shingle to one bin each, so no coordinate stays empty. One round is enough for
most texts, against t hashes for each shingle in plain MinHash.

Candidates: documents with equal shingle sets (by the SHA-256 of the sorted set) form one class first.
Classes that agree in a band of coordinates share a bucket. Pairs of a bucket are not all listed: its members are compared with one
leader, the most central one, and linked classes are merged. A bucket whose members are in one
component is done. What bands leave open is dealt anew by rare shingles (prefix and position filters
of exact set joins): small buckets list their pairs, in large ones members of the smallest
components lead until one component is left. So every pair of a bucket is verified on its full sets,
ruled out by the sizes and what it can share, or already connected. Pairs that share no bucket are not
seen: one in a billion of just the asked similarity, fewer above it.

Members of large buckets are salted, so that no bucket is one task's, and every round reads its
tables as one scan, so that plans do not grow.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import forget, read_stored, remove, stored, written
from .textarrays import BLANK_SPLIT, fresh_name, list_array, seeded, splitmix, with_struct, words

SHINGLE = 5
ROWS = 4
#: Links of near_duplicates, and of drop_near_duplicates, if nothing else is asked for.
PER_CENT = 85
DROP_PER_CENT = 80
#: A pair of just the asked similarity misses all bands with this probability at most.
MISS = 1e-9
#: Coordinates there are seeds for.
MOST_BINS = 1024
#: A bucket of so many members at most lists its unsettled pairs.
SMALL_BUCKET = 40
#: Members of a larger bucket compared with all of it in one round, after the first round's one.
LEADERS = 64
#: Members of a bucket in one task, about.
SPLIT = 1_000
#: Candidate ids are broadcast up to this count (8 bytes each), beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000

#: Text bytes sketched at once in a task.
SLICE_BYTES = 1 << 20

SKETCH = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
SETS = T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))])
_MIX = seeded(SHINGLE * 64, 3) | np.uint64(1)
_SEEDS = seeded(2 * MOST_BINS, 5)


def bins_for(per_cent: int, rows: int = ROWS) -> int:
    """Coordinates in bands of so many rows that miss a pair of per_cent with probability MISS at most."""
    open_ = 1 - (per_cent / 100) ** rows
    bands = max(1, math.ceil(math.log(MISS) / math.log(open_))) if open_ > 0 else 1
    if bands * rows > MOST_BINS:
        raise ValueError(f"{per_cent} per cent need {bands * rows} bins, more than {MOST_BINS}: take fewer rows")
    return bands * rows


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, sorted within it, and their rows.

    A text of fewer words than size is one shingle of all its words; one without words has none.
    """
    hashes, row = words(texts, BLANK_SPLIT)
    n = len(texts)
    counts = np.bincount(row, minlength=n)
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    out_row = np.repeat(np.arange(n), each)
    at = first[out_row] + np.arange(out_row.size) - np.repeat(np.cumsum(each) - each, each)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    left = counts[out_row]  # words a short text has
    value = np.zeros(at.size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            term = padded[at + k] * _MIX[k]
            value = (value ^ (value >> np.uint64(29))) + (term if k == 0 else np.where(left > k, term, np.uint64(0)))
        value = splitmix(value)
    ends = np.cumsum(each)
    for a, b in zip((ends - each).tolist(), ends.tolist(), strict=True):
        value[a:b].sort()
    new = np.ones(value.size, bool)
    new[1:] = (value[1:] != value[:-1]) | (out_row[1:] != out_row[:-1])
    return value[new], out_row[new]


def fast_sketch(values: np.ndarray, row: np.ndarray, n: int, bins: int) -> np.ndarray:
    """The n x bins sketches; rows without values keep the largest number in every bin."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * bins, empty, np.uint64)
    low = np.uint64((1 << 48) - 1)
    with np.errstate(over="ignore"):
        for i in range(2 * bins):
            if values.size == 0:
                break
            h = splitmix(values ^ _SEEDS[i])
            at = ((h >> np.uint64(48)) % np.uint64(bins)).astype(np.int64) if i < bins else np.full(h.size, i - bins)
            np.minimum.at(out, row * bins + at, (np.uint64(i) << np.uint64(48)) | (h & low))
            open_ = (out.reshape(n, bins) == empty).any(axis=1)[row]
            values, row = values[open_], row[open_]
    return out.reshape(n, bins)


def _sketches(texts: pa.Array, shingle: int, bins: int, rows: int) -> list:
    values, row = shingle_sets(texts, shingle)
    n = len(texts)
    count = np.bincount(row, minlength=n)
    sketch = fast_sketch(values, row, n, bins)
    ends = np.cumsum(count)
    digests = [hashlib.sha256(values[a:b].tobytes()).digest() for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True)]
    keys = []
    with np.errstate(over="ignore"):
        for k in range(bins // rows):
            key = np.full(n, np.uint64(k + 1))
            for j in range(rows):
                key = splitmix(key * np.uint64(0x9E3779B97F4A7C15) + sketch[:, k * rows + j])
            keys.append(key)
    bands = np.stack(keys, axis=1).view(np.int64)
    bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (bins // rows)), pa.array(bands.ravel()))
    return [pa.array(count.astype(np.int64)), pa.array(digests, pa.binary()), bands]


def _full_sets(texts: pa.Array, shingle: int) -> list:
    values, row = shingle_sets(texts, shingle)
    return [list_array(values.view(np.int64), row, len(texts), pa.int64())]


def _salted(rows: DataFrame, many: str) -> DataFrame:
    """rows with salts, the parts their bucket is in, and salt, their own; many: members of the bucket."""
    salts = F.greatest(F.lit(1), F.ceil(F.col(many) / SPLIT)).cast("int")
    return rows.withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).drop(many)


def _with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows joined to one row of facts (bucket, salts, ...) for each bucket, part by part."""
    parts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return rows.join(parts, ["bucket", "salt"])


def _shared_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, node, n, salts, salt) of the buckets with two classes or more."""
    rows = classes.select(F.explode("bands").alias("bucket"), "node", F.col("n_shingles").alias("n"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1")
    return _salted(rows.join(shared, "bucket"), "many")


def _hopeful(members: DataFrame, per_cent: int) -> DataFrame:
    """members without those that no partner in their bucket can make a link with.

    shared is the most that a member can have in common with another one of its bucket. With the
    smallest size there (or shared itself, if larger) the best similarity it can have is known.
    """
    rows = _with_facts(members, members.groupBy("bucket", "salts").agg(F.min("n").alias("least")))
    return rows.where(100 * F.col("shared") >= per_cent * (F.greatest("least", "shared") + F.col("n") - F.col("shared"))).drop("least")


def _band_members(members: DataFrame, sets: DataFrame) -> DataFrame:
    """shared for buckets of bands: what is left without the shingles no other candidate has."""
    alone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    own = alone.groupBy("node").agg(F.count("*").alias("own"))
    return members.join(own, "node", "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")


def _prefix_members(open_: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Buckets by rare shingle for the nodes that bands left open.

    Ordered from rare to frequent, two sets that can link have a shingle in common among the first
    n - (least overlap) + 1 of each, and from the first common one, at position p, no more than
    n - p + 1 in common.
    """
    least = _with_facts(open_, open_.groupBy("bucket", "salts").agg(F.min("n").alias("least")))
    nodes = least.groupBy("node").agg(F.max("n").alias("n"), F.min("least").alias("least"))
    shingles = sets.join(nodes, "node").select("node", "n", "least", F.explode("shingles").alias("s"))
    frequent = shingles.groupBy("s").agg(F.count("*").alias("df"))
    order = Window.partitionBy("node").orderBy("df", "s")
    overlap = F.ceil(per_cent * (F.col("n") + F.greatest("least", F.ceil(F.col("n") * per_cent / 100))) / (100 + per_cent))
    ranked = shingles.join(frequent, "s").withColumn("p", F.row_number().over(order))
    kept = ranked.where((F.col("p") <= F.col("n") - overlap + 1) & (F.col("df") > 1))
    return _salted(kept.select(F.col("s").alias("bucket"), "node", "n", (F.col("n") - F.col("p") + 1).alias("shared"), "df"), "df")


def _opened(alive: DataFrame, labels: DataFrame) -> DataFrame:
    """alive with component and size, in the buckets where more than one component is left."""
    known = alive.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = known.groupBy("bucket", "salts").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return written(_with_facts(known, sizes.drop("low", "high")), "open")


def _candidates(open_: DataFrame, small: int, leaders: int, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to verify and who has led (bucket, node), from members of unsettled buckets.

    Leaders are one member from each of the smallest components of a bucket: the one that can share
    most. Buckets of small size list all their pairs.
    """
    parts = open_.where(F.col("size") > small).groupBy("bucket", "salts", "component").agg(F.count("*").alias("c"), F.min(F.struct((F.col("n") - F.col("shared")).alias("own"), "node", "n", "shared")).alias("best"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("c", "best", "component"))
    lead = parts.withColumn("k", rank).where(F.col("k") <= leaders)
    lead = lead.select("bucket", "salts", F.col("component").alias("component_x"), F.col("best.node").alias("x"), F.col("best.n").alias("n_x"), F.col("best.shared").alias("shared_x"))
    y = open_.select("bucket", "salt", "size", F.col("component").alias("component_y"), F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("shared").alias("shared_y"))
    x = open_.where(F.col("size") <= small).select("bucket", F.col("component").alias("component_x"), F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("shared").alias("shared_x"))
    most = F.least("shared_x", "shared_y")
    fits = (F.col("component_x") != F.col("component_y")) & (100 * most >= per_cent * (F.col("n_x") + F.col("n_y") - most))
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    stars = _with_facts(y.where(F.col("size") > small), lead).where(fits).select(*pair)
    near = x.join(y.where(F.col("size") <= small).drop("salt"), "bucket").where(fits & (F.col("x") < F.col("y"))).select(*pair)
    return stars.unionByName(near).distinct(), lead.select("bucket", F.col("x").alias("node"))


def _verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("s", "t")).cast("long"))
    return both.where(100 * F.col("common") >= per_cent * (F.size("s") + F.size("t") - F.col("common"))).select("a", "b")


def linked_classes(classes: DataFrame, docs: DataFrame, per_cent: int, shingle: int, small: int = SMALL_BUCKET, leaders: int = LEADERS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(node, component) of the classes that a link joins to another.

    classes: node, n_shingles, bands; docs: node, text for every node, others may be there too.
    """
    members = written(_shared_buckets(classes), "buckets")
    wanted = members.select("node").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_ids else wanted
    sets = with_struct(docs.join(wanted, "node", "left_semi"), "text", "s", SETS, lambda: lambda t: _full_sets(t, shingle), SLICE_BYTES)
    sets = written(sets.select("node", F.col("s.shingles").alias("shingles")).distinct(), "sets")
    spark = classes.sparkSession
    node = members.schema["node"].dataType
    pair_type = T.StructType([T.StructField("a", node), T.StructField("b", node)])
    labels = spark.createDataFrame([], T.StructType([T.StructField("node", node), T.StructField("component", node)]))
    tested: list[str] = []
    links: list[str] = []
    alive, before, round_ = _hopeful(_band_members(members, sets), per_cent), members, 0
    while True:
        open_ = _opened(alive, labels)
        forget(before)
        before = open_
        if open_.isEmpty():
            break
        if round_ == 1:
            prefixes = written(_prefix_members(open_, sets, per_cent), "prefixes")
            open_ = _opened(_hopeful(prefixes, per_cent), labels)
            forget(before)
            forget(prefixes)
            before = open_
        most, lead = (small, leaders) if round_ else (2, 1)
        pairs, led = _candidates(open_, most, lead, per_cent)
        if tested:
            pairs = pairs.join(read_stored(spark, pair_type, tested), ["a", "b"], "left_anti")
        tested.append(stored(pairs, "pairs"))
        links.append(stored(_verified(read_stored(spark, pair_type, tested[-1:]), sets, per_cent), "links"))
        if not read_stored(spark, pair_type, links[-1:]).isEmpty():
            old = labels
            labels = components(read_stored(spark, pair_type, links))
            forget(old)
        done = open_.where(F.col("size") <= most).select("bucket", "node").unionByName(led)
        alive, round_ = open_.drop("component", "size").join(done, ["bucket", "node"], "left_anti"), round_ + 1
    for path in tested + links:
        remove(spark, path)
    forget(sets)
    return labels


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, per_cent: int = PER_CENT, bins: int | None = None, rows: int = ROWS, small: int = SMALL_BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are runs of non-blanks after folding A-Z; a set holds the distinct shingles of so many
    words, or the whole text if it has fewer. Two documents are linked if the common shingles are
    per_cent of the union or more, confirmed on the full sets. component_id is the smallest doc_id
    reachable. Null, empty and blank texts have no shingles and link with nothing. A row with a null
    id links with nothing and is kept. Rows that repeat an id are one document, and all are kept or
    dropped together. Order and partitions of the input change nothing. bins: as many as per_cent needs.
    """
    bins = bins or bins_for(per_cent, rows)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketched = with_struct(base, "text", "s", SKETCH, lambda: lambda t: _sketches(t, shingle, bins, rows), SLICE_BYTES)
    sketched = written(sketched.select("doc_id", "s.*"), "sketches")
    key = ["digest", "n_shingles"]
    classes = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands"))
    classes = written(classes, "classes")
    labels = linked_classes(classes.select("node", "n_shingles", "bands"), base.withColumnRenamed("doc_id", "node"), per_cent, shingle, small)
    ends = classes.join(labels, "node", "left").select(*key, F.coalesce("component", "node").alias("component_id"))
    out = sketched.drop("bands").join(ends, key, "left")
    out = out.withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", per_cent: int = DROP_PER_CENT, **options) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the smallest id."""
    gone = near_duplicates(docs, doc_id=doc_id, per_cent=per_cent, **options).where("NOT kept").select(F.col("doc_id").alias(mark := fresh_name(docs, "_gone"))).distinct()
    return docs.join(gone, F.col(doc_id) == F.col(mark), "left_anti")
