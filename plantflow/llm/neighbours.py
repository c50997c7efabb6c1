"""Approximate nearest neighbours by largest inner product with collision-counting hashing.

Vectors are made unit length with one more component (the usual reduction from inner product to
distance: the square root of what a vector lacks to the longest one), so near means large product.
Each shard of the index keeps its vectors and, for every hash, their projections on one random
direction in sorted order. A query opens a window around its own projection in each of them; windows
grow by virtual rehashing (half width times a factor each round); a vector that falls into enough
windows is verified with the exact product in double precision. A query stops in a shard when it has
verified enough vectors, or when no vector left can be better.

Every row is indexed. Shards are dealt by a hash of the row and its place, one to a partition, so they
are even and equal rows spread; each keeps its best k for each query, and one aggregation by query
merges them. Queries are broadcast in blocks of a fixed size, one pass over
the index for a block; blocks are dealt by the row too, so that no id decides one, and what they find
is read as one scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import forget, read_stored, stored, written

K = 20
HASHES = 56
#: Windows a vector must fall into, as a share of the hashes.
THRESHOLD = 0.5
#: First half width of a window and its growth, on projections of unit vectors.
WIDTH = 0.75
GROWTH = 1.2
#: Vectors verified before a query stops in a shard: this many, or this share of the shard.
VERIFY_LEAST = 800
VERIFY_SHARE = 0.24
#: Vectors of a shard, and bytes of a block of queries, at most about.
SHARD_ROWS = 8_000
BLOCK_BYTES = 16 << 20

_SCHEMA = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and v (doubles) of the rows that take part: no null id, null or empty vector, null, non-finite or only zero components."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.where(F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class Shard:
    def __init__(self, ids: np.ndarray, v: np.ndarray, longest: float, directions: np.ndarray) -> None:
        self.ids, self.v, self.longest = ids, v, longest
        self.rough = v.astype(np.float32)
        unit = v / longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
        places = unit @ directions[:-1] + rest[:, None] * directions[-1]
        self.order = np.ascontiguousarray(places.argsort(axis=0).T.astype(np.int32))
        self.places = np.ascontiguousarray(np.sort(places, axis=0).T)

    def near(self, query: np.ndarray, place: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the k best verified vectors but the query's own row."""
        n, hashes = self.ids.size, place.size
        counts = np.zeros(n, np.int64)
        low = np.array([p.searchsorted(x) for p, x in zip(self.places, place, strict=True)])
        high = low.copy()
        enough = min(n, max(VERIFY_LEAST, int(VERIFY_SHARE * n)))
        needed = int(np.ceil(THRESHOLD * hashes))
        width = WIDTH
        while True:
            a = np.array([p.searchsorted(x - width) for p, x in zip(self.places, place, strict=True)])
            b = np.array([p.searchsorted(x + width, side="right") for p, x in zip(self.places, place, strict=True)])
            fresh = [part for o, i, j, l, h in zip(self.order, a, b, low, high, strict=True) for part in (o[i:l], o[h:j])]
            counts += np.bincount(np.concatenate(fresh), minlength=n)
            low, high = np.minimum(a, low), np.maximum(b, high)
            verified = counts >= needed
            if np.count_nonzero(verified) >= enough or (high - low).min() >= n:
                break
            width *= GROWTH
        at = np.flatnonzero(verified & (self.ids != own))
        if at.size > k:
            # single precision decides only what is far below the best k
            rough = self.rough[at] @ query.astype(np.float32)
            cut = np.partition(rough, at.size - k)[at.size - k]
            at = at[rough >= cut - 1e-5 * self.longest * np.linalg.norm(query)]
        scores = (self.v[at] * query).sum(axis=1)
        best = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][best], scores[best]


def nearest(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = K, hashes: int = HASHES, shard_rows: int = SHARD_ROWS, block_bytes: int = BLOCK_BYTES, seed: int = 1) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row whose id divides by every.

    Nearest is the largest inner product in double precision of the vectors as given; ties go to the
    smaller id. With fewer other rows than k all are returned. Vectors that are null, zero or hold null or
    non-finite components take no part; vectors of another length than most take no part either. A
    repeated id stands for each of its rows; it never finds itself.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, longest, n = most["d"], float(np.sqrt(most["longest"])), most["n"]
    rows = rows.where(F.size("v") == size)
    directions = np.random.default_rng(seed).normal(size=(size + 1, hashes))
    shards = max(1, -(-n // shard_rows))
    placed = rows.withColumn("place", F.xxhash64("id", "v", F.monotonically_increasing_id()))
    index = written(placed.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).repartitionById(shards, "shard"), "index")
    queries = index.where(F.pmod("id", F.lit(every)) == 0).select("id", "v", "place")
    block_rows = max(1, block_bytes // (8 * size + 8))
    blocks = max(1, -(-2 * queries.count() // block_rows))

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b for b in batches if b.num_rows]
            if not parts:
                return
            table = pa.Table.from_batches(parts).combine_chunks()
            which = table.column("shard").to_numpy()
            ids, v = table.column("id").to_numpy(), _matrix(table.column("v").combine_chunks(), size)
            query_ids, query_v = sent.value
            unit = query_v / np.maximum(np.sqrt((query_v * query_v).sum(axis=1, keepdims=True)), 1e-300)
            places = unit @ directions[:-1]
            for s in np.unique(which):
                shard = Shard(ids[which == s], v[which == s], longest, directions)
                found = [shard.near(query_v[q], places[q], query_ids[q], k) for q in range(query_ids.size)]
                many = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, many)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["query_id", "vec_id", "score"])

        return run

    searched = index.select("id", "v", "shard")
    paths = []
    for b in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == b).drop("place").toArrow()  # a block of block_bytes
        if some.num_rows == 0:
            continue
        sent = spark.sparkContext.broadcast((some.column("id").to_numpy(), _matrix(some.column("v").combine_chunks(), size)))
        paths.append(stored(searched.mapInArrow(search(sent), _SCHEMA), "found"))
        sent.unpersist()
    forget(index)
    if not paths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = read_stored(spark, T.StructType.fromDDL(_SCHEMA), paths)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
