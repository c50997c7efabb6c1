"""Sharding by extendible hashing: a directory of hash prefixes, split where a bucket is too large.

The hash of a row is the bits of its key's MD5. The directory starts with one bucket; every round,
only the buckets over the byte limit are split on their next bit, from bytes summed by prefix once per
level of LEVEL_BITS bits. So a round reads sums, not rows, and the directory grows with the data. Rows
whose keys have equal bits cannot be parted by them; such a bucket goes on splitting by the
hash of the text, and equal rows by a hash of their place in the input, so a hot key is no limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import read_stored, stored, written

#: Bytes of text a shard may hold.
LIMIT_BYTES = 8 << 20
LEVEL_BITS = 16
#: Bits of the key, of the text, and of the place of a row.
KEY_BITS = 32


def _bits(hex_: Column) -> Column:
    """32 bits, as text, of the first 8 hex digits."""
    return F.lpad(F.conv(F.substring(hex_, 1, 8), 16, 2), 32, "0")


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    place = F.monotonically_increasing_id().cast("string")
    bits = F.concat(_bits(F.md5(own.cast("binary"))), _bits(F.md5(body.cast("binary"))), _bits(F.md5(place.cast("binary"))))
    return docs.select(F.col(key).alias("doc_id"), F.octet_length(body).cast("long").alias("bytes"), bits.alias("bits"))


def directory(rows: DataFrame, limit: int, total_bits: int = 3 * KEY_BITS) -> DataFrame:
    """(shard, depth, bytes, docs): the leaves; shard is the prefix of bits, '' where one shard holds all.

    rows: bits, bytes. A row over the limit has a shard of its own as far as bits can part it.
    """
    spark = rows.sparkSession
    levels, level, parents = [], 0, None
    open_ = spark.createDataFrame([("",)], "shard string")
    while True:
        reach = min(level + LEVEL_BITS, total_bits)
        # bytes by prefix of this level, of the buckets that are still open
        part = rows.select(F.substring("bits", 1, level).alias("shard"), F.substring("bits", 1, reach).alias("prefix"), "bytes")
        part = part.join(parents, "shard", "left_semi") if parents is not None else part
        sums = written(part.groupBy("prefix").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")), "sums")
        for depth in range(level + (level > 0), reach + 1):
            bucket = F.substring("prefix", 1, depth) if depth else F.lit("")
            sized = sums.withColumn("shard", bucket).groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")).join(open_, "shard", "left_semi")
            levels.append(stored(sized, "level"))
            full = read_stored(spark, sized.schema, levels[-1:]).where((F.col("bytes") > limit) & (F.col("docs") > 1))
            if depth == total_bits or full.isEmpty():
                leaf = (F.col("bytes") <= limit) | (F.col("docs") == 1) | (F.length("shard") == total_bits)
                return read_stored(spark, sized.schema, levels).where(leaf).select("shard", F.length("shard").alias("depth"), "bytes", "docs")
            open_ = full.select(F.explode(F.array(F.concat("shard", F.lit("0")), F.concat("shard", F.lit("1")))).alias("shard"))
        parents, level = full.select("shard"), reach


def shard(docs: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, bytes, shard (its bits), depth, shard_bytes.

    Bytes are those of the text in UTF-8; null counts as empty, and a null key hashes as the empty one.
    Every shard holds limit bytes at most, or a single row. Rows that repeat a key are parted by their
    text and then by their place, so a hot key has many shards. Other columns are left out. An empty
    table has no shards.
    """
    rows = written(_hashed(docs, key, text), "hashed")
    leaves = written(directory(rows, limit), "directory")
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())  # 97 at most
    return _placed(rows, leaves, depths)


def _placed(rows: DataFrame, leaves: DataFrame, depths: list[int]) -> DataFrame:
    """Each row with the one leaf whose bits begin its own."""
    tries = rows.withColumn("shard", F.explode(F.array(*(F.substring("bits", 1, d) if d else F.lit("") for d in depths)))) if len(depths) > 1 else rows.withColumn("shard", F.substring("bits", 1, depths[0]) if depths and depths[0] else F.lit(""))
    return tries.join(leaves.select("shard", "depth", F.col("bytes").alias("shard_bytes")), "shard").select("doc_id", "bytes", "shard", "depth", "shard_bytes")
