"""Query op4_extendible_hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sharding import shard
from .tables import table


def op4_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=1 << 20)


ORACLE = r"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
           right(CAST(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT)::BIT AS VARCHAR), 32) AS bits FROM documents),
levels AS (SELECT doc_id, bytes, depth, substr(bits, 1, depth) AS shard FROM d, (SELECT CAST(unnest(generate_series(0, 32)) AS INTEGER) AS depth)),
sized AS (SELECT *, CAST(sum(bytes) OVER w AS BIGINT) AS shard_bytes, count(*) OVER w AS docs FROM levels WINDOW w AS (PARTITION BY depth, shard))
SELECT doc_id, bytes, shard, depth, shard_bytes FROM sized WHERE shard_bytes <= 1048576 OR docs = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""
