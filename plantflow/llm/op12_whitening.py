"""Query op12_embedding_whitening; tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table
from .whitening import whitened


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
