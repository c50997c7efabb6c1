"""Query op3_token_counts; tested against greedy segmentation by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table
from .token_counts import token_counts


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
