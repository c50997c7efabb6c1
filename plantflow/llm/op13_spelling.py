"""Query op13_spelling_variants; tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .spelling import spelling_variants
from .tables import table


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
