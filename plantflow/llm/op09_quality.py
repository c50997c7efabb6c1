"""Query op9_quality_co_training; tested by held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .quality import score_quality
from .tables import table


def op9_quality_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
