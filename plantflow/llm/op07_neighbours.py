"""Query op7_nearest_neighbours; its recall is tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .neighbours import nearest
from .tables import table


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
