"""Query op6_warc_revisits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table
from .warc import archive_pages


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))
