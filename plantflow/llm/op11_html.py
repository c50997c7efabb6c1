"""Query op11_html_extraction; tested by pages of known text and held-out layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .html_extraction import extract
from .tables import table


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
