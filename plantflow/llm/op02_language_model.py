"""Query op2_pseudo_likelihood; tested by gradients, normalisation and held-out likelihood."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .language_model import score_documents
from .tables import table


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
