"""Query op8_best_fit_packing; its sequences are tested for fit and its ids against the tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .packing import pack_documents
from .tables import table


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
