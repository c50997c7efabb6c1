"""Query op5_toxicity; tested by held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table
from .toxicity import fit_toxicity, flagged, held_out, with_scores


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored, name = with_scores(docs, model)
    score = F.col(name)["score"]
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), flagged(score, F.col("lang"), model).alias("flagged"))
