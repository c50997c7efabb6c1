"""The corpus pipeline: toxicity, quality, near duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantflow.llm.decontamination import decontaminate
from plantflow.llm.minhash import drop_near_duplicates
from plantflow.llm.packing import pack_documents
from plantflow.llm.quality import drop_low_quality
from plantflow.llm.tables import table, written
from plantflow.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose text reaches the toxicity threshold of its language.

    Null and empty texts have one score; repeated rows stay or go together; an empty table stays empty;
    extra columns, whatever their names, are kept and never read.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose probability of good quality is a half or more.

    Null and empty texts are scored like any other; repeated rows stay or go together; an empty table stays
    empty; extra columns are kept.
    """
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the smallest id.

    Texts without words, and rows without an id, link with nothing and stay; rows that repeat an id are one
    document and stay or go together; texts of any length are compared whole; extra columns are kept.
    """
    return drop_near_duplicates(docs, per_cent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs in which no window of a benchmark item stands.

    Texts without words stay; an empty benchmark removes nothing; repeated items are one; whole texts are
    searched; extra columns are kept.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the documents, placed in sequences of at most 4096 tokens.

    A null or empty text is its end id alone; repeated rows are packed each; null ids are kept; longer texts
    are cut into pieces; extra columns are left out.
    """
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Trained models and a tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences of the documents that every stage keeps."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
