"""The queries of this subpackage and their SQL, as __spark_entry__.py adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op01_decontamination, op02_language_model, op03_token_counts, op04_sharding, op05_toxicity, op06_warc, op07_neighbours, op08_packing, op09_quality, op10_near_duplicates, op11_html, op12_whitening, op13_spelling

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op01_decontamination.op1_decontamination,
        "op2_pseudo_likelihood": op02_language_model.op2_pseudo_likelihood,
        "op3_token_counts": op03_token_counts.op3_token_counts,
        "op4_extendible_hashing": op04_sharding.op4_extendible_hashing,
        "op5_toxicity": op05_toxicity.op5_toxicity,
        "op6_warc_revisits": op06_warc.op6_warc_revisits,
        "op7_nearest_neighbours": op07_neighbours.op7_nearest_neighbours,
        "op8_best_fit_packing": op08_packing.op8_best_fit_packing,
        "op9_quality_co_training": op09_quality.op9_quality_co_training,
        "op10_minhash_near_dedup": op10_near_duplicates.op10_minhash_near_dedup,
        "op11_html_extraction": op11_html.op11_html_extraction,
        "op12_embedding_whitening": op12_whitening.op12_embedding_whitening,
        "op13_spelling_variants": op13_spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": op01_decontamination.ORACLE,
        "op4_extendible_hashing": op04_sharding.ORACLE,
        "op10_minhash_near_dedup": op10_near_duplicates.ORACLE,
    }
