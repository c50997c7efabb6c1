import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plantflow.llm import registry
from plantflow.llm.tables import written

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DIR), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == before


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


@pytest.fixture(scope="module")
def odd(spark):
    """The given documents with rows that are null, empty, repeated and very long, and columns whose names stages use."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(150)
    first = docs.orderBy("doc_id").limit(1)
    texts = [(10_001, None), (10_002, ""), (10_003, " \n "), (10_004, "again and again these words"), (10_004, "again and again these words"), (None, "a row without an id"), (10_005, "word " * 400_000), (10_006, "x" * 2_000_000)]
    rows = spark.createDataFrame(texts, "id long, t string").crossJoin(first)
    rows = rows.select(*(F.col("id").cast(f.dataType).alias(f.name) if f.name == "doc_id" else F.col("t").alias("text") if f.name == "text" else F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    both = docs.unionByName(rows)
    for name in ("score", "node", "s", "toxic", "probability", "n_words", "component_id", "kept", "_gone", "_contamination", "piece", "offset"):
        both = both.withColumn(name, F.lit(f"own {name}"))
    return written(both, "odd")


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stages_take_odd_rows(spark, odd, name, stage):
    out = written(stage(spark, odd, DIR), name)
    assert out.columns == odd.columns and out.where("score <> 'own score' OR node <> 'own node' OR kept <> 'own kept'").isEmpty()
    assert out.exceptAll(odd).isEmpty()  # rows are kept or dropped, never made or changed
    kept = [r.doc_id for r in out.where("doc_id > 10000 OR doc_id IS NULL").select("doc_id").collect()]
    assert kept.count(10_004) in (0, 2)  # repeated rows stay or go together
    if name in ("near_dedup", "decontamination"):  # nothing to link with, and no benchmark passage
        assert sorted(kept, key=lambda i: i or 0) == [None, 10_001, 10_002, 10_003, 10_004, 10_004, 10_005, 10_006]


def test_packing_takes_odd_rows(spark, odd):
    pieces = corpus_pipeline.STAGES[-1][1](spark, odd.where("doc_id > 10000 OR doc_id IS NULL"), DIR).collect()
    by = {}
    for r in pieces:
        by.setdefault(r.doc_id, []).append((r.start, r.length))
    assert by[10_001] == by[10_002] == [(0, 1)] and len(by[10_004]) == 2 and set(by) == {None, *range(10_001, 10_007)}
    long = sorted(by[10_005])
    assert sum(n for _, n in long) > 400_000 and [a for a, _ in long] == list(range(0, 4096 * len(long), 4096))
    for s in {r.sequence_id for r in pieces}:
        placed = sorted((r.offset, r.length) for r in pieces if r.sequence_id == s)
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:k]) for k in range(len(placed))] and sum(n for _, n in placed) <= 4096


def test_registry():
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{k}" for k in range(1, 14)}
    assert set(registry.oracle_sql()) <= set(registry.queries())
