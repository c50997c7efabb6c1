import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from plantflow.llm import toxicity

DOCS = "doc_id long, text string, lang string"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_long_texts_are_learned_from(spark):
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    text = lambda toxic: " ".join(rng.choices(plain, k=12_000 if toxic else 30) + ["vilezz"] * toxic)
    docs = [(i, text(i % 2 == 0), "en") for i in range(120)]
    assert all((len(t) > 60_000) == (i % 2 == 0) for i, t, _ in docs)
    df = spark.createDataFrame([*docs, (900, "vilezz", "en"), (901, plain[0], "en")], DOCS)
    model = toxicity.fit_toxicity(df, spark.createDataFrame([(i, int(i % 2 == 0)) for i, _, _ in docs], "doc_id long, toxic int"))
    scored, name = toxicity.with_scores(df, model)
    score = {r.doc_id: r[1] for r in scored.select("doc_id", f"{name}.score").collect()}
    unseen = [i for i, _, _ in docs if held(i)]
    assert len(unseen) > 10 and np.mean([(score[i] >= 0.5) == (i % 2 == 0) for i in unseen]) > 0.9


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    n = 6000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    table = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    more = df.unionByName(df.where("doc_id < 10").withColumn("text", F.lit("another text")))
    learned = [0, 0]

    def counted(rows, net, sums, share, epochs, round_):
        learned[round_ == toxicity.EPOCHS] = rows.count()

    monkeypatch.setattr(toxicity, "_round", counted)
    toxicity.fit_toxicity(more, table)
    assert sum(learned) == sum(not held(i) for i in range(n)) + sum(not held(i) for i in range(10)) > toxicity.MODEL_ROWS


def test_models_are_averaged_over_those_that_learned():
    nets, learned = [toxicity.ConvNet() for _ in range(2)], np.zeros((2, 3 * toxicity.BUCKETS), np.int64)
    rows = []
    for k, net in enumerate(nets):
        net.start()
        net.params["table"][5], net.params["table"][7 + k], net.params["bias"][0] = k + 1, 4, k
        learned[k, [5, 7 + k]] = 1 + 2 * k, 1
        sums = {n: np.ones_like(v) for n, v in net.params.items()}
        rows += [(0, *b) for b in toxicity._blocks(net, sums, learned[k], 10)]
    import pyarrow as pa

    of = {r[1:3] for r in rows}
    mean = {key: toxicity._mean(pa.Table.from_batches([toxicity._parts([r for r in rows if r[1:3] == key])])).to_pylist()[0] for key in of}
    table = mean["table", 0]
    assert np.frombuffer(table["at"], "<i4").tolist() == [5, 7, 8] and np.allclose(np.frombuffer(table["data"], "<f4").reshape(3, -1), [[1.75], [4], [4]])
    assert np.frombuffer(mean["bias", 0]["data"], "<f4").tolist() == [0.5] and np.frombuffer(mean["bias", 0]["weight"], "<f8").tolist() == [20]
